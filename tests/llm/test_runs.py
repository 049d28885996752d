import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from lectern.llm import common
from lectern.llm import runs as R


def brute(w, least=24, periods=3):
    """All runs by looking at every period."""
    n, out = len(w), {}
    for q in range(1, n // periods + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(least, periods * q):
                out.setdefault((i, j + q), q)  # the smallest period comes first
            i = j + 1
    return sorted((u, e, q) for (u, e), q in out.items())


def texts_of(seed, n=60):
    rng = random.Random(seed)
    word = lambda k: [rng.choice("abcdefgh"[:k]) for _ in range(rng.randint(1, 40))]
    out = []
    for _ in range(n):
        w = []
        for _ in range(rng.randint(0, 4)):
            x = word(rng.randint(1, 8))
            w += x * rng.choice([1, 1, 2, 3, 4, 9]) + x[: rng.randint(0, len(x))]
        out.append(w)
    return out


@pytest.mark.parametrize("step", [None, 1, 7, 64])
@pytest.mark.parametrize("limits", [(24, 3), (2, 2), (1, 3)])
def test_all_runs(step, limits):
    texts = texts_of(7) + [["a"] * 300, [], ["x"], list("abcab" * 40), list("aab" * 30 + "c" + "aab" * 30)]
    words = common.Words(pa.array([" ".join(t) for t in texts], pa.large_string()), R.TABLE)
    got = R.runs_of(words, *limits, step=step)
    want = [(i, *r) for i, t in enumerate(texts) for r in brute(t, *limits)]
    assert [tuple(x) for x in got.tolist()] == want


def test_long_texts_of_few_words():
    rng = np.random.default_rng(3)
    for alphabet in (1, 2, 3, 50):
        w = rng.integers(0, alphabet, 3000).tolist() + [7, 8, 9] * 400 + rng.integers(0, alphabet, 500).tolist()
        c = R.Catchers(len(w))
        for i in range(0, len(w), 1000):
            c.append(np.array(w[i : i + 1000], np.uint32))
        assert [tuple(x) for x in c.runs().tolist()] == brute(w)


def test_equal_fingerprints_of_different_words(monkeypatch):
    monkeypatch.setattr(R, "_joined", lambda a, b: (a + b) % np.uint32(2))
    texts = texts_of(11, 20)
    words = common.Words(pa.array([" ".join(t) for t in texts], pa.large_string()), R.TABLE)
    want = [(i, *r) for i, t in enumerate(texts) for r in brute(t)]
    assert [tuple(x) for x in R.runs_of(words).tolist()] == want


def expected(doc_id, text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    n, h = len(w), zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute(w)
    best = min(runs, key=lambda r: (-Fraction(r[1] - r[0], r[2]), r[0], r[2]), default=None)
    gone = {i for u, e, q in runs for i in range(u + q, e)}
    sha = lambda x: hashlib.sha256(x).hexdigest()
    one = (None,) * 4 if best is None else (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2])
    lines = "".join(f"{u},{e - u},{q}\n" for u, e, q in runs).encode()
    return (doc_id, len(runs), *one, sha(lines), sha(b" ".join(x for i, x in enumerate(w) if i not in gone)), n)


def test_query(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").where("length(text) < 6000").select("doc_id", "text")
    more = [(None, "a b " * 30), (None, None), (9001, ""), (9002, "é è " * 20 + "x"), (9002, "é è " * 20 + "x"), (9003, " \n\t "), (9004, "w " * 50_000 + "end"), (9010, "one")]
    docs = docs.unionByName(spark.createDataFrame([r for r in more if r[0] != 9004], docs.schema))
    rows = [tuple(r) for r in R.report(docs).collect()]
    want = [expected(*r) for r in docs.collect()]
    assert sorted(rows, key=str) == sorted(want, key=str)
    assert sum(r[1] > 0 for r in rows) > 10
    long = R.with_runs(spark.createDataFrame([more[6]], docs.schema)).first()
    assert [tuple(x) for x in long.runs] == [(0, 50_000, 1)] and long.collapsed == "w end"
    assert R.report(docs.limit(0)).count() == 0
