import random
import re

import numpy as np
import pyarrow as pa
import pytest

from lectern.llm import common
from lectern.llm import near_copies as N
from lectern.llm.simhash import Forest

LOW = {i: i + 32 for i in range(65, 91)}


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def alike(a, b):
    return 1.0 if a == b else len(a & b) / len(a | b)


def groups(texts, least=0.8):
    s = [shingles(t) for t in texts]
    trees = Forest(len(texts))
    for i in range(len(s)):
        for j in range(i):
            if min(len(s[i]), len(s[j])) >= least * max(len(s[i]), len(s[j])) and alike(s[i], s[j]) >= least:
                trees.join(i, j)
    return [trees.root(i) for i in range(len(s))]


def test_sets_and_fingerprints():
    texts = ["", None, "a b", "A B", "a b c d e f", "a b c d e f a b c d e f", "é ß ü " * 40]
    got = list(N.shingle_sets(common.Words(common.as_text(pa.array(texts)), N.TABLE)))
    assert [len(s) for s in got] == [len(shingles(t)) for t in texts]
    assert (got[2] == got[3]).all() and set(got[4]) <= set(got[5])
    assert N.fingerprint(got[0]) == bytes(32)
    big = np.arange(1, 20_000, dtype=np.uint64)
    same = sum(((N._mixed(big * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1 << 32)) >> np.uint64(b)) & np.uint64(1)).sum() * 2 > len(big) for b in range(64))
    assert np.bitwise_count(np.frombuffer(N.fingerprint(big), np.uint64)[0]) == same


def test_pruning_loses_nothing():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 63, (20_000, 4), dtype=np.uint64) & rng.integers(0, 1 << 63, (20_000, 4), dtype=np.uint64) & rng.integers(0, 1 << 63, (20_000, 4), dtype=np.uint64)
    true = np.bitwise_count(x).sum(axis=1)
    assert (N.distances(x) == np.where(true <= N.REACH, true, N.BITS + 1)).all() and 0.01 < (true <= N.REACH).mean()


@pytest.mark.parametrize("across", [False, True])
def test_forest_is_minimal(across):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, (6, 4), dtype=np.uint64)
    fp = base[rng.integers(0, 6, 90)]
    for row in fp:
        for _ in range(int(rng.integers(0, 30))):
            row[rng.integers(0, 4)] ^= np.uint64(1) << np.uint64(rng.integers(0, 64))
    side = rng.integers(0, 2, 90) if across else np.zeros(90, int)
    d = np.array([[int(np.bitwise_count(a ^ b).sum()) for b in fp] for a in fp])
    pairs = sorted((d[i, j], i, j) for i in range(90) for j in range(i) if d[i, j] <= N.REACH and (not across or side[i] != side[j]))
    trees = Forest(90)
    weight = sum(k for k, i, j in pairs if trees.join(i, j))
    mine = N.spanning(fp, side, across)
    assert sum(d[i, j] for i, j in mine) == weight
    few = N.forests(np.zeros(30, np.int64), fp[:30], side[:30], np.full(30, across))
    assert len(few) == len(N.spanning(fp[:30], side[:30], across))


def changed(rng, words, share):
    return [rng.choice("abcdefghij") * 3 + str(rng.randint(0, 9999)) if rng.random() < share else w for w in words]


@pytest.mark.parametrize("bucket", [N.BUCKET, 4])
def test_near_copies_of_known_similarity(spark, bucket):
    """Pairs at 0.8 to 0.95 and below; of each pair that is near one stays."""
    rng = random.Random(5)
    rows, near, far = [], {}, 0
    for k in range(600):
        words = [f"w{rng.randint(0, 5000)}" for _ in range(rng.randint(60, 400))]
        other = changed(rng, words, rng.choice([0.003, 0.01, 0.02, 0.03, 0.08]))
        a, b = " ".join(words), " ".join(other)
        s = alike(shingles(a), shingles(b))
        rows += [(2 * k, a, "x"), (2 * k + 1, b, "y")]
        near[k], far = s, far + (s < 0.8)
    docs = spark.createDataFrame(rows + [(5000, None, "n"), (5001, "", "n"), (None, "Only THIS", "n"), (5002, "only this", "n")], "doc_id long, text string, lang string")
    kept = {r.doc_id for r in N.deduplicated(docs, bucket).collect()}
    assert {2 * k for k in near} <= kept
    for k, s in near.items():
        assert s >= 0.8 or 2 * k + 1 in kept
    for low, high, least in ((0.8, 0.85, 0.9), (0.85, 0.9, 0.95), (0.9, 1.0, 0.98)):
        here = [2 * k + 1 not in kept for k, s in near.items() if low <= s < high]
        assert len(here) > 30 and np.mean(here) >= least
    assert far > 100 and 5000 in kept and 5001 not in kept and 5002 in kept and None not in kept
    assert N.deduplicated(docs.limit(0)).count() == 0


def test_documents(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    rows = docs.orderBy("doc_id").collect()
    root = groups([r.text for r in rows])
    least = {}
    for r, g in zip(rows, root, strict=True):
        least[g] = min(r.doc_id, least.get(g, r.doc_id))
    kept = {r.doc_id for r in N.deduplicated(docs).collect()}
    assert set(least.values()) <= kept and len(kept - set(least.values())) <= 0.1 * (len(rows) - len(least))
    assert N.deduplicated(docs).columns == docs.columns


def test_sets_that_are_alike_share_a_signature():
    rng = np.random.default_rng(3)
    sizes = [*range(1, 60), 90, 133, 200, 517, 1000] * 8
    for n in sizes:
        m = int(rng.integers(-(-n * 4 // 5), n * 5 // 4 + 1))
        both = -(-4 * (n + m) // 9)  # the smallest number that makes them alike by 0.8
        if both > min(n, m) or both == n == m:
            continue
        pool = np.unique(rng.integers(0, 1 << 63, n + m, dtype=np.uint64) * np.uint64(2))
        assert len(pool) == n + m
        pool = rng.permutation(pool)
        a, b = np.sort(pool[:n]), np.sort(pool[n - both : n - both + m])
        assert 10 * len(np.intersect1d(a, b)) >= 8 * len(np.union1d(a, b))
        assert set(N.signatures(a)) & set(N.signatures(b))
        assert np.bitwise_count((N.parity(a) ^ N.parity(b)).view(np.uint64)).sum() <= n + m - 2 * both


@pytest.mark.parametrize("bucket", [N.BUCKET, 4])
def test_no_pair_is_left_out(spark, bucket):
    """As brute force has it: pairs just at the limit, chains of them, texts with much in common, and short ones."""
    rng = random.Random(6)
    texts, same = [], [f"l{i}" for i in range(60)]
    for _ in range(500):
        words = [f"w{rng.randint(0, 5000)}" for _ in range(rng.choice([8, 9, 12, 30, 100, 300]))]
        texts.append(" ".join(words))
        for _ in range(rng.choice([1, 1, 2])):
            words = list(words)
            for _ in range(max(1, len(words) * 2 // 100)):
                words[rng.choice([0, len(words) - 1, rng.randrange(len(words))])] = f"v{rng.randint(0, 5000)}"
            texts.append(" ".join(words))
    texts += [" ".join(same + [f"x{rng.randint(0, 5000)}" for _ in range(rng.randint(8, 20))]) for _ in range(60)]
    root = groups(texts)
    least = {}
    for i, g in enumerate(root):
        least[g] = min(i, least.get(g, i))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert len(least) < len(texts) - 300
    assert {r.doc_id for r in N.deduplicated(docs, bucket).collect()} == set(least.values())


def test_documents_as_brute_force(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    rows = docs.orderBy("doc_id").collect()
    least = {}
    for r, g in zip(rows, groups([r.text for r in rows]), strict=True):
        least[g] = min(r.doc_id, least.get(g, r.doc_id))
    assert {r.doc_id for r in N.deduplicated(docs).collect()} == set(least.values())


def test_long_sets_are_ruled_out_by_parities_that_grow_with_them(spark):
    """Two bits a shingle or more: pairs well below the limit go before their sets travel, at any length; no link does."""
    rng = np.random.default_rng(4)
    rows, pairs, links = [], [], set()
    for k in range(60):
        n = int(rng.choice([1, 3, 40, 700, 5000, 20_000]))
        pool = rng.permutation(np.unique(rng.integers(0, 1 << 63, 3 * n, dtype=np.uint64)))
        m = int(rng.integers(-(-n * 4 // 5), n * 5 // 4 + 1))
        both = -(-4 * (n + m) // 9) if k % 2 else min(n, m) * 6 // 10
        if both > min(n, m):
            continue
        a, b = np.sort(pool[:n]), np.sort(pool[n - both : n - both + m])
        rows += [(2 * k, a.view(np.int64).tolist(), N.long_parity(a).tolist()), (2 * k + 1, b.view(np.int64).tolist(), N.long_parity(b).tolist())]
        pairs.append((2 * k, 2 * k + 1))
        links |= {pairs[-1]} if 10 * both >= 8 * (n + m - both) else set()
    of = spark.createDataFrame(rows, "node bigint, set array<bigint>, odd array<bigint>")
    left = {tuple(r) for r in N.closer(spark.createDataFrame(pairs, "a bigint, b bigint"), of).collect()}
    assert len(links) > 10 and links <= left
    assert all(p in links or len(rows[[r[0] for r in rows].index(p[0])][1]) < 40 for p in left)
    # the parities of fixed width can't tell these
    x, y = (np.sort(rng.integers(0, 1 << 63, 20_000, dtype=np.uint64)) for _ in range(2))
    assert np.bitwise_count((N.parity(x) ^ N.parity(y)).view(np.uint64)).sum() <= N.far(40_000) < N.odd_bits(N.long_parity(x), N.long_parity(y))


def test_texts_are_not_shuffled_for_a_few_rows(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = N.deduplicated(docs)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning" not in plan and "BroadcastHashJoin" in plan
        keys = out.select(out.doc_id.alias("_key")).limit(5)
        assert "SortMergeJoin" in N.by_key(docs.withColumnRenamed("doc_id", "_key"), keys, "left_anti", few=1)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
