import collections
import re
import zlib

import pytest
from pyspark.sql import functions as F

from lectern.llm import quality_rules as Q
from lectern.llm import sharding


def counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0d]+", text)
    c = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {j for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


TEXTS = [None, "", " \t", "a", "a b c", "a b c a b c", "a b c d a b c", "x x x x x x", "é|# é|# é|#", "l1\nl1\n \nl1\nl2", "a\x0bb\x0cc\rd", "w " * 3000, " ".join(str(i % 40) for i in range(500)), " ".join(map(str, range(20000)))]


def test_counts(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text", "source")
    docs = docs.unionByName(spark.createDataFrame([(9000 + i, t, None if i % 2 else "s") for i, t in enumerate(TEXTS)], docs.schema))
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = Q.judge(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == counts(texts[r.doc_id])
        assert not (r.kept and r.base_failed)
    assert Q.judge(docs.limit(0)).count() == 0 and Q.filtered(docs.limit(0)).count() == 0


def test_hosts(spark, monkeypatch):
    clean = " ".join(f"word{i}" for i in range(80))
    some = clean + " ####### #######" * 2  # 28 symbols to 84 words: fails on a bad host alone
    bad = " ".join(f"w{i}%%%" for i in range(80))
    rows = [(i, bad, "junk") for i in range(60)] + [(100 + i, clean, "junk") for i in range(40)] + [(200, some, "junk"), (201, some, "good")] + [(300 + i, clean, "good") for i in range(100)] + [(500 + i, clean, f"h{i}") for i in range(30)] + [(600, bad, "h1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for limit in (Q.BROADCAST_HOSTS, -1):
        monkeypatch.setattr(Q, "BROADCAST_HOSTS", limit)
        kept = {r.doc_id: r.kept for r in Q.judge(docs).collect()}
        assert all(kept[i] == (not (i < 60 or i in (200, 600))) for i in kept)
        assert {r.doc_id for r in Q.filtered(docs).collect()} == {i for i, k in kept.items() if k}
    rates = {r.host: r.p_symbols for r in Q.host_rates(Q.features(docs, ["doc_id", "source"])).collect()}
    assert 0.4 < rates["junk"] < 0.62 and rates["h1"] < 0.9


def test_other_columns(spark):
    docs = spark.createDataFrame([(1, "a " * 60, "s", "x", 2.0)], "doc_id long, text string, source string, kept string, n_words double")
    assert Q.judge(docs).count() == 1 and Q.filtered(docs.withColumn("text", F.lit(" ".join(map(str, range(60)))))).columns == docs.columns


@pytest.mark.parametrize("n", [0, 1, 2, 39, 41, 1000])
def test_shards(spark, n):
    rows = [(None if i % 50 == 7 else i // 2, None if i % 9 == 0 else f"é{i % 5}", i) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, slot long")
    got = sharding.shard(docs).toPandas()
    assert len(got) == n and sorted(got.place) == list(range(n)) and sorted(got.row_number) == list(range(n))
    if n:
        by = got.groupby("shard").slot
        assert by.size().max() - got.shard.value_counts().reindex(range(40), fill_value=0).min() <= 1
        assert all(sorted(s) == list(range(len(s))) for _, s in by)
    expected = collections.Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t, _ in rows)
    assert collections.Counter((None if r.doc_id != r.doc_id else int(r.doc_id), r.size, r.text_crc32) for r in got.rename(columns={"size": "size_"}).rename(columns={"size_": "size"}).itertuples()) == expected if n else True
    again = sharding.shard(docs.orderBy(F.rand(1)).repartition(3)).toPandas()
    assert sorted(map(repr, got.values.tolist())) == sorted(map(repr, again.values.tolist()))


def test_walk():
    for n in (1, 2, 3, 10, 1000, 12345):
        grid, most = sharding._grid(n), sharding.walk_bound(n, 1)
        out = []
        for x in range(n):
            y, steps = sharding._once(x, grid, 1, sharding.ROUNDS), 1
            while y >= n:
                y, steps = sharding._once(y, grid, 1, sharding.ROUNDS), steps + 1
            assert steps <= most
            out.append(y)
        assert sorted(out) == list(range(n))


def test_permuted_is_the_walk(spark):
    from pyspark.sql import functions as F

    from lectern.llm import sharding

    for n, seed in ((1, 1), (7, 3), (1000, 1), (1023, 5)):
        grid = sharding._grid(n)

        def walk(x):
            while (x := sharding._once(x, grid, seed, sharding.ROUNDS)) >= n:  # noqa: B023
                pass
            return x

        got = {r.i: r.p for r in spark.range(n).select(F.col("id").alias("i"), sharding.permuted(F.col("id"), n, seed).alias("p")).collect()}
        assert got == {i: walk(i) for i in range(n)} and sorted(got.values()) == list(range(n))


def test_host_verdicts_by_hand(spark):
    """Shrunken rates and kept beside plain Python, with a null host, repeated rows and clashing columns."""
    import numpy as np

    from lectern.llm import quality_rules as Q

    rng = np.random.default_rng(4)
    rows = []
    for i in range(600):
        host = [None, "bad", "small", "good"][i % 4 if i % 4 != 2 or i < 60 else 3]
        w = [f"w{rng.integers(10_000)}" for _ in range(60)]
        kind = rng.random()
        w += ["####"] * (0 if kind > (0.7 if host == "bad" else 0.02) else int(rng.integers(20, 200)))
        rows.append((i, " ".join(w), host))
    rows += [rows[1]] * 3 + [(None, None, "good"), (900, "", None)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, Text string, source string, TEXT2 string").withColumnRenamed("TEXT2", "host")
    feats = [(sum(c in "[#*$%&|<>]"[1:-1] for c in (t or "")), len((t or "").split()), h) for _, t, h in rows]
    fails = [s > n for s, n, _ in feats]
    hosts = {h for *_, h in feats}
    size = {h: sum(x[2] == h for x in feats) for h in hosts}
    bad = {h: sum(f for f, x in zip(fails, feats, strict=True) if x[2] == h) for h in hosts}
    m = sum(fails) / len(rows)
    v = sum(size[h] * (bad[h] / size[h] - m) ** 2 - m * (1 - m) for h in hosts) / max(1, sum(size[h] - 1 for h in hosts))
    k = min(200.0, max(2.0, m * (1 - m) / v - 1)) if v > 0 else 200.0
    rate = {h: (bad[h] + m * k) / (size[h] + k) for h in hosts}
    worse = {h: rate[h] - m > 0.6745 * (rate[h] * (1 - rate[h]) / (size[h] + k + 1)) ** 0.5 for h in hosts}
    plain = Q.columns_of(docs, "doc_id", "text", "source")
    found = Q.host_rates(Q.written(Q.features(plain, ["doc_id", "source"]), "f"))
    assert {r.host: round(r.p_symbols, 9) for r in found.collect()} == {h: round(r, 9) for h, r in rate.items()}
    assert worse["bad"] and not worse["good"] and not worse[None]
    kept = lambda s, n, h: n >= 50 and not (s > n or (worse[h] and 4 * s > n))
    expected = sorted((str(i), kept(*x)) for (i, *_), x in zip(rows, feats, strict=True))
    assert sorted((str(r.doc_id), r.kept) for r in Q.judge(docs).collect()) == expected
    done = Q.filtered(docs)
    assert done.columns == docs.columns and sorted(str(r.doc_id) for r in done.collect()) == sorted(i for i, k in expected if k)


@pytest.mark.parametrize(("size", "least"), [("sf0.01", 1), ("sf0.1", 10)])
def test_verdicts_touch_documents(spark, size, least):
    """On ordinary tables some hosts are likely worse than the corpus, and some of their documents go for it."""
    from lectern.llm import quality_rules as Q

    docs = spark.read.parquet(f"/root/testdata/{size}/documents.parquet")
    with_hosts, without = Q.judge(docs), Q.judge(docs, sure=float("inf"))
    fewer = without.where("kept").count() - with_hosts.where("kept").count()
    assert least <= fewer <= 0.02 * docs.count()
