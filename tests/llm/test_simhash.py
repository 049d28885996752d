import collections
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from lectern.llm import common
from lectern.llm import simhash as S
from lectern.llm.components import connected_components

LOW = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(LOW))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), seed=42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(fps):
    trees = S.Forest(len(fps))
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 4):
            trees.join(i, int(j))
    out = collections.defaultdict(list)
    for i in range(len(fps)):
        out[trees.root(i)].append(i)
    return list(out.values())


def test_fingerprints():
    texts = ["", None, "a", "A b", "a b C", "a b c d", "a\tb\nc d e ", "\n", "é è ê ë é è ê ë", "x " * 300]
    got = S.fingerprints(common.Words(common.as_text(pa.array(texts)), S.TABLE))
    assert got.tolist() == [fingerprint(t) for t in texts]


@pytest.mark.parametrize("m", [5, 6, 7, 8])
def test_no_link_is_lost(m):
    rng = np.random.default_rng(m)
    base = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    flip = lambda: np.uint64(1) << rng.integers(0, 64, (30, 40), dtype=np.uint64)
    f = np.unique(base[:, None] ^ flip() ^ flip() ^ flip())
    x = (f[:, None] ^ f[None, :]).ravel()
    assert (S.linked(x, m) == (np.bitwise_count(x) <= 4)).all()
    assert S.chains(x, m).mean() < 0.1
    trees = S.Forest(len(f))
    for a, b in S.forest(f, m):
        trees.join(a, b)
    assert len({trees.root(i) for i in range(len(f))}) == len(groups(f))


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 102), (200, 200), (7, None)] + [(300, 300 + i) for i in range(50)]
    rows = {r.node: r.label for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(rows[i] == 0 for i in range(61)) and rows[102] == 100 and rows[349] == 300
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("bucket", [S.BUCKET, 3])
def test_query(spark, tiny, monkeypatch, bucket):
    monkeypatch.setattr(S.links, "__defaults__", (S.TAU, bucket))
    docs = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(5000, None), (4000, ""), (-3, " \n"), (4001, "the same"), (4002, "The same"), (4002, "The same")], docs.schema))
    rows = S.near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(int(r.fingerprint, 16) == fingerprint(texts[r.doc_id]) and len(r.fingerprint) == 16 for r in rows)
    found = groups(np.array([int(r.fingerprint, 16) for r in rows], np.uint64))
    for g in found:
        assert {rows[i].component_id for i in g} == {min(rows[i].doc_id for i in g)}
    if bucket > 3:
        kept = S.deduplicated(docs)
        assert kept.count() == len(found) and kept.columns == docs.columns
        assert S.near_duplicates(docs.limit(0)).count() == 0 and S.deduplicated(docs.limit(0)).count() == 0


def test_null_ids(spark):
    docs = spark.createDataFrame([(None, "a b c d e"), (None, "x y z"), (3, "x y z")], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in S.near_duplicates(docs).collect()} == {(None, None), (None, 3), (3, 3)}
    assert S.deduplicated(docs).count() == 2
