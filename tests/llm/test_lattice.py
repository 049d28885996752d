import itertools
import math

import numpy as np
import pytest

from lectern.llm import lattice as E
from lectern.llm.simhash import Forest

SCHEMA = "vec_id long, embedding array<float>, label int"


def test_decoding_is_exact():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 8)) * 2
    p = E.decoded(x)
    assert (np.abs(2 * p - np.rint(2 * p)) < 1e-9).all() and (p.sum(axis=1) % 2 == 0).all()
    assert ((p % 1 == 0).all(axis=1) | (p % 1 == 0.5).all(axis=1)).all()
    near = p[:, None] + E.NEIGHBOURS[None]
    assert len({tuple(v) for v in E.NEIGHBOURS.tolist()}) == 240 and np.allclose((E.NEIGHBOURS**2).sum(axis=1), 2)
    assert (((x - p) ** 2).sum(axis=1)[:, None] <= ((x[:, None] - near) ** 2).sum(axis=2) + 1e-9).all()


@pytest.mark.parametrize("classes", [10, 10**5, 10**8, 10**10])
def test_plan(classes):
    k, tables = E.plan(classes)
    assert 1 <= k <= 3 and 2 <= tables <= 40
    assert k == 1 or classes > 10**6


def brute(rows, least=E.LEAST):
    sound = [v is not None and label is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v, label in rows]
    unit = [np.array(v, np.float64) / np.linalg.norm(np.array(v, np.float64)) if s else None for (_, v, _), s in zip(rows, sound, strict=True)]
    trees, links = Forest(len(rows)), [0] * len(rows)
    groups = {}
    for i, s in enumerate(sound):
        if s:
            groups.setdefault((rows[i][2], len(rows[i][1])), []).append(i)
    for g in groups.values():
        m = np.array([unit[i] for i in g])
        for a, b in zip(*np.nonzero(np.triu(m @ m.T >= least, 1)), strict=True):
            links[g[a]] += 1
            links[g[b]] += 1
            trees.join(g[a], g[b])
    least_id = {}
    for i, (v, _, _) in enumerate(rows):
        r = trees.root(i)
        least_id[r] = min((x for x in (least_id.get(r), v) if x is not None), default=None)
    return sorted(((rows[i][0], links[i], least_id[trees.root(i)], rows[i][0] == least_id[trees.root(i)]) for i in range(len(rows))), key=str)


def planted(rng, dim=64):
    out, ids = [], itertools.count(100)
    for label in (0, 1, 2):
        for centre in rng.normal(size=(60, dim)):
            for _ in range(int(rng.integers(1, 12))):
                noise = rng.normal(size=dim) * rng.choice([0.0, 0.02, 0.1, 0.14, 0.2])
                out.append((next(ids), (centre * rng.uniform(0.5, 3) if rng.random() < 0.5 else centre) + noise, label))
    return [(i, v.astype(np.float32).tolist(), label) for i, v, label in out]


@pytest.mark.parametrize("bucket", [E.BUCKET, 8])
def test_against_brute_force(spark, bucket):
    rows = planted(np.random.default_rng(2))
    copy = rows[5]
    rows += [(9000 + i, copy[1], copy[2]) for i in range(30)] + [copy, copy, (3, copy[1], copy[2]), (4, copy[1], None), (5, copy[1], 7), (None, copy[1], copy[2])]
    rows += [(6, None, 0), (7, [0.0] * 64, 0), (8, [math.nan] + copy[1][1:], 0), (9, [None] + copy[1][1:], 0), (10, [math.inf] * 64, 0), (11, [], 0), (12, [1.0, 2.0], 0), (13, [2.0, 4.0], 0), (None, [5.0, -1.0], 0), (14, [3e38, 3e38], 1), (15, [1e-30, 1e-30], 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((tuple(r) for r in E.near_duplicates(df, bucket=bucket).collect()), key=str)
    want = brute([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows])
    assert [(r[0], r[1], r[2]) for r in got] == [(r[0], r[1], r[2]) for r in want]
    assert [r[3] for r in got] == [r[3] for r in want]
    assert sum(r[1] > 0 for r in got) > 300
    assert E.near_duplicates(df.limit(0)).count() == 0


def test_recall_at_the_limit(spark):
    """Pairs just above the limit and just below it."""
    rng = np.random.default_rng(9)
    a = rng.normal(size=(3000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    across = rng.normal(size=a.shape)
    across -= (across * a).sum(axis=1, keepdims=True) * a
    across /= np.linalg.norm(across, axis=1, keepdims=True)
    cos = np.where(np.arange(3000) < 2000, 0.9801, 0.9799)[:, None]
    b = cos * a + np.sqrt(1 - cos**2) * across
    rows = [(int(i), v.tolist(), 1) for i, v in enumerate(np.concatenate([a, b]))]
    got = E.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    linked = [r.vec_id for r in got.collect() if r.n_links]
    assert {i % 3000 for i in linked} <= set(range(2000)) and len(linked) >= 2 * 0.99 * 2000


def test_columns(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], "x", 5), (2, [2.0, 0.0], "x", 6), (2, [2.0, 0.0], "y", 6)], "vec_id long, embedding array<double>, label string, n long").selectExpr("n", "'q' as LABEL", "label", "embedding", "vec_id", "1 as class")
    assert sorted(tuple(r) for r in E.near_duplicates(df).collect()) == [(1, 1, 1, True), (2, 0, 2, True), (2, 1, 1, False)]
