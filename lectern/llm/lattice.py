"""Near-duplicate vectors by lattice hashing: cells of the lattice E8 in random projections, their neighbours, then the cosine.

Equal vectors of a label are one class, found by an aggregation; classes are linked among themselves. In each of several tables
a class is projected at random to K times eight dimensions and decoded to the nearest points of E8, which name its cell. It is put
into its own cell and asks at the cells of the nearest other points (PROBES for each eight dimensions). The projection is
scaled so that a pair at the limit lies well within a cell; K grows with the number of classes of a label, so that a class meets some
thousands of others at most by chance; the number of tables then follows from the share of pairs at the limit which one table finds
(measured on random pairs, seeded), so that RECALL of them are found by one table or more. Pairs that are closer are found
more often. Nothing is fitted to the data.

Where classes meet, the cosine is computed in double precision. A pair that meets in several cells counts in the first alone, which
both classes' lists of cells tell, so links are summed where they are found and are never listed; of the links of a cell a
spanning forest goes on to the components. A cell beyond BUCKET entries is dealt as pairs of blocks, so a tight group of
classes costs comparisons that grow with its square, over many tasks, but no rows.

Nulls: a vector that is null, empty, zero or holds null or non-finite numbers, or whose label is null, links with nothing. Vectors of
different lengths link with nothing of another length. Null ids are passed over as smallest id; a component of nulls only has none.
Repeated rows are vectors of their own. Empty tables give empty results. Further columns are not read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from math import ceil, log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import columns_of, join_hot, parts, tidy, written
from lectern.llm.components import connected_components

LEAST = 0.98
#: Neighbouring cells asked for each eight dimensions.
PROBES = 4
#: Of pairs at the limit this share is found.
RECALL = 0.999
#: Length of a projected difference at the limit, for each dimension; the lattice's points are the square root of two apart.
REACH = 0.175
#: By chance a class meets about this many others at most.
COMPANY = 2000
#: Share of pairs of random vectors that fall into one cell of eight dimensions, at LEAST (measured once, seeded).
CHANCE = 1 / 12_000
#: A cell with more entries is dealt as pairs of blocks.
BUCKET = 8192
#: Cells up to this size are compared in bulk.
SMALL = 32
SEED = 42

# ---------------------------------------------------------------- the lattice


def shortest() -> np.ndarray:
    """The 240 shortest vectors of E8, which lead to the neighbouring cells."""
    pairs = [(i, j, s, t) for i, j in itertools.combinations(range(8), 2) for s in (1, -1) for t in (1, -1)]
    out = np.zeros((len(pairs), 8))
    for row, (i, j, s, t) in zip(out, pairs, strict=True):
        row[i], row[j] = s, t
    signs = np.array(list(itertools.product((0.5, -0.5), repeat=8)))
    return np.concatenate([out, signs[(signs < 0).sum(axis=1) % 2 == 0]])


NEIGHBOURS = shortest()


def _even(x: np.ndarray) -> np.ndarray:
    """The nearest points with integer coordinates of even sum."""
    r = np.rint(x)
    off = x - r
    odd = np.flatnonzero(r.sum(axis=1) % 2)
    worst = np.abs(off[odd]).argmax(axis=1)
    r[odd, worst] += np.where(off[odd, worst] >= 0, 1, -1)
    return r


def decoded(x: np.ndarray) -> np.ndarray:
    """The nearest points of E8: all integers of even sum, or these shifted by one half."""
    a, b = _even(x), _even(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1))[:, None], a, b)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _name(points: np.ndarray, odd: np.ndarray) -> np.ndarray:
    """A number for each lattice point (last axis)."""
    return _mixed((np.rint(2 * points).astype(np.int64).view(np.uint64) * odd).sum(axis=-1, dtype=np.uint64))


def cells(unit: np.ndarray, base: np.ndarray, table: int, k: int, least: float = LEAST) -> np.ndarray:
    """Numbers of the own cell of each unit vector and of PROBES * k neighbouring ones, in a table. base: a number that keeps labels apart."""
    n, dim = unit.shape
    rng = np.random.default_rng([SEED, table, k, dim])
    scale = REACH / sqrt(2 * (1 - least))
    y = (unit @ rng.standard_normal((dim, 8 * k)) * scale + rng.uniform(0, 1, 8 * k)).reshape(n * k, 8)
    odd = rng.integers(0, 1 << 62, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    salt = rng.integers(0, 1 << 62, k, dtype=np.uint64)
    point = decoded(y)
    gain = ((y - point) @ NEIGHBOURS.T).reshape(n, k * 240)
    probes = PROBES * k
    best = np.argpartition(-gain, probes - 1, axis=1)[:, :probes]
    code, move = best // 240, best % 240
    own = _mixed(_name(point, odd).reshape(n, k) + salt)
    moved = np.take_along_axis(point.reshape(n, k, 8), code[:, :, None], axis=1) + NEIGHBOURS[move]
    other = _mixed(_name(moved, odd) + salt[code])
    total = own.sum(axis=1, dtype=np.uint64) + base + np.uint64(table) * np.uint64(0x9E3779B97F4A7C15)
    return _mixed(np.column_stack([total, total[:, None] - np.take_along_axis(own, code, axis=1) + other])).view(np.int64)


def meets(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether one of two classes is in its own cell where the other is or asks."""
    return (a[:, :1] == b).any(axis=1) | (b[:, :1] == a).any(axis=1)


def plan(classes: int, least: float = LEAST) -> tuple[int, int]:
    """How many times eight dimensions a cell has, and tables, for so many classes of a label."""
    k = max(1, ceil(log(max(1, classes * (1 + 2 * PROBES) / COMPANY)) / log(1 / CHANCE)))
    rng = np.random.default_rng(SEED)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    a = unit(rng.standard_normal((4000, 64)))
    across = rng.standard_normal(a.shape)
    b = least * a + sqrt(1 - least**2) * unit(across - (across * a).sum(axis=1, keepdims=True) * a)
    none = np.zeros(len(a), np.uint64)
    found = meets(cells(a, none, 0, k, least), cells(b, none, 0, k, least)).mean()
    return k, max(2, ceil(log(1 - RECALL) / log(1 - min(found, 0.9999))))


# ---------------------------------------------------------------- classes and their cells


def units(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors in double precision, filled with zeros to one width, and their lengths."""
    length = np.diff(np.asarray(vectors.offsets))
    out = np.zeros((len(length), int(length.max(initial=1))))
    out[np.arange(out.shape[1]) < length[:, None]] = np.asarray(vectors.flatten(), dtype=np.float64)
    out /= np.abs(out).max(axis=1, keepdims=True)  # so that squares don't overflow
    return out / np.linalg.norm(out, axis=1, keepdims=True), length


def coded(classes: DataFrame, k: int, tables: int, least: float) -> DataFrame:
    """The classes with the cells of all tables, own cell first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = 1 + PROBES * k
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                unit, length = units(batch.column("vec"))
                base = _mixed(np.asarray(batch.column("base")).view(np.uint64) + length.astype(np.uint64))
                out = np.zeros((len(unit), tables, each), np.int64)
                for dim in np.unique(length):
                    here = np.flatnonzero(length == dim)
                    for t in range(tables):
                        out[here, t] = cells(unit[here, :dim], base[here], t, k, least)
                offsets = pa.array(np.arange(len(unit) + 1) * (tables * each), pa.int32())
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(offsets, pa.array(out.ravel()))], [*batch.schema.names, "cells"])

    return classes.mapInArrow(tidy(run), classes.withColumn("cells", F.array(F.lit(0).cast("bigint"))).schema)


# ---------------------------------------------------------------- links


class Entries:
    """Entries of cells, a cell's rows together: class, label, weight, unit vector, all cells of the class, own (whether this is its own cell), block."""

    def __init__(self, batch: pa.RecordBatch, least: float, each: int):
        column = lambda name: np.asarray(batch.column(name))
        self.id, self.bucket, self.place, self.weight, self.block = column("class"), column("bucket"), column("place"), column("n"), column("block")
        self.across = column("across").astype(bool)
        self.label = np.asarray(batch.column("label").dictionary_encode().indices)
        self.unit, self.length = units(batch.column("vec"))
        self.cells = np.asarray(batch.column("cells").flatten()).reshape(len(self.id), -1, each)
        self.table, self.own = self.place // each, self.place % each == 0
        self.cell = self.cells[np.arange(len(self.id)), self.table, self.place % each]
        self.least = least

    def candidates(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which pairs are to be compared: one in its own cell, labels and lengths equal; of two blocks one from each."""
        good = (self.own[i] | self.own[j]) & (self.label[i] == self.label[j]) & (self.length[i] == self.length[j]) & (self.id[i] != self.id[j])
        return good & (~self.across[i] | (self.block[i] != self.block[j]))

    def first(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which pairs meet here for the first time: in no table before, and in this one in the smaller of the cells where they do."""
        a, b, table, here = self.cells[i], self.cells[j], self.table[i], self.cell[i]
        out = np.ones(len(i), bool)
        for t in range(a.shape[1]):
            out &= ~((t < table) & meets(a[:, t], b[:, t]))
        at = np.arange(len(i))
        a, b = a[at, table], b[at, table]
        of_a, of_b = (a[:, :1] == b).any(axis=1), (b[:, :1] == a).any(axis=1)
        least = np.where(of_a & of_b, np.minimum(a[:, 0], b[:, 0]), np.where(of_a, a[:, 0], b[:, 0]))
        return out & (here == least)

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of the linked pairs, some at a time."""
        n = len(self.id)
        edge = np.flatnonzero(np.append(True, self.bucket[1:] != self.bucket[:-1])) if n else np.zeros(0, np.int64)
        size = np.diff(np.append(edge, n))
        which = np.repeat(np.arange(len(edge)), size)
        small = size[which] <= SMALL
        for lag in range(1, min(SMALL, int(size.max(initial=0)))):
            i = np.flatnonzero((which[lag:] == which[:-lag]) & small[lag:])
            i = i[self.candidates(i, i + lag)]
            for at in range(0, len(i), 1 << 15):
                x = i[at : at + (1 << 15)]
                x = x[(self.unit[x] * self.unit[x + lag]).sum(axis=1) >= self.least]
                yield x, x + lag
        for k in np.flatnonzero(size > SMALL).tolist():
            base, stop = int(edge[k]), int(edge[k] + size[k])
            for at in range(base, stop, 256):
                close = self.unit[at : at + 256] @ self.unit[base:stop].T >= self.least - 1e-9
                i, j = np.nonzero(close[: stop - at])
                i, j = i + at, j + base
                i, j = i[i < j], j[i < j]
                good = self.candidates(i, j)
                i, j = i[good], j[good]
                for x in range(0, len(i), 1 << 15):
                    a, b = i[x : x + (1 << 15)], j[x : x + (1 << 15)]
                    sure = (self.unit[a] * self.unit[b]).sum(axis=1) >= self.least  # one law for small cells and large
                    yield a[sure], b[sure]

    def found(self) -> pa.RecordBatch:
        """Rows (a, null, n): class a links to n more vectors; and (a, b, null): they are connected."""
        more = np.zeros(len(self.id), np.int64)
        up = np.arange(len(self.id))
        for i, j in self.pairs():
            new = self.first(i, j)
            i, j = i[new], j[new]
            np.add.at(more, i, self.weight[j])
            np.add.at(more, j, self.weight[i])
            while len(i):  # the smaller root stays
                a, b = up[i], up[j]
                while (a != up[a]).any() or (b != up[b]).any():
                    a, b = up[a], up[b]
                apart = a != b
                i, j, a, b = i[apart], j[apart], a[apart], b[apart]
                np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))
        while (up != up[up]).any():
            up = up[up]
        linked, joined = np.flatnonzero(more), np.flatnonzero(up != np.arange(len(up)))
        none = lambda n: pa.nulls(n, pa.int64())
        whole = lambda x, y: pa.concat_arrays([x, y])
        a = whole(pa.array(self.id[linked]), pa.array(self.id[joined]))
        return pa.RecordBatch.from_arrays([a, whole(none(len(linked)), pa.array(self.id[up[joined]])), whole(pa.array(more[linked]), none(len(joined)))], ["a", "b", "n"])


def met(classes: DataFrame, each: int, least: float, bucket: int = BUCKET) -> DataFrame:
    """found() of all cells of the coded classes."""
    index = classes.select("class", "label", "n", "vec", "cells", F.posexplode("cells").alias("place", "cell"))
    count = classes.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count("*").alias("_n"))
    hot = written(count.where(F.col("_n") > bucket).select("cell", F.ceil(F.col("_n") / (bucket / 2)).cast("int").alias("blocks")), "hot-cells")
    if hot.limit(1).count():
        own = F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")
        other = F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1)))
        index = index.join(hot, "cell", "left").withColumn("block", F.coalesce(own, F.lit(0))).withColumn("_o", other)
        index = index.withColumn("across", F.col("_o") != F.col("block")).withColumn("bucket", F.xxhash64("cell", F.least("block", "_o"), F.greatest("block", "_o"))).drop("blocks", "_o")
    else:
        index = index.select("*", F.lit(0).alias("block"), F.lit(False).alias("across"), F.xxhash64("cell").alias("bucket"))
    dealt = index.drop("cell").repartition(parts(classes), "bucket").sortWithinPartitions("bucket")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            bucket = np.asarray(batch.column("bucket"))
            cut = int(np.searchsorted(bucket, bucket[-1], "left")) if len(bucket) else 0
            if cut:
                yield Entries(pa.concat_batches([*held, batch.slice(0, cut)]), least, each).found()
                held = []
            held.append(batch.slice(cut))
        if held and sum(b.num_rows for b in held):
            yield Entries(pa.concat_batches(held), least, each).found()

    return dealt.mapInArrow(tidy(run), "a bigint, b bigint, n bigint")


def near_duplicates(vectors: DataFrame, least: float = LEAST, bucket: int = BUCKET) -> DataFrame:
    """vec_id, n_links (other vectors linked), component_id (the smallest vec_id reachable) and kept (whether it is that one)."""
    plain = columns_of(vectors, "vec_id", "embedding", "label").toDF("vec_id", "vec", "label")
    sound = F.coalesce(F.forall("vec", lambda x: F.coalesce((x == x) & ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists("vec", lambda x: x != 0), F.lit(False)) & F.col("label").isNotNull()
    rows = written(plain.withColumn("_sound", sound).withColumn("label", F.col("label").cast("string")).withColumn("_h", F.when(F.col("_sound"), F.xxhash64("label", "vec"))), "vectors")
    good = rows.where("_sound")
    classes = written(good.groupBy("_h", "label", "vec").agg(F.min("vec_id").alias("first"), F.count("*").alias("n")).withColumn("class", F.monotonically_increasing_id()), "vector-classes")
    most = classes.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    k, tables = plan(most, least)
    in_cells = written(coded(classes.select("class", "label", "n", "vec", F.xxhash64("label").alias("base")), k, tables, least), "vector-cells")
    found = written(met(in_cells, 1 + PROBES * k, least, bucket), "vector-links")
    links = found.where("b is null").groupBy(F.col("a").alias("class")).agg(F.sum("n").alias("_links"))
    nodes = connected_components(found.where("b is not null").select("a", "b")).select(F.col("node").alias("class"), F.col("label").alias("_root"))
    degree = (F.coalesce("_links", F.lit(0)) + F.col("n") - 1).alias("n_links")
    member = classes.join(nodes, "class", "left").join(links, "class", "left").select("_h", F.col("label").alias("_label"), F.col("vec").alias("_vec"), "first", degree, "_root")
    member = written(member, "vector-members")
    smallest = written(member.where("_root is not null").groupBy("_root").agg(F.min("first").alias("component_id")), "vector-least")
    each = member.where("_root is null").withColumn("component_id", F.col("first")).unionByName(member.where("_root is not null").join(smallest, "_root"))
    each = written(each.select("_h", "_label", "_vec", "n_links", "component_id"), "vector-components")
    counts = classes.groupBy("_h").agg(F.sum("n").alias("n"))
    joined = join_hot(good.select("vec_id", "vec", "label", "_h"), each, "_h", counts, "inner").where((F.col("vec") == F.col("_vec")) & (F.col("label") == F.col("_label")))
    alone = rows.where("not _sound").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.select("vec_id", "n_links", "component_id").unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


SQL = f"""
with recursive vectors as (select row_number() over () as row, vec_id, cast(embedding as double[]) as e, label from embeddings),
links as (select a.row as a, b.row as b from vectors a join vectors b on a.label = b.label and a.row <> b.row where list_cosine_similarity(a.e, b.e) >= {LEAST}),
reached as (select row, row as other from vectors union select r.row, l.b from reached r join links l on l.a = r.other),
degrees as (select a, count(*) as n from links group by a)
select v.vec_id, coalesce(any_value(d.n), 0) as n_links, min(o.vec_id) as component_id, v.vec_id = min(o.vec_id) as kept
from vectors v join reached r on r.row = v.row join vectors o on o.row = r.other left join degrees d on d.a = v.row group by v.row, v.vec_id
"""
