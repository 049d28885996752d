"""Near-duplicates by 64-bit SimHash fingerprints at most four bits apart.

A fingerprint holds the majority of the XXH64 bits of a text's four-word shingles. Equal fingerprints are one
class; classes are linked among themselves, so copies cost nothing more.

Candidates: the 64 bits are cut into a ring of m segments. Of pairs within TAU bits, m - TAU segments are equal,
so classes meet under each choice of m - TAU segments; m grows with the number of classes, so that a bucket
stays small. Pigeonring then prunes: somewhere on the ring a chain of consecutive segments must begin whose
cumulative differences stay within their share of TAU (l segments: l * TAU / m) at each of its first CHAIN
steps. Only pairs with such a chain get the full Hamming check. All pairs within TAU have one, so no link is
lost. Of a bucket's links a spanning forest goes on, which keeps what is connected.

A bucket beyond BUCKET classes is dealt as pairs of blocks. Components then come from lectern.llm.components.

Very long texts: all shingles count, some at a time. Nulls: a null text has no words and fingerprint zero, linked like any other; null ids are ignored as smallest
id (a component of nulls only has none). Repeated rows are alike. Empty tables give empty results. Further
columns are not read, except by deduplicated(), which keeps them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import Words, as_text, byte_table, columns_of, join_hot, parts, place_of, ragged, slices, tidy, written
from lectern.llm.components import connected_components

SHINGLE = 4
SEED = 42
TAU = 4
CHAIN = 3
BUCKET = 20_000
#: Buckets up to this size are paired in bulk.
SMALL = 48

TABLE = byte_table(lambda b: b == 32 or 9 <= b <= 13, lower=True)


def fingerprints(words: Words) -> np.ndarray:
    """The fingerprint of each text, as uint64."""
    n = words.counts()
    out = np.zeros(len(n), np.uint64)
    if not len(words):
        return out
    size = words.end - words.start
    stop = np.cumsum(size + 1)
    begin = stop - size - 1
    joined = np.frombuffer(words.buf + b" ", np.uint8)[ragged(words.start, size + 1)]
    joined[stop - 1] = 32
    data = memoryview(joined.tobytes())
    docs = np.flatnonzero(n)
    many = np.maximum(1, n[docs] - SHINGLE + 1)
    first = ragged(words.first[:-1][docs], many)
    last = np.repeat(words.first[:-1][docs] + np.minimum(n[docs], SHINGLE) - 1, many) + first - np.repeat(words.first[:-1][docs], many)
    digest = xxhash.xxh64_intdigest
    hashed = np.fromiter((digest(data[s:e], SEED) for s, e in zip(begin[first].tolist(), (stop[last] - 1).tolist(), strict=True)), np.uint64, len(first))
    at = 0
    for doc, k in zip(docs.tolist(), many.tolist(), strict=True):
        total = np.zeros(64, np.int64)
        for i in range(at, at + k, 1 << 16):  # a long text's bits are not held all at once
            part = hashed[i : min(at + k, i + (1 << 16))]
            total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[doc] = np.packbits(2 * total > k, bitorder="little").view(np.uint64)[0]
        at += k
    return out


def fingerprinted(docs: DataFrame) -> DataFrame:
    """docs, columns renamed c0, c1, ..., with _fp (its 64 bits as a signed number)."""
    names = docs.columns
    text = f"c{place_of(docs, 'text')}"
    df = docs.toDF(*[f"c{i}" for i in range(len(names))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            fp = fingerprints(Words(as_text(batch.column(text)), TABLE))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fp.view(np.int64))], [*batch.schema.names, "_fp"])

    return df.mapInArrow(tidy(run), df.withColumn("_fp", F.lit(0).cast("bigint")).schema)


# ---------------------------------------------------------------- links


def ring(m: int) -> list[int]:
    """Masks of m consecutive segments of nearly equal width."""
    cut = [64 * i // m for i in range(m + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cut, cut[1:], strict=False)]


def segments_for(classes: int, tau: int = TAU) -> int:
    """So many that a bucket of m - tau equal segments holds about one class or fewer, as far as m = tau + 4."""
    m = tau + 1
    while m < tau + 4 and (64 * (m - tau) / m) < np.log2(max(2, classes)):
        m += 1
    return m


def chains(x: np.ndarray, m: int, tau: int = TAU, length: int = CHAIN) -> np.ndarray:
    """Whether the differences x have a viable chain on the ring."""
    d = [np.bitwise_count(x & np.uint64(mask)).astype(np.int16) for mask in ring(m)]
    found = np.zeros(len(x), bool)
    for i in range(m):
        total, viable = np.zeros(len(x), np.int16), np.ones(len(x), bool)
        for step in range(1, min(length, m) + 1):
            total = total + d[(i + step - 1) % m]
            viable &= m * total <= step * tau
        found |= viable
    return found


def linked(x: np.ndarray, m: int, tau: int = TAU) -> np.ndarray:
    """Whether differences x are links: the chain first, the full check on what it leaves."""
    out = chains(x, m, tau)
    at = np.flatnonzero(out)
    out[at] = np.bitwise_count(x[at]) <= tau
    return out


class Forest:
    """Union-find over places 0 to n - 1; the smaller root stays."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def forest(fps: np.ndarray, m: int, tau: int = TAU) -> list[tuple[int, int]]:
    """Places of a spanning forest of one bucket's links.

    Pivots are compared with all others; what lies near one needs no pivot of its own. What is outside the
    largest component then is compared too. Pairs left out are within that component, so nothing is lost, and a
    tight group costs few pivots instead of all its pairs.
    """
    n, out = len(fps), []
    trees, free = Forest(n), np.ones(n, bool)
    done = np.zeros(n, bool)

    def against_all(i: int) -> np.ndarray:
        near = np.flatnonzero(linked(fps ^ fps[i], m, tau))
        out.extend((i, j) for j in near.tolist() if j != i and trees.join(i, j))
        done[i] = True
        return near

    for i in range(n):
        if free[i]:
            free[against_all(i)] = False
    roots = np.array([trees.root(i) for i in range(n)])
    if (roots == roots[0]).all():
        return out
    largest = np.bincount(roots).argmax()
    for i in np.flatnonzero((roots != largest) & ~done).tolist():
        against_all(i)
    return out


def bucket_links(group: np.ndarray, fps: np.ndarray, m: int, tau: int = TAU) -> np.ndarray:
    """Pairs (a, b) of fingerprints: a spanning forest of each bucket. group: equal for a bucket's rows, which lie together."""
    n = len(fps)
    edge = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if n else np.zeros(0, np.int64)
    size = np.diff(np.append(edge, n))
    which = np.repeat(np.arange(len(edge)), size)
    small = (size[which] <= SMALL) if n else np.zeros(0, bool)
    a, b = [], []
    for lag in range(1, min(SMALL, int(size.max(initial=0)))):
        at = np.flatnonzero((which[lag:] == which[:-lag]) & small[lag:])
        at = at[linked(fps[at] ^ fps[at + lag], m, tau)] if len(at) else at
        a += at.tolist()
        b += (at + lag).tolist()
    trees = Forest(n if a else 0)
    pairs = [(i, j) for i, j in zip(a, b, strict=True) if trees.join(i, j)]
    for k in np.flatnonzero(size > SMALL).tolist():
        base = int(edge[k])
        pairs += [(base + i, base + j) for i, j in forest(fps[base : base + size[k]], m, tau)]
    return fps[np.array(pairs, np.int64).reshape(-1, 2)]


def links(classes: DataFrame, count: int, tau: int = TAU, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) between fingerprints of the column fp (distinct; count of them) that connect all within tau bits."""
    m = segments_for(count, tau)
    masks = [sum(ring(m)[i] for i in choice) for choice in combinations(range(m), m - tau)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    keys = F.array(*[F.col("fp").bitwiseAND(F.lit(signed(x)).cast("bigint")) for x in masks])
    index = classes.select("fp", F.posexplode(keys).alias("choice", "key"))
    hot = written(index.groupBy("choice", "key").agg(F.count("*").alias("n")).where(F.col("n") > bucket).select("choice", "key", F.ceil(F.col("n") / (bucket / 2)).cast("int").alias("blocks")), "hot-buckets")
    if hot.limit(1).count():
        index = index.join(hot, ["choice", "key"], "left")
        own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
        pairs = F.when(F.col("blocks").isNull(), F.array(F.struct(F.lit(0).alias("x"), F.lit(0).alias("y")))).otherwise(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(own, j).alias("x"), F.greatest(own, j).alias("y"))))
        index = index.withColumn("_p", F.explode(pairs)).select("fp", "choice", "key", "_p.x", "_p.y")
    else:
        index = index.select("fp", "choice", "key", F.lit(0).alias("x"), F.lit(0).alias("y"))
    dealt = index.select("fp", F.xxhash64("choice", "key", "x", "y").alias("bucket")).repartition(parts(classes), "bucket").sortWithinPartitions("bucket", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left_fp, left_b = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            fp = np.concatenate([left_fp, np.asarray(batch.column("fp")).view(np.uint64)])
            b = np.concatenate([left_b, np.asarray(batch.column("bucket"))])
            whole = int(np.searchsorted(b, b[-1], "left")) if len(b) else 0
            yield _edges(bucket_links(b[:whole], fp[:whole], m, tau))
            left_fp, left_b = fp[whole:], b[whole:]
        yield _edges(bucket_links(left_b, left_fp, m, tau))

    return dealt.mapInArrow(run, "a bigint, b bigint")


def _edges(pairs: np.ndarray) -> pa.RecordBatch:
    pairs = pairs.view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def components(rows: DataFrame) -> DataFrame:
    """rows, a written table with doc_id and _fp, with component_id: the smallest doc_id reachable by links."""
    classes = written(rows.groupBy(F.col("_fp").alias("fp")).agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "classes")
    found = connected_components(links(classes, classes.count()))
    member = written(classes.join(found, classes["fp"] == found["node"], "left").select("fp", "first", "label"), "members")
    least = written(member.where("label is not null").groupBy("label").agg(F.min("first").alias("component_id")), "least")
    alone = member.where("label is null").select(F.col("fp").alias("_fp"), F.col("first").alias("component_id"))
    grouped = member.where("label is not null").join(least, "label").select(F.col("fp").alias("_fp"), "component_id")
    ids = written(alone.unionByName(grouped), "class-components")
    return join_hot(rows, ids, "_fp", classes.select(F.col("fp").alias("_fp"), "n"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint and component_id of each document."""
    plain = columns_of(docs, "doc_id", "text")
    rows = written(fingerprinted(plain).select(F.col("c0").alias("doc_id"), "_fp"), "fingerprints")
    return components(rows).select("doc_id", F.lpad(F.lower(F.hex("_fp")), 16, "0").alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame) -> DataFrame:
    """One document of each component, the one with the smallest doc_id, with its columns."""
    names = docs.columns
    table = written(fingerprinted(docs).withColumn("_key", F.monotonically_increasing_id()), "fingerprinted")
    rows = table.select(F.col(f"c{place_of(docs, 'doc_id')}").alias("doc_id"), "_fp", "_key")
    kept = components(rows).groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("_fp")).alias("_alone")).agg(F.min_by("_key", F.struct(F.col("doc_id").isNull(), "doc_id", "_key")).alias("_key"))
    return table.join(kept.select("_key"), "_key", "left_semi").select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)])
