"""One document of each group of near copies: texts whose sets of five-word shingles are alike by LEAST (Jaccard) or more, and what
such links connect.

No link is left out. Texts with equal sets are one class. Two sets alike by LEAST, of m and n shingles, differ in at most
far(m + n) of them, so of more parts than that, into which hashes deal all shingles, one at least is equal in both. How many
parts follows from a group of sizes (LIMITS); a set is cut for its own group and the one above, as sets that are alike lie in the
same or in neighbouring ones. Where a set leaves so many parts empty that equal ones may all be, its prefix is added: the smallest
hashes, of which sets alike by LEAST share one. Classes that share no part (or prefix) with another are settled.

Of the others most links are found by fingerprints first, which lists few pairs where many texts are alike. A text's fingerprint is
a SimHash of BITS bits over its different shingles. Two sets that are alike by LEAST differ in about SHARE of the bits, so classes
meet where some bits, drawn at random for each of several tables, are equal: so many bits that a class meets about COMPANY
others by chance, and so many tables that of pairs at LEAST the share RECALL meets (closer ones more often). Of those that meet, the
pigeonring prunes: the fingerprint is a ring of four words, and some chain of consecutive words must stay within its share of the
limit REACH at each of its steps; what is left gets the full check. Of a bucket's pairs a minimum spanning forest goes on, and the
sets themselves decide: each pair is kept if the Jaccard similarity of its sets is LEAST or more.

Then the classes that share a part and are not connected yet are compared, all of them. Before sets are compared, sizes and a bitmap
of WIDE bits (parities of shingles by hash), in which two sets differ in no more bits than shingles, rule out most pairs; of long
sets, in which more bits may differ than these have, a bitmap that grows with the set. So sets travel for few pairs but links.

A bucket beyond BUCKET classes is dealt as pairs of blocks. Sets are worked out only for the classes that have pairs. Texts stay
where they are: up to FEW rows to be looked up or left out are broadcast by key, more join by a shuffle.

Nulls: a null text has no words; texts without words are alike. Of a group the row with the smallest doc_id stays, null ids last.
Very long texts: fingerprints look at some shingles at a time; sets are held as numbers of 8 bytes. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log, log2, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import Words, as_text, parts, place_of, ragged, slices, tidy, written
from lectern.llm.components import connected_components
from lectern.llm.decontamination import hashes
from lectern.llm.simhash import TABLE, Forest

SHINGLE = 5
LEAST = 0.8
BITS = 256
#: Share of the bits in which sets alike by LEAST differ: the angle between them over pi.
SHARE = float(np.arccos(2 * LEAST / (1 + LEAST)) / np.pi)
#: Pairs that differ in more bits are not looked at: two standard deviations beyond.
REACH = int(BITS * SHARE + 2 * sqrt(BITS * SHARE * (1 - SHARE)))
RECALL = 0.97
COMPANY = 8
BUCKET = 4096
SMALL = 32
SEED = 42
#: Bits of the parities.
WIDE = 1024
#: Keys that are sent to all tasks.
FEW = 2_000_000
#: LEAST in thousandths.
MILLE = round(1000 * LEAST)


def far(total: int) -> int:
    """In how many shingles two sets of `total` together differ at most, if they are alike by LEAST."""
    return total * (1000 - MILLE) // (1000 + MILLE)


def _limits() -> np.ndarray:
    out = [0, 1]
    while out[-1] < 1 << 31:
        out.append(max(out[-1] + 1, out[-1] * 1000 // MILLE))
    return np.array(out)


#: The largest size of each group: a set has none alike beyond the next group.
LIMITS = _limits()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(words: Words) -> Iterator[np.ndarray]:
    """Of each text the different hashes of its shingles, in order; fewer than five words are one shingle."""
    n = words.counts()
    h = _mixed(hashes(words)) if len(words) else np.zeros(0, np.uint64)
    for first, k in zip(words.first[:-1].tolist(), n.tolist(), strict=True):
        w = h[first : first + k]
        many = min(k, SHINGLE)
        total = np.zeros(max(0, k - many + 1) if k else 0, np.uint64)
        for i in range(many):
            total = _mixed(total * np.uint64(0x9E3779B97F4A7C15) + w[i : i + len(total)] + np.uint64(1))
        yield np.unique(total)


def fingerprint(shingles: np.ndarray) -> bytes:
    """BITS bits: each is set if it is in the hashes of over half the shingles."""
    total = np.zeros(BITS, np.int64)
    for at in range(0, len(shingles), 1 << 13):
        some = shingles[at : at + (1 << 13), None] * np.uint64(0xD6E8FEB86659FD93) + (np.arange(1, BITS // 64 + 1, dtype=np.uint64) << np.uint64(32))
        total += np.unpackbits(_mixed(some).view(np.uint8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * total > len(shingles)).tobytes()


def parity(shingles: np.ndarray, wide: int = WIDE) -> np.ndarray:
    """`wide` bits as numbers: whether the number of shingles that fall to a bit is odd."""
    odd = np.bincount((shingles % np.uint64(wide)).astype(np.int64), minlength=wide) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def long_parity(shingles: np.ndarray) -> np.ndarray:
    """The parities by twice as many bits as shingles or more, a power of two."""
    return parity(shingles, max(64, 1 << (2 * len(shingles) - 1).bit_length()))


def odd_bits(x: np.ndarray, y: np.ndarray) -> int:
    """In how many bits two long parities differ, at the shorter one's width: half of a bitmap added to the other is that of half the width."""
    wide = min(len(x), len(y))
    x, y = (np.bitwise_xor.reduce(v.reshape(-1, wide), axis=0) for v in (x, y))
    return int(np.bitwise_count((x ^ y).view(np.uint64)).sum())


ODD = [f"_p{i}" for i in range(WIDE // 64)]


def marked(docs: DataFrame) -> DataFrame:
    """docs, columns renamed c0, c1, ..., with _class (a digest of the set of shingles), _fp, _n (its size) and its parity."""
    text = f"c{place_of(docs, 'text')}"
    df = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    more = {"_class": "binary", "_fp": "binary", "_n": "int"} | dict.fromkeys(ODD, "bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            digest, fp, size, odd = [], [], [], []
            for s in shingle_sets(Words(as_text(batch.column(text)), TABLE)):
                digest.append(xxhash.xxh3_128_digest(s.tobytes()))
                fp.append(fingerprint(s))
                size.append(len(s))
                odd.append(parity(s))
            found = [pa.array(digest, pa.binary()), pa.array(fp, pa.binary()), pa.array(size, pa.int32()), *(pa.array(p) for p in np.ascontiguousarray(np.array(odd).T))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *found], [*batch.schema.names, *more])

    return df.mapInArrow(tidy(run), df.withColumns({k: F.lit(None).cast(v) for k, v in more.items()}).schema)


# ---------------------------------------------------------------- what classes share


def signatures(s: np.ndarray) -> np.ndarray:
    """Numbers of a set (different hashes in order), one of which any other set alike by LEAST has too."""
    n = len(s)
    most = n * 1000 // MILLE
    if not far(n + most):
        return np.zeros(0, np.uint64)
    high, group, out, sure = s >> np.uint64(32), int(np.searchsorted(LIMITS, n)), [], True
    for table in (group, group + 1):
        top = int(LIMITS[table])
        # more than can differ, and some to spare, as others are empty
        many = far(2 * top) + 2 + top // 32
        part = (high * np.uint64(many)) >> np.uint64(32)
        edge = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        out.append(_mixed(np.add.reduceat(s, edge) + _mixed(part[edge] + (np.uint64(table) << np.uint64(40)))))
        sure &= len(edge) > far(n + min(top, most))
    if not sure:
        out.append(_mixed(s[: n - -(-n * MILLE // 1000) + 1] ^ np.uint64(0xA5A5A5A5A5A5A5A5)))
    return np.concatenate(out)


def shared_keys(rows: DataFrame) -> DataFrame:
    """key and c of the signatures that several classes have. rows: c (a number for each class) and text."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            c = np.asarray(batch.column("c"))
            once = np.sort(np.unique(c, return_index=True)[1])
            found = [signatures(s) for s in shingle_sets(Words(as_text(batch.column("text").take(pa.array(once))), TABLE))]
            of = np.repeat(c[once], [len(k) for k in found])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), pa.array(of)], ["key", "c"])

    def several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, c, had = np.zeros(0, np.int64), np.zeros(0, np.int64), False  # the last row so far, and whether its key had one before
        for batch in batches:
            key, c = np.append(key, np.asarray(batch.column("key"))), np.append(c, np.asarray(batch.column("c")))
            new = np.append(True, (key[1:] != key[:-1]) | (c[1:] != c[:-1])) if len(key) else np.zeros(0, bool)
            key, c = key[new], c[new]
            same = key[1:] == key[:-1]
            good = np.append(had, same) | np.append(same, False) if len(key) else np.zeros(0, bool)
            if len(key):
                had = bool(good[-1])
                yield pa.RecordBatch.from_arrays([pa.array(key[:-1][good[:-1]]), pa.array(c[:-1][good[:-1]])], ["key", "c"])
                key, c = key[-1:], c[-1:]
        if had:
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(c)], ["key", "c"])

    dealt = rows.mapInArrow(tidy(signed), "key bigint, c bigint").repartition(parts(rows), "key").sortWithinPartitions("key", "c")
    return dealt.mapInArrow(tidy(several), "key bigint, c bigint")


def may_link(a: str, b: str) -> Column:
    """Whether sizes and parities of two classes, in columns that begin with a and b, allow that they are alike."""
    differ = sum((F.bit_count(F.col(a + p).bitwiseXOR(F.col(b + p))) for p in ODD), F.lit(0))
    return (1000 + MILLE) * F.greatest(differ, F.abs(F.col(f"{a}_n") - F.col(f"{b}_n"))) <= (1000 - MILLE) * (F.col(f"{a}_n") + F.col(f"{b}_n"))


def facts(classes: DataFrame, name: str) -> DataFrame:
    """What may_link needs, by node `name`."""
    return classes.select(F.col("node").alias(name), *[F.col(k).alias(name + k) for k in ("_n", *ODD)])


def possible(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) that sizes and parities allow."""
    return pairs.join(facts(classes, "a"), "a").join(facts(classes, "b"), "b").where(may_link("a", "b")).select("a", "b")


def apart(shared: DataFrame, member: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """All pairs (a, b) of nodes that share a key, have not the same label and may be alike by sizes and parities.
    shared: key and c; member: c, node, label, _n and the parities."""
    rows = shared.join(member.select("c", "node", "label"), "c").select("key", "node", "label")
    of = rows.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("k")).where("low <> high")
    blocks = F.when(F.col("k") > bucket, F.ceil(F.col("k") / (bucket / 2))).otherwise(1).cast("int").alias("blocks")
    rows = written(rows.join(of.select("key", blocks), "key"), "mixed-keys")
    own, each = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    full = rows.withColumn("own", own).withColumn("each", each)
    at = lambda name, x, y: full.join(facts(member, name), F.col("node") == F.col(name)).select("key", F.col("own").alias(x), F.col("each").alias(y), F.col("label").alias(f"{name}_l"), name, *[name + k for k in ("_n", *ODD)])
    pairs = at("a", "x", "y").join(at("b", "y", "x"), ["key", "x", "y"]).where((F.col("a_l") < F.col("b_l")) & may_link("a", "b"))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


# ---------------------------------------------------------------- candidates


def plan(classes: int) -> tuple[int, int]:
    """Bits of a key, and tables."""
    bits = max(8, ceil(log2(max(1, classes / COMPANY))))
    return bits, ceil(log(1 - RECALL) / log(1 - (1 - SHARE) ** bits))


def keys_of(fps: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """fps: rows of bytes. A key for each table."""
    one = np.unpackbits(fps, axis=1)
    out = np.zeros((len(fps), tables), np.uint64)
    for t in range(tables):
        pick = np.random.default_rng([SEED, t]).permutation(BITS)[:bits]
        key = np.zeros(len(fps), np.uint64)
        for b in pick.tolist():
            key = (key << np.uint64(1)) | one[:, b]
        out[:, t] = _mixed(key * np.uint64(2) + np.uint64(1) + (np.uint64(t) << np.uint64(48)))
    return out.view(np.int64)


def distances(x: np.ndarray, reach: int = REACH) -> np.ndarray:
    """Bits set in rows of four words, BITS + 1 for those that no viable chain shows to be within reach."""
    d = np.bitwise_count(x).astype(np.int16)
    m = d.shape[1]
    found = np.zeros(len(d), bool)
    for i in range(m):
        total, viable = np.zeros(len(d), np.int16), np.ones(len(d), bool)
        for step in range(1, m):
            total = total + d[:, (i + step - 1) % m]
            viable &= m * total <= step * reach
        found |= viable
    out = np.full(len(d), BITS + 1, np.int16)
    out[found] = d[found].sum(axis=1)
    out[out > reach] = BITS + 1
    return out


def spanning(fp: np.ndarray, side: np.ndarray, across: bool) -> list[tuple[int, int]]:
    """A minimum spanning forest of the pairs within reach (by Prim); across: of pairs between the two sides alone."""
    n = len(fp)
    near, via, out = np.full(n, BITS + 1, np.int16), np.zeros(n, np.int64), []
    free = np.ones(n, bool)
    i = 0
    for _ in range(n):
        free[i] = False
        d = distances(fp ^ fp[i])
        if across:
            d[side == side[i]] = BITS + 1
        closer = free & (d < near)
        near[closer], via[closer] = d[closer], i
        left = np.flatnonzero(free)
        if not len(left):
            break
        i = int(left[near[left].argmin()])
        if near[i] <= REACH:
            out.append((int(via[i]), i))
    return out


def forests(bucket: np.ndarray, fp: np.ndarray, side: np.ndarray, across: np.ndarray) -> np.ndarray:
    """Pairs of places; a bucket's rows lie together."""
    n = len(bucket)
    edge = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if n else np.zeros(0, np.int64)
    size = np.diff(np.append(edge, n))
    which = np.repeat(np.arange(len(edge)), size)
    small = size[which] <= SMALL
    a, b, d = [], [], []
    for lag in range(1, min(SMALL, int(size.max(initial=0)))):
        i = np.flatnonzero((which[lag:] == which[:-lag]) & small[lag:])
        i = i[~across[i] | (side[i] != side[i + lag])]
        k = distances(fp[i] ^ fp[i + lag])
        good = k <= REACH
        a.append(i[good])
        b.append(i[good] + lag)
        d.append(k[good])
    pairs = []
    if a:
        a, b, d = (np.concatenate(x) for x in (a, b, d))
        trees, order = Forest(n if len(a) else 0), np.argsort(d, kind="stable")
        pairs = [(i, j) for i, j in zip(a[order].tolist(), b[order].tolist(), strict=True) if trees.join(i, j)]
    for k in np.flatnonzero(size > SMALL).tolist():
        here = slice(int(edge[k]), int(edge[k] + size[k]))
        pairs += [(here.start + i, here.start + j) for i, j in spanning(fp[here], side[here], bool(across[here.start]))]
    return np.array(pairs, np.int64).reshape(-1, 2)


def candidates(classes: DataFrame, count: int, bucket: int = BUCKET) -> DataFrame:
    """Pairs (a, b) of nodes, a < b, that connect all classes which lie within reach and meet. classes: node and fp."""
    bits, tables = plan(count)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.frombuffer(b"".join(batch.column("fp").to_pylist()), np.uint8).reshape(-1, BITS // 8)
            offsets = pa.array(np.arange(len(fps) + 1) * tables, pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(offsets, pa.array(keys_of(fps, bits, tables).ravel()))], [*batch.schema.names, "keys"])

    index = classes.mapInArrow(keyed, "node bigint, fp binary, keys array<bigint>").select("node", "fp", F.explode("keys").alias("key"))
    count_of = index.groupBy("key").agg(F.count("*").alias("n"))
    hot = written(count_of.where(F.col("n") > bucket).select("key", F.ceil(F.col("n") / (bucket / 2)).cast("int").alias("blocks")), "hot-keys")
    if hot.limit(1).count():
        side = F.coalesce(F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"), F.lit(0))
        other = F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1)))
        index = index.join(hot, "key", "left").withColumn("side", side).withColumn("_o", other)
        index = index.select("node", "fp", "side", (F.col("_o") != F.col("side")).alias("across"), F.xxhash64("key", F.least("side", "_o"), F.greatest("side", "_o")).alias("bucket"))
    else:
        index = index.select("node", "fp", F.lit(0).alias("side"), F.lit(False).alias("across"), F.col("key").alias("bucket"))
    dealt = index.repartition(parts(classes), "bucket").sortWithinPartitions("bucket", "node")

    def some(batch: pa.RecordBatch) -> pa.RecordBatch:
        node = np.asarray(batch.column("node"))
        fp = np.frombuffer(b"".join(batch.column("fp").to_pylist()), np.uint64).reshape(-1, BITS // 64)
        pairs = node[forests(np.asarray(batch.column("bucket")), fp, np.asarray(batch.column("side")), np.asarray(batch.column("across")).astype(bool))]
        return pa.RecordBatch.from_arrays([pa.array(pairs.min(axis=1, initial=1 << 62)), pa.array(pairs.max(axis=1, initial=-1))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            key = np.asarray(batch.column("bucket"))
            cut = int(np.searchsorted(key, key[-1], "left")) if len(key) else 0
            if cut:
                yield some(pa.concat_batches([*held, batch.slice(0, cut)]))
                held = []
            held.append(batch.slice(cut))
        if held and sum(b.num_rows for b in held):
            yield some(pa.concat_batches(held))

    return dealt.mapInArrow(tidy(run), "a bigint, b bigint").distinct()


# ---------------------------------------------------------------- links and groups


def sets(rows: DataFrame) -> DataFrame:
    """node, set (hashes of the shingles) and odd (their long parity) of rows (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [s.view(np.int64) for s in shingle_sets(Words(as_text(batch.column("text")), TABLE))]
            odd = [long_parity(s.view(np.uint64)) for s in found]
            lists = [pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(s) for s in k])), pa.int32()), pa.array(np.concatenate(k))) for k in (found, odd)]
            yield pa.RecordBatch.from_arrays([batch.column("node"), *lists], ["node", "set", "odd"])

    return rows.mapInArrow(tidy(run), "node bigint, set array<bigint>, odd array<bigint>")


def sides(pairs: DataFrame, of: DataFrame, what: str) -> DataFrame:
    """pairs (a, b) with column `what` of the two as _s and _t."""
    side = lambda node, name: of.select(F.col("node").alias(node), F.col(what).alias(name))
    return pairs.select("a", "b").join(side("a", "_s"), "a").join(side("b", "_t"), "b")


def closer(pairs: DataFrame, of: DataFrame) -> DataFrame:
    """The pairs that their long parities allow to be alike. of: as sets gives."""
    sized = of.select("node", F.struct(F.size("set").alias("n"), "odd").alias("odd"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s, t = batch.column("_s"), batch.column("_t")
            total = np.asarray(s.field("n"), np.int64) + np.asarray(t.field("n"), np.int64)
            lists = ((x.values.to_numpy(), x.offsets.to_numpy()) for x in (s.field("odd"), t.field("odd")))
            (x, i), (y, j) = lists
            good = [odd_bits(x[i[k] : i[k + 1]], y[j[k] : j[k + 1]]) <= far(n) for k, n in enumerate(total.tolist())]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return sides(pairs, sized, "odd").mapInArrow(tidy(run), "a bigint, b bigint")


def links(pairs: DataFrame, of: DataFrame, least: float = LEAST) -> DataFrame:
    """The pairs whose sets are alike by `least` or more."""
    both = sides(pairs, of, "set").select("a", "b", F.size("_s").alias("m"), F.size("_t").alias("n"), F.size(F.array_intersect("_s", "_t")).alias("k"))
    return both.where(1000 * F.col("k") >= round(1000 * least) * (F.col("m") + F.col("n") - F.col("k"))).select("a", "b")


def by_key(table: DataFrame, keys: DataFrame, how: str, few: int | None = None) -> DataFrame:
    """table joined to keys, a written table, by _key; without a shuffle of the texts where keys has few rows."""
    return table.join(F.broadcast(keys) if keys.count() <= (FEW if few is None else few) else keys, "_key", how)


def linked(pairs: DataFrame, table: DataFrame, text: Column, classes: DataFrame, name: str) -> DataFrame:
    """links of the pairs, as a written table, by the sets of the texts that their classes stand for."""
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    of = written(classes.join(nodes, "node", "left_semi").select("node", F.col("least.key").alias("_key")), f"{name}-nodes")
    of = written(sets(by_key(table.select("_key", text.alias("text")), of, "inner").select("node", "text")), f"{name}-sets")
    return written(links(written(closer(pairs, of), f"{name}-closer"), of), f"{name}-links")


def deduplicated(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """One document of each group of near copies, the one with the smallest doc_id, with its columns."""
    names = docs.columns
    table = written(marked(docs).withColumn("_key", F.monotonically_increasing_id()), "marked")
    doc_id, text = (F.col(f"c{place_of(docs, n)}") for n in ("doc_id", "text"))
    order = F.struct(doc_id.isNull().alias("none"), doc_id.alias("id"), F.col("_key").alias("key"))
    classes = table.groupBy("_class").agg(F.min(order).alias("least"), *[F.first(k).alias(k) for k in ("_fp", "_n", *ODD)])
    classes = written(classes.select(F.monotonically_increasing_id().alias("node"), F.xxhash64("_class").alias("c"), F.col("_fp").alias("fp"), "_n", *ODD, "least"), "classes")
    shared = written(shared_keys(table.select(F.xxhash64("_class").alias("c"), text.alias("text"))), "shared-keys")
    near = written(classes.join(shared.select("c").distinct(), "c", "left_semi"), "near-classes")
    pairs = written(possible(candidates(near.select("node", "fp"), near.count(), bucket), near), "near-pairs")
    first = linked(pairs, table, text, near, "near")
    label = lambda df, found: df.join(found, "node", "left").withColumn("label", F.coalesce("label", "node"))
    rest = written(apart(shared, label(near, connected_components(first)), bucket), "rest-pairs")
    found = connected_components(first.union(linked(rest, table, text, near, "rest")))
    kept = written(label(classes, found).groupBy("label").agg(F.min("least").alias("least")).select(F.col("least.key").alias("_key")), "kept")
    gone = written(table.select("_key").join(kept, "_key", "left_anti"), "gone")
    left = by_key(table, gone, "left_anti") if gone.count() <= FEW else by_key(table, kept, "left_semi")
    return left.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)])
