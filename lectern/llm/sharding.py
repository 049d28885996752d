"""Sharding by a Feistel permutation of global row numbers, in DataFrame functions alone.

Rows get a global number from their content (bucket of a hash, then id, size and checksums), so the file
layout does not matter. A Feistel network over [0, a) x [0, b), the smallest such grid that holds all n rows,
permutes the numbers; numbers that leave [0, n) walk on along their cycle. Row at place p goes to shard
p mod k, slot p div k, so shard and slot can be computed from a row number, and backwards.

Very long texts only give their size and checksum. Nulls: a null text is empty (size 16, checksum 0), null ids are numbered like others. Repeated rows get a
number each. An empty table gives an empty result. Further columns of the input are not read.
"""

from __future__ import annotations

import math

import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import columns_of, written

SHARDS = 40
ROUNDS = 6
BUCKETS = 4096


def _grid(n: int) -> tuple[int, int]:
    a = max(1, math.isqrt(max(0, n - 1)) + 1)
    return a, max(1, -(-n // a))


def _once(x: int, grid: tuple[int, int], seed: int, rounds: int) -> int:
    """The permutation for one number, as permuted() has it for a column."""
    a, b = grid
    left, right = divmod(x, b)
    for i in range(rounds):
        mod, half = (a, right) if i % 2 == 0 else (b, left)
        h = xxhash.xxh64_intdigest(half.to_bytes(8, "little"), seed=42)
        h = xxhash.xxh64_intdigest((seed + i).to_bytes(8, "little"), seed=h)
        h = h - (1 << 64) if h >= 1 << 63 else h
        if i % 2 == 0:
            left = (left + h) % mod
        else:
            right = (right + h) % mod
    return left * b + right


def walk_bound(n: int, seed: int, rounds: int = ROUNDS) -> int:
    """Steps after which every walk has ended: one more than the longest chain of numbers outside [0, n).

    Fewer than sqrt(n) + 1 numbers of the grid lie outside, so this is cheap even for 10**11 rows.
    """
    grid = _grid(n)
    outside = range(n, grid[0] * grid[1])
    most = 0
    for x in outside:
        steps = 1
        while (x := _once(x, grid, seed, rounds)) >= n:
            steps += 1
            if steps > len(outside):
                break  # a cycle of outside numbers only: no row enters it
        most = max(most, steps)
    return most + 1


def _round(i: int, a: int, b: int, key: int):
    """One round on a struct (l, r): l moves in even rounds, r in odd ones."""
    moved, by, mod = ("l", "r", a) if i % 2 == 0 else ("r", "l", b)

    def f(s: Column) -> Column:
        h = F.pmod(F.xxhash64(s[by], F.lit(key).cast("bigint")), F.lit(mod).cast("bigint"))
        new = ((s[moved] + h) % F.lit(mod)).cast("bigint").alias(moved)
        return F.struct(new, s["r"].alias("r")) if moved == "l" else F.struct(s["l"].alias("l"), new)

    return f


def permuted(number: Column, n: int, seed: int = 1, rounds: int = ROUNDS) -> Column:
    """The place of row `number` of n."""
    a, b = _grid(n)

    def once(x: Column) -> Column:
        state = F.struct(F.call_function("div", x, F.lit(b).cast("bigint")).alias("l"), (x % b).alias("r"))
        for i in range(rounds):
            state = _bind(state, _round(i, a, b, seed + i))
        return _bind(state, lambda s: s["l"] * F.lit(b) + s["r"])

    steps = walk_bound(n, seed, rounds)
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(number.cast("bigint").alias("x"), F.lit(False).alias("done")), lambda s, _: F.when(s["done"], s).otherwise(
        _bind(once(s["x"]), lambda y: F.struct(y.alias("x"), (y < F.lit(n)).alias("done")))), lambda s: s["x"])


def _bind(value: Column, f) -> Column:
    """f(value), with value computed once."""
    return F.transform(F.array(value), f)[0]


def numbered(docs: DataFrame) -> tuple[DataFrame, int]:
    """doc_id, size, text_crc32 and row_number, the global number from 0, of each row; and how many there are.

    Rows alike in all of these are first counted (on the map side), so that many copies of a row cost one.
    Buckets of a content hash are numbered on their own, then moved by the sums of the buckets before
    (one row for each of 4096 buckets, which is what the broadcast holds).
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = columns_of(docs, "doc_id", "text").select("doc_id", (F.octet_length(text) + 16).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("_h"))
    keys = ["doc_id", "size", "text_crc32", "_h"]
    groups = rows.groupBy(*keys).agg(F.count("*").alias("_n")).withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)))
    sums = written(groups.groupBy("_bucket").agg(F.sum("_n").alias("_total")), "bucket-sums")
    before = sums.select("_bucket", (F.sum("_total").over(Window.orderBy("_bucket")) - F.col("_total")).alias("_before"))
    in_bucket = Window.partitionBy("_bucket").orderBy(*[F.col(k).asc_nulls_first() for k in keys]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = groups.withColumn("_upto", F.sum("_n").over(in_bucket)).join(F.broadcast(before), "_bucket")
    first = F.col("_before") + F.col("_upto") - F.col("_n")
    out = placed.select("doc_id", "size", "text_crc32", F.explode(F.sequence(first, first + F.col("_n") - 1)).alias("row_number"))
    return out, sums.agg(F.coalesce(F.sum("_total"), F.lit(0))).first()[0]


def shard(docs: DataFrame, shards: int = SHARDS, seed: int = 1) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, row_number and place of each row."""
    rows, n = numbered(docs)
    if n == 0:
        place = F.lit(0).cast("bigint")
    else:
        place = permuted(F.col("row_number"), n, seed)
    rows = rows.withColumn("place", place)
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), (F.col("place") % shards).cast("int").alias("shard"), F.call_function("div", F.col("place"), F.lit(shards).cast("bigint")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "row_number", "place")
