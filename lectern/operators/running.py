"""Running numbers and sums within keys, where one key may hold most of the rows.

Rows are dealt by ranges of key and order, so a large key lies in many parts; each part is numbered or summed by itself, and what the
parts before it hold is added. Only sums of parts meet by key: as many rows as there are parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.session import stored

#: Rows of a block of a key in which a moving window is worked out.
BLOCK = 100_000


def running(df: DataFrame, keys: list[str], order: list[str | Column], sums: dict[str, Column], number: str = "n", total: str | None = None, parts: int | None = None) -> DataFrame:
    """df with running sums (name: of what, a whole number) of each key in an order, a running number from 1 on, and if named the
    key's number of rows. Rows that the order does not tell apart are numbered in any order. Null keys are one key."""
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    inputs = [F.coalesce(c, F.lit(0)).cast("bigint").alias(f"_i{i}") for i, c in enumerate([F.lit(1), *sums.values()])]
    places = [(F.col(c) if isinstance(c, str) else c).alias(f"_o{i}") for i, c in enumerate(order)]
    sort = [F.col(f"_o{i}") for i in range(len(order))]
    dealt = df.select("*", *inputs, *places, F.monotonically_increasing_id().alias("_row"))
    # the row's own number last: equal rows of a key can be dealt to several parts
    dealt = stored(dealt.repartitionByRange(parts, *keys, *sort, "_row").withColumn("_part", F.spark_partition_id()), "by-range")
    names = [f"_i{i}" for i in range(len(inputs))]
    # one row for each part and key; without keys as many rows as there are parts
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    part = dealt.groupBy(*keys, "_part").agg(*[F.sum(c).alias(c) for c in names])
    part = part.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_p"), *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_b{c}") for c in names], F.sum("_i0").over(Window.partitionBy(*keys)).alias("_all"))
    so_far = Window.partitionBy(*keys, "_part").orderBy(*sort, "_row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = dealt.select("*", *[F.sum(c).over(so_far).alias(f"_s{c}") for c in names])
    same = F.col("_part") == F.col("_p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    outs = [(F.col(f"_s{c}") + F.col(f"_b{c}")).alias(name) for c, name in zip(names, [number, *sums], strict=True)]
    return own.join(part, same).select(*df.columns, *outs, *([F.col("_all").alias(total)] if total else []))


def moving_average(numbered: DataFrame, keys: list[str], value: str, n: int, name: str, number: str = "n", block: int = BLOCK) -> DataFrame:
    """numbered (from running()) with the mean of a row's value and those of the n - 1 rows before it. A key falls into blocks by its
    rows' numbers; the last n - 1 rows of a block also begin the next, where they are not reported."""
    block = max(block, n)
    at = F.floor((F.col(number) - 1) / block)
    near_end = (F.col(number) - 1) % block >= block - (n - 1)
    twice = F.when(near_end, F.array(F.struct(at.alias("b"), F.lit(True).alias("own")), F.struct((at + 1).alias("b"), F.lit(False).alias("own")))).otherwise(F.array(F.struct(at.alias("b"), F.lit(True).alias("own"))))
    w = Window.partitionBy(*keys, "_x.b").orderBy(number).rowsBetween(1 - n, Window.currentRow)
    dealt = numbered.withColumn("_x", F.explode(twice))
    return dealt.withColumn(name, F.avg(value).over(w)).where("_x.own").drop("_x")
