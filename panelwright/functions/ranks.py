"""Exact row numbers and order statistics inside groups too large for one task.

Rows fall into ordered buckets; numbers are taken per (group, bucket) and
shifted by the sizes of the earlier buckets, which are counted map-side. Any
bucketing that rises with the order gives the exact result. Groups are compared
null-safe, so rows without a group are a group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions import sizing

#: Ranges that a round of selection cuts a group's values into, and rounds; the last ones hold about 1 in 10^9 of its values.
PIECES, ROUNDS = 1024, 3


def _same(a: list[str], b: list[str]) -> Column:
    return reduce(lambda x, y: x & y, (F.col(x).eqNullSafe(F.col(y)) for x, y in zip(a, b)))


def numbered(df: DataFrame, group: list[str], bucket: Column, order: list[Column],
             name: str) -> DataFrame:
    """Add ``name`` = 1..n within ``group`` in ``order``; ``bucket`` must rise with ``order``."""
    rows = df.withColumn("_bucket", bucket)
    sizes = rows.groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    keys = [*group, "_bucket"]
    own = [f"_of_{i}" for i in range(len(keys))]
    offsets = sizes.select(*[F.col(k).alias(o) for k, o in zip(keys, own)],
                           F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    local = rows.withColumn("_local", F.row_number().over(
        Window.partitionBy(*group, "_bucket").orderBy(*order)))
    out = local.join(offsets, _same(keys, own))
    return out.withColumn(name, (F.col("_local") + F.col("_before")).cast("int")).drop(
        "_bucket", "_local", "_before", *own)


def hash_bucket(hex_hash: Column, digits: int) -> Column:
    """Leading hex digits: an even split that rises with the hash."""
    return F.substring(hex_hash, 1, digits) if digits else F.lit("")


def by_value_desc(df: DataFrame, group: list[str], value: str, tie: str, name: str) -> DataFrame:
    """Row numbers by falling ``value``, NULL last, then rising ``tie``.

    The buckets are ranges of (group, value, tie) with sampled ends, so one value in all rows is split by its ties, and
    one group over as many tasks as its rows ask for. The dealt rows are stored: a range that is dealt anew may differ.
    """
    order = [F.col(value).desc_nulls_last(), F.col(tie).asc_nulls_first()]
    dealt = sizing.cut(df.repartitionByRange(*[F.col(g) for g in group], *order).withColumn("_range", F.spark_partition_id()))
    return numbered(dealt, group, F.col("_range"), order, name).drop("_range")


def percentile(df: DataFrame, group: str, value: str, share: float = 0.5) -> DataFrame:
    """(group, value): the percentile of each group, with linear interpolation between the two values around it.

    Values are counted per range, then only the range with the place that is looked for is counted again, in finer ranges. What
    is left in the end is counted by value. Nothing is sorted whole and no group's values meet in one task. NULL values
    don't count; groups of them only, and rows without a group, are left out. ``df`` is read once a round and has a handful of groups.
    """
    rows = df.where(F.col(value).isNotNull()).select(F.col(group).alias("g"), F.col(value).cast("double").alias("v"))
    place = (F.col("n") - 1) * F.lit(share)
    now = rows.groupBy("g").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").alias("n")).select(
        "g", "low", "high", F.lit(0).cast("bigint").alias("before"), F.floor(place).alias("at"), (place - F.floor(place)).alias("part"), "n")
    for _ in range(ROUNDS):
        now = sizing.cut(now)
        inside = rows.join(F.broadcast(now), "g").where("v between low and high")
        piece = F.when(F.col("high") > F.col("low"), F.least(F.lit(PIECES - 1), F.floor(
            (F.col("v") - F.col("low")) / (F.col("high") - F.col("low")) * PIECES))).otherwise(0)
        counts = inside.withColumn("piece", piece).groupBy("g", "piece").agg(
            F.count("*").alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        order = Window.partitionBy("g").orderBy("piece")
        placed = counts.withColumn("earlier", F.sum("c").over(order) - F.col("c")).join(F.broadcast(now), "g")
        earlier, at = F.col("before") + F.col("earlier"), F.col("at")
        # The range of the value at the place, and that of the next one.
        hit = placed.where((earlier <= at + 1) & (earlier + F.col("c") > at))
        now = hit.groupBy("g").agg(F.min("lo").alias("low"), F.max("hi").alias("high"), F.min(earlier).alias("before"),
                                   F.first("at").alias("at"), F.first("part").alias("part"), F.first("n").alias("n"))
    now = sizing.cut(now)
    left = rows.join(F.broadcast(now), "g").where("v between low and high").groupBy("g", "v").agg(F.count("*").alias("c"))
    order = Window.partitionBy("g").orderBy("v")
    placed = left.withColumn("earlier", F.sum("c").over(order) - F.col("c")).join(F.broadcast(now), "g")
    first = F.col("before") + F.col("earlier")
    held = placed.where((first <= F.least(F.col("at") + 1, F.col("n") - 1)) & (first + F.col("c") > F.col("at")))
    out = held.groupBy("g").agg(F.min("v").alias("a"), F.max("v").alias("b"), F.first("part").alias("part"))
    return out.select(F.col("g").alias(group), (F.col("a") + (F.col("b") - F.col("a")) * F.col("part")).alias(value))
