"""Daily bars from the order tables.

Each instrument key gets a tick price walk driven by line discounts, resampled
to one open/high/low/close/volume row per day. The walk is a running sum over
*all* rows of a key, and one key (the index series) holds every row, so it is
computed as a blocked prefix sum:

1. rows are grouped by (ticker, day, block of order keys); the running sum and
   its first, last, lowest and highest value are taken inside that group;
2. one summary row per group is shuffled by ticker and the groups' totals are
   accumulated in order.

Steps are whole hundredths held as BIGINT, so the sums are exact and do not
depend on how the rows were split. The block is a range of order keys; it rises
with the order of the rows. Its length is measured, so that a block has about
BLOCK_ROWS rows of all keys and days, and no more of any hot key or day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BAR_SCHEMA = T.StructType([
    T.StructField("ticker", T.StringType()),
    T.StructField("date", T.DateType()),
    T.StructField("open", T.FloatType()),
    T.StructField("high", T.FloatType()),
    T.StructField("low", T.FloatType()),
    T.StructField("close", T.FloatType()),
    T.StructField("volume", T.LongType()),
])

BLOCK_ROWS = 4_000_000
TIE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
       "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def supplier_ticker(suppkey: Column) -> Column:
    return F.concat(F.lit("S"), F.lpad(suppkey.cast("string"), 12, "0"))


def keyed_lines(spark: SparkSession, sf_dir: str, key: str) -> DataFrame:
    """Line items with their instrument key as ``ticker``."""
    lines = table(spark, sf_dir, "lineitem").select("l_shipdate", *TIE)
    if key == "index":
        return lines.withColumn("ticker", F.lit("INDEX"))
    if key == "supplier":
        return lines.withColumn("ticker", supplier_ticker(F.col("l_suppkey")))
    if key == "brand":
        part = table(spark, sf_dir, "part").select(
            F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("ticker"))
        return lines.join(part, "l_partkey")
    supplier = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("n_nationkey"))
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    if key == "nation":
        dim = supplier.join(nation, "n_nationkey").select(
            "l_suppkey", F.col("n_name").alias("ticker"))
    elif key == "region":
        region = table(spark, sf_dir, "region").select(
            F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("ticker"))
        dim = supplier.join(nation, "n_nationkey").join(region, "n_regionkey").select(
            "l_suppkey", "ticker")
    else:
        raise ValueError(f"unknown instrument key {key!r}")
    return lines.join(dim, "l_suppkey")


def tick_price(steps: Column) -> Column:
    return F.round(100.0 * F.exp(0.15 * (steps / F.lit(100.0))), 4).cast("float")


def order_block(spark: SparkSession, sf_dir: str) -> int:
    """Order keys of a block, from the range and number of the keys; only that column is read."""
    row = table(spark, sf_dir, "lineitem").agg(
        F.min("l_orderkey").alias("low"), F.max("l_orderkey").alias("high"), F.count("l_orderkey").alias("n")).first()
    return max(1, (row["high"] - row["low"] + 1) * BLOCK_ROWS // row["n"]) if row["n"] else 1


def walk_bars(lines: DataFrame, order_block: int) -> DataFrame:
    """Blocked prefix walk over ``ticker, l_shipdate, TIE`` rows, one bar per (ticker, date)."""
    rows = lines.select(
        "ticker", F.to_date("l_shipdate").alias("date"), *TIE,
        F.floor(F.col("l_orderkey") / F.lit(order_block)).cast("long").alias("block"),
        (F.round(F.col("l_discount") * 100).cast("long") - 5).alias("step"))
    group = ["ticker", "date", "block"]
    inside = (Window.partitionBy(*group).orderBy(*TIE)
              .rowsBetween(Window.unboundedPreceding, 0))
    walked = rows.select(*group, "step", "l_quantity",
                         F.sum("step").over(inside).alias("pos"),
                         F.row_number().over(Window.partitionBy(*group).orderBy(*TIE)).alias("rn"))
    blocks = walked.groupBy(*group).agg(
        F.sum("step").alias("total"),
        F.max("pos").alias("top"), F.min("pos").alias("bottom"),
        F.max(F.when(F.col("rn") == 1, F.col("pos"))).alias("start"),
        F.sum("l_quantity").alias("quantity"))
    # An explicit partition count: what follows is heavy per byte, so the small
    # byte size must not let AQE merge these partitions into a few.
    parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = blocks.repartition(parts, "ticker")
    per_ticker = Window.partitionBy("ticker").orderBy("date", "block")
    placed = blocks.withColumn(
        "base", F.sum("total").over(per_ticker.rowsBetween(Window.unboundedPreceding, 0))
        - F.col("total"))
    base = F.col("base")
    days = placed.groupBy("ticker", "date").agg(
        F.min_by(base + F.col("start"), "block").alias("o"),
        F.max(base + F.col("top")).alias("h"),
        F.min(base + F.col("bottom")).alias("l"),
        F.max_by(base + F.col("total"), "block").alias("c"),
        F.sum("quantity").cast("long").alias("volume"))
    return days.select("ticker", "date", tick_price(F.col("o")).alias("open"),
                       tick_price(F.col("h")).alias("high"), tick_price(F.col("l")).alias("low"),
                       tick_price(F.col("c")).alias("close"), "volume")


def bars(spark: SparkSession, sf_dir: str, key: str, block: int | None = None) -> DataFrame:
    return walk_bars(keyed_lines(spark, sf_dir, key), block or order_block(spark, sf_dir))


def instruments(spark: SparkSession, sf_dir: str, key: str, daily: DataFrame) -> DataFrame:
    """Instrument dimension: sector, market cap and average volume per ticker.

    A cap or volume of 0 stands for "unknown".
    """
    supplier = table(spark, sf_dir, "supplier")
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    located = (supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
               .join(region, F.col("n_regionkey") == F.col("r_regionkey")))
    ticker = {"supplier": supplier_ticker(F.col("s_suppkey")),
              "nation": F.col("n_name"), "region": F.col("r_name")}[key]
    info = located.groupBy(ticker.alias("ticker")).agg(
        F.round(F.sum("s_acctbal"), 2).alias("market_cap"),
        F.min("r_name").alias("sector"), F.min("n_name").alias("short_name"))
    volume = daily.groupBy("ticker").agg(F.avg("volume").alias("average_volume"))
    return info.join(volume, "ticker", "left").select(
        "ticker", "sector", "market_cap", "average_volume", "short_name")
