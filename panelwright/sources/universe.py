"""Universe list and its filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions import windows as w
from panelwright.params import JobParams

REASONS = ["low_cap", "low_vol", "price"]


def symbol(raw: Column) -> Column:
    """Class separator ``.`` becomes ``-``."""
    return F.translate(raw, ".", "-")


def custom_symbols(raw: DataFrame) -> DataFrame:
    """User list: trimmed, upper case, blanks dropped, order kept."""
    tidy = F.upper(F.trim("ticker"))
    return raw.select("ord", tidy.alias("ticker")).where(F.length("ticker") > 0)


def with_fallback(listed: DataFrame, fallback: DataFrame) -> DataFrame:
    """The list, or the fallback when the list is empty."""
    return fallback if listed.isEmpty() else listed


def capped(universe: DataFrame, params: JobParams = JobParams()) -> DataFrame:
    """The first ``max_universe_size`` symbols by list order.

    A row-number limit: each task forwards only its own first rows.
    """
    rn = F.row_number().over(Window.orderBy("ord"))
    return universe.withColumn("_rn", rn).where(F.col("_rn") <= params.max_universe_size).drop("_rn")


def as_number(raw: Column) -> Column:
    """Number or 0.0 when missing, malformed or not finite."""
    return F.coalesce(w.finite(raw.try_cast("double")), F.lit(0.0))


def screened(bars: DataFrame, info: DataFrame, params: JobParams = JobParams()) -> DataFrame:
    """One row per ticker with defaults, latest close and the first failed filter, if any.

    A cap or volume of 0 is unknown and passes.
    """
    last = bars.groupBy("ticker").agg(F.max_by("close", "date").cast("double").alias("last_close"))
    dims = info.select("ticker", "sector", F.col("market_cap").cast("string").alias("cap"),
                       F.col("average_volume").cast("string").alias("vol"))
    rows = last.join(dims, "ticker", "left").select(
        "ticker", F.coalesce(F.nullif("sector", F.lit("")), F.lit("Unknown")).alias("sector"),
        as_number(F.col("cap")).alias("market_cap"), as_number(F.col("vol")).alias("average_volume"),
        "last_close")
    cap, vol, px = F.col("market_cap"), F.col("average_volume"), F.col("last_close")
    reason = (F.when((cap > 0) & (cap < params.min_market_cap), "low_cap")
              .when((vol > 0) & (vol < params.min_avg_volume), "low_vol")
              .when(~px.between(params.min_price, params.max_price), "price"))
    return rows.withColumn("reason", reason)


def accepted(screen: DataFrame) -> DataFrame:
    return screen.where(F.col("reason").isNull()).drop("reason")


def skip_counts(screen: DataFrame) -> DataFrame:
    return screen.where(F.col("reason").isNotNull()).groupBy("reason").agg(
        F.count(F.lit(1)).alias("n"))
