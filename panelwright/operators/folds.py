"""Purged walk-forward folds over the panel's unique dates.

All tables here hold at most one row per day and fold. Rows of the panel meet
them through an equi-join on the date.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwright.params import JobParams


def date_positions(panel: DataFrame) -> DataFrame:
    """Unique dates numbered from 0. One row per day, so one partition is enough."""
    days = panel.select("date").distinct()
    return days.select("date", (F.row_number().over(Window.orderBy("date")) - 1).alias("pos"),
                       F.count(F.lit(1)).over(Window.partitionBy()).alias("n_dates"))


def _bounds(n, params: JobParams):
    """Block bound i of k+1 equal blocks: i*n/(k+1) cut to whole numbers, the last one n."""
    width = n / F.lit(params.n_folds + 1.0)
    return lambda i: F.when(i > params.n_folds, n).otherwise(F.floor(i * width)).cast("int")


def fold_bounds(positions: DataFrame, params: JobParams = JobParams()) -> DataFrame:
    """Usable folds with their exclusive training end and validation range, as positions."""
    size = positions.agg(F.count(F.lit(1)).cast("int").alias("n_dates"))
    block = size.select("n_dates", F.explode(F.sequence(F.lit(1), F.lit(params.n_folds))).alias("i"))
    at = _bounds(F.col("n_dates"), params)
    cut = block.select("i", at(F.col("i")).alias("val_start"), at(F.col("i") + 1).alias("val_stop"))
    cut = cut.withColumn("train_stop", F.col("val_start") - params.embargo)
    usable = cut.where((F.col("train_stop") >= 1) & (F.col("val_stop") > F.col("val_start")))
    return usable.select((F.row_number().over(Window.orderBy("i")) - 1).alias("fold"),
                         "train_stop", "val_start", "val_stop")


def day_roles(positions: DataFrame, params: JobParams = JobParams()) -> DataFrame:
    """Role of every day in every fold: ``train``, ``val`` or absent (embargo, later days)."""
    at = _bounds(F.col("n_dates"), params)
    days = positions.select("date", "pos", "n_dates",
                            F.explode(F.sequence(F.lit(1), F.lit(params.n_folds))).alias("i"))
    days = days.select("date", "pos", "i", at(F.col("i")).alias("val_start"),
                       at(F.col("i") + 1).alias("val_stop"))
    train_stop = F.col("val_start") - params.embargo
    role = (F.when(F.col("pos") < train_stop, "train")
            .when((F.col("pos") >= F.col("val_start")) & (F.col("pos") < F.col("val_stop")), "val"))
    usable = days.where((train_stop >= 1) & (F.col("val_stop") > F.col("val_start")))
    return usable.select("date", "pos", role.alias("role"),
                         (F.dense_rank().over(Window.orderBy("i")) - 1).alias("fold"),
                         ).where(F.col("role").isNotNull())


def assign(panel: DataFrame, roles: DataFrame) -> DataFrame:
    """Panel rows with (fold, role); training rows repeat once per fold that trains on them."""
    return panel.join(roles, "date")


def fold_summary(panel: DataFrame, roles: DataFrame, params: JobParams = JobParams()) -> DataFrame:
    """Rows per side, boundary dates and the measured gap of each fold.

    Counts per day first, so the panel is not repeated per fold.
    """
    per_day = panel.groupBy("date").agg(F.count(F.lit(1)).alias("n"))
    days = per_day.join(roles, "date")
    train, val = F.col("role") == "train", F.col("role") == "val"
    out = days.groupBy("fold").agg(
        F.coalesce(F.sum(F.when(train, F.col("n"))), F.lit(0)).alias("train_rows"),
        F.coalesce(F.sum(F.when(val, F.col("n"))), F.lit(0)).alias("val_rows"),
        F.max(F.when(train, F.col("date"))).alias("train_max_date"),
        F.min(F.when(val, F.col("date"))).alias("val_min_date"),
        F.max(F.when(val, F.col("date"))).alias("val_max_date"),
        F.max(F.when(train, F.col("pos"))).alias("_last"),
        F.min(F.when(val, F.col("pos"))).alias("_first"))
    out = out.where((F.col("train_rows") > 0) & (F.col("val_rows") > 0))
    return out.select(
        "fold", "train_rows", "val_rows", "train_max_date", "val_min_date", "val_max_date",
        (F.col("_first") - F.col("_last")).alias("gap_trading_days"),
        F.lit(params.embargo).alias("embargo"),
        (F.col("_last") + params.embargo < F.col("_first")).alias("ordering_ok"))
