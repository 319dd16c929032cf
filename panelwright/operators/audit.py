"""Do better tiers realise better returns out of fold?"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions import ranks
from panelwright.operators.signals import TIERS, conviction
from panelwright.params import JobParams

ACTIONABLE = ["HIGH", "MEDIUM", "LOW"]


def tiered(oof: DataFrame, params: JobParams = JobParams()) -> DataFrame:
    """Tier of every out-of-fold row, with the interval pred +- z * residual_std."""
    low = F.col("pred") - params.interval_z * F.col("residual_std")
    return oof.withColumn("tier", conviction(F.col("pred"), low, F.col("confidence"), F.col("tree_std")))


def tier_table(tiers: DataFrame) -> DataFrame:
    """Count, mean prediction, realised mean and median, and hit rate per populated tier.

    The median is selected by counts of ranges, so a tier's returns are never gathered or sorted whole.
    """
    order = F.array_position(F.array(*[F.lit(t) for t in TIERS]), F.col("tier")).cast("int")
    means = tiers.groupBy("tier").agg(
        F.count(F.lit(1)).alias("n"), F.avg("pred").alias("mean_pred"),
        F.avg("y").alias("mean_realized"), F.avg((F.col("y") > 0).cast("double")).alias("hit_rate"))
    middle = ranks.percentile(tiers, "tier", "y").withColumnRenamed("y", "median_realized")
    return means.join(middle, "tier", "left").withColumn("tier_order", order)


def verdict(table: DataFrame) -> DataFrame:
    """Is the realised mean non-increasing from HIGH to LOW? False with fewer than two tiers."""
    live = table.where(F.col("tier").isin(ACTIONABLE))
    step = live.withColumn("better", F.lag("mean_realized").over(
        Window.partitionBy(F.lit(1)).orderBy("tier_order")))
    agg = step.agg(
        F.count(F.lit(1)).alias("n_tiers"),
        F.coalesce(F.bool_and(F.col("better").isNull() | (F.col("better") >= F.col("mean_realized"))),
                   F.lit(False)).alias("ordered"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tier_order", "tier"))),
                                 lambda t: t["tier"]), " / ").alias("names"))
    enough = F.col("n_tiers") >= 2
    return agg.select(
        "n_tiers", (enough & F.col("ordered")).alias("monotonic"),
        F.when(~enough, F.concat(F.lit("too few tiers populated to judge: "), F.col("n_tiers").cast("string")))
        .when(F.col("ordered"), F.concat(F.lit("realised return falls in order over "), F.col("names")))
        .otherwise(F.concat(F.lit("realised return is out of order over "), F.col("names"))).alias("detail"))
