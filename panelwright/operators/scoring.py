"""Scoring the latest cross-section: point prediction, interval, agreement."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.functions import windows as w
from panelwright.operators import ensemble, panel
from panelwright.operators.features import FEATURES
from panelwright.params import JobParams

# Bounds of a prediction.
LOWEST, HIGHEST = -0.50, 1.00


def latest_rows(feats: DataFrame, as_of: dt.date) -> DataFrame:
    """Last feature row per ticker at or before ``as_of``; non-finite values become 0.

    An aggregate rather than a window: each task keeps one row per ticker.
    """
    seen = feats.where(F.col("date") <= F.lit(as_of)).where(F.col("ticker").isNotNull())
    last = seen.groupBy("ticker").agg(
        F.max_by(F.struct("date", "row_no", *FEATURES), "date").alias("r"))
    return last.select(F.lit(as_of).alias("as_of"), "ticker", "r.date", "r.row_no", *[
        F.coalesce(w.finite(F.col(f"r.{f}").cast("double")), F.lit(0.0)).alias(f) for f in FEATURES])


def latest_rows_at(feats: DataFrame, as_ofs: list[dt.date], params: JobParams = JobParams()) -> DataFrame:
    """Last feature row per ticker for many as-of days in one pass.

    A row serves every as-of day from its own date up to the ticker's next row.
    ``as_ofs`` is a subset of the calendar. Tickers whose history up to the day
    is too short are left out, as if only that history existed.
    """
    days = F.array(*[F.lit(d) for d in as_ofs])
    ahead = feats.withColumn("seg", w.segment_of(F.col("date"))).select(
        "ticker", "date", "row_no", *FEATURES,
        F.lead("date", 1).over(w.history()).alias("next"))
    served = F.filter(days, lambda d: (d >= F.col("date"))
                      & (F.col("next").isNull() | (d < F.col("next"))))
    out = ahead.where(F.col("row_no") > params.min_feature_rows).withColumn("as_of", F.explode(served))
    return out.select("as_of", "ticker", "date", "row_no", *[
        F.coalesce(w.finite(F.col(f).cast("double")), F.lit(0.0)).alias(f) for f in FEATURES])


def normalised_latest(latest: DataFrame, span: int | None = None,
                      params: JobParams = JobParams()) -> DataFrame:
    """Z-score across the tickers scored for one as-of day."""
    return panel.normalise(latest, by="as_of", span=span, params=params)


def predictions(scored: DataFrame, residual_std: DataFrame, params: JobParams = JobParams(),
                by: str = "model") -> DataFrame:
    """Final prediction record per row.

    ``scored`` carries rf, gb, pred, confidence and votes; ``residual_std`` has
    one row per model. The interval is the wider of the vote percentiles and
    the calibrated one.
    """
    low_pct, high_pct = params.interval_pct
    rows = scored.join(F.broadcast(residual_std.select(by, "residual_std")), by)
    sigma = F.coalesce(F.col("residual_std"), F.lit(ensemble.DEFAULT_RESIDUAL_STD))
    pred = F.greatest(F.lit(LOWEST), F.least(F.lit(HIGHEST), F.col("pred")))
    half = params.interval_z * sigma
    return rows.select(
        by, "as_of", "ticker", pred.alias("expected_return"),
        F.least(ensemble.vote_percentile(F.col("votes"), low_pct), pred - half).alias("ci_low"),
        F.greatest(ensemble.vote_percentile(F.col("votes"), high_pct), pred + half).alias("ci_high"),
        "confidence", ensemble.vote_std(F.col("votes")).alias("tree_std"),
        sigma.alias("calibrated_std"), F.col("rf").alias("rf_pred"), F.col("gb").alias("gb_pred"))


def prediction_summary(preds: DataFrame) -> DataFrame:
    return preds.groupBy("as_of").agg(
        F.min("expected_return").alias("min_return"), F.max("expected_return").alias("max_return"),
        F.avg("expected_return").alias("mean_return"), F.count(F.lit(1)).alias("n"))
