"""Conviction tiers, risk scores and ranked signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions import ranks
from panelwright.operators.features import FEATURES
from panelwright.params import JobParams

# Tiers from best to worst, their thresholds and the composite weights.
TIERS = ["HIGH", "MEDIUM", "LOW", "SPECULATIVE", "AVOID"]
SELECTABLE = ["HIGH", "MEDIUM", "LOW"]
HIGH_CI, HIGH_CONFIDENCE, HIGH_TREE_STD = 0.0, 0.60, 0.08
MEDIUM_CI, MEDIUM_CONFIDENCE = -0.05, 0.45
LOW_CONFIDENCE = 0.30
WEIGHT_CONFIDENCE, WEIGHT_SHARPE, WEIGHT_MOMENTUM = 0.45, 0.35, 0.20
SHARPE_SCALE = 3.0
VOL_FLOOR, DEFAULT_VOL = 0.01, 0.30
MOMENTUM = [f for f in FEATURES if f.startswith("mom_")]


def conviction(er: Column, ci_low: Column, confidence: Column, tree_std: Column) -> Column:
    return (F.when(er <= 0, "AVOID")
            .when((ci_low > HIGH_CI) & (confidence > HIGH_CONFIDENCE) & (tree_std < HIGH_TREE_STD), "HIGH")
            .when((ci_low > MEDIUM_CI) & (confidence > MEDIUM_CONFIDENCE), "MEDIUM")
            .when(confidence > LOW_CONFIDENCE, "LOW")
            .otherwise("SPECULATIVE"))


def signals(preds: DataFrame, latest: DataFrame, info: DataFrame,
            params: JobParams = JobParams()) -> DataFrame:
    """Predictions joined with the raw latest features and the instrument table, scored."""
    mom = sum([F.col(m) for m in MOMENTUM[1:]], F.col(MOMENTUM[0])) / len(MOMENTUM)
    raw = latest.where(F.col("row_no") >= params.min_signal_rows).select(
        "as_of", "ticker", F.coalesce(F.col("vol_21d"), F.lit(DEFAULT_VOL)).alias("volatility"),
        mom.alias("momentum_quality"))
    dims = info.select("ticker", F.coalesce(F.nullif("sector", F.lit("")), F.lit("Unknown")).alias("sector"),
                       "market_cap")
    rows = preds.join(raw, ["as_of", "ticker"]).join(dims, "ticker")
    er, conf = F.col("expected_return"), F.col("confidence")
    vol = F.greatest(F.col("volatility"), F.lit(VOL_FLOOR))
    scored = rows.select(
        "as_of", "ticker", "expected_return", "ci_low", "ci_high", "confidence", "tree_std",
        "calibrated_std", "rf_pred", "gb_pred", "volatility", "sector", "market_cap",
        conviction(er, F.col("ci_low"), conf, F.col("tree_std")).alias("conviction"),
        F.lit(params.horizon).alias("holding_period"),
        (er * conf).alias("conf_adj_return"), vol.alias("vol_21d"),
        ((er - params.risk_free_rate) / vol).alias("sharpe_est"), "momentum_quality")
    composite = (WEIGHT_CONFIDENCE * F.col("conf_adj_return")
                 + WEIGHT_SHARPE * F.col("sharpe_est") / SHARPE_SCALE
                 + WEIGHT_MOMENTUM * F.col("momentum_quality"))
    return scored.withColumn("composite", composite)


def ranked(sig: DataFrame) -> DataFrame:
    """Position of every signal by falling composite within its as-of day; ties by ticker."""
    return ranks.by_value_desc(sig, ["as_of"], "composite", "ticker", "rank")


def candidates(sig: DataFrame, min_return: float, params: JobParams = JobParams()) -> DataFrame:
    """Best ``2 * max_positions`` signals that pass the return, agreement and tier filters.

    A row-number limit, so every task forwards at most that many rows per day.
    """
    kept = sig.where((F.col("expected_return") >= min_return)
                     & (F.col("confidence") >= params.confidence_threshold)
                     & F.col("conviction").isin(SELECTABLE))
    order = Window.partitionBy("as_of").orderBy(F.col("composite").desc(), "ticker")
    return kept.withColumn("pick", F.row_number().over(order)).where(
        F.col("pick") <= params.max_candidates)


def nested(sig: DataFrame) -> DataFrame:
    """Signal record with its factors nested, as written by the sink."""
    scores = F.struct("expected_return", "conf_adj_return", "vol_21d", "sharpe_est",
                      "momentum_quality", "composite")
    factors = F.struct(scores.alias("scores"), "volatility", "sector", "market_cap",
                       "rf_pred", "gb_pred", "tree_std", "calibrated_std")
    return sig.select("as_of", "ticker", "expected_return", "ci_low", "ci_high", "confidence",
                      "conviction", "holding_period", factors.alias("factors"))
