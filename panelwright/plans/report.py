"""Report tables and the result sink. Text layout is not reproduced."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SCAN_ROWS = 30
SCAN_ALL = 16
SPREAD_ROWS = 10
IMPORTANCE_ROWS = 15
METRICS = ["final_value", "total_return", "cagr", "volatility", "sharpe_ratio", "max_drawdown",
           "turnover_annualized", "total_costs", "active_cagr"]


def signal_scan(ranked: DataFrame) -> DataFrame:
    """First 30 signals per day; AVOID only among the first 16."""
    shown = ranked.where((F.col("rank") <= SCAN_ALL) | (F.col("conviction") != "AVOID"))
    order = Window.partitionBy("as_of").orderBy("rank")
    return shown.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= SCAN_ROWS).select(
        "as_of", "rank", "ticker", "expected_return", "ci_low", "ci_high", "confidence",
        "conviction", "sector", "volatility")


def uncertainty(ranked: DataFrame) -> DataFrame:
    return ranked.where(F.col("rank") <= SPREAD_ROWS).select(
        "as_of", "rank", "ticker", "rf_pred", "gb_pred",
        F.abs(F.col("rf_pred") - F.col("gb_pred")).alias("spread"), "tree_std", "conviction")


def comparison(perf: DataFrame, strategies: list[str]) -> DataFrame:
    """Metric x strategy; a missing strategy or cell stays NULL."""
    long = perf.where(F.col("error").isNull()).select(
        "strategy", *[F.col(m).cast("double").alias(m) for m in METRICS]).unpivot(
        ["strategy"], METRICS, "metric", "value")
    return long.groupBy("metric").pivot("strategy", strategies).agg(F.first("value"))


def withheld(perf: DataFrame, gate_row: DataFrame) -> DataFrame:
    """Performance rows, or one reason row when a gate exists and failed."""
    flag = gate_row.select(F.lit(1).alias("one"),
                           ((F.col("n_gating") > 0) & ~F.col("gate_ok")).alias("closed"))
    rows = perf.withColumn("one", F.lit(1)).join(F.broadcast(flag), "one")
    shown = rows.where(~F.col("closed")).select("strategy", "cagr", F.lit(None).cast("string").alias("reason"))
    note = flag.where("closed").select(
        F.lit(None).cast("string").alias("strategy"), F.lit(None).cast("double").alias("cagr"),
        F.lit("falsification gate did not pass").alias("reason"))
    return shown.unionByName(note)


def benchmark_summary(perf: DataFrame) -> DataFrame:
    return perf.where(F.col("strategy").isin("equal_weight", "index")).select(
        "strategy", "cagr", "total_return", "sharpe_ratio", "max_drawdown", "active_cagr", "error")


def top_importances(table: DataFrame) -> DataFrame:
    return table.orderBy(F.col("importance").desc(), "feature").limit(IMPORTANCE_ROWS)


# Names of the record's fields, as readers of the output format know them.
CONFIG = {"prediction_horizon_days": "horizon", "rebalance_frequency_days": "rebalance_every", "transaction_cost_bps": "cost_bps",
          "max_universe_size": "max_universe_size", "random_seed": "seed"}
STRATEGY = ["total_return", "cagr", "volatility", "sharpe_ratio", "max_drawdown", "turnover_annualized", "total_costs", "final_value",
            "num_trades"]
BENCHMARK = ["cagr", "total_return", "sharpe_ratio", "max_drawdown", "active_cagr", "error"]


def run_record(params, *, generated: Column, universe: DataFrame, checks: DataFrame, gate_row: DataFrame, perf: DataFrame, book: DataFrame,
               r2: DataFrame, tiers: DataFrame, verdict: DataFrame, lead: str = "strategy") -> DataFrame:
    """One nested row with the whole run; its parts have a handful of rows each.

    ``book`` is the ledger, which gives the window and the number of rebalances; ``r2`` has one row, oof_r2. Where the run
    failed, the backtest holds the error and nothing else; without tiers there is no audit. Of the universe the record
    has the number of symbols; ``write_record`` writes the symbols as a table next to it.
    """
    mine = F.col("strategy") == lead
    own = perf.agg(
        F.max(F.when(mine, F.struct(*STRATEGY))).alias("strategy"),
        F.array_sort(F.collect_list(F.when(~mine, F.struct(F.col("strategy").alias("name"), *BENCHMARK)))).alias("benchmarks"),
        F.max(F.when(mine, F.col("error"))).alias("error"))
    window = book.where(mine).agg(F.array(F.min("date"), F.max("date")).alias("window"),
                                  F.sum((~F.col("is_end")).cast("long")).alias("num_rebalances"))
    back = own.crossJoin(window).crossJoin(r2.select("oof_r2"))
    names = ["window", "num_rebalances", "strategy", "benchmarks", "oof_r2"]
    fine = F.col("error").isNull()
    backtest = F.struct(*[F.when(fine, F.col(n)).alias(n) for n in names], "error")
    audit = tiers.agg(F.array_sort(F.collect_list(F.struct("tier_order", "tier", "n", "mean_pred", "mean_realized", "median_realized", "hit_rate"))).alias("rows"))
    audited = F.when(F.size("rows") > 0, F.struct("monotonic", "detail", F.col("rows").alias("table")))
    parts = [universe.agg(F.countDistinct("ticker").alias("universe_size")),
             gate_row.select(F.col("gate_ok").alias("falsification_gate_passed")),
             checks.agg(F.array_sort(F.collect_list(F.struct("ord", "name", "passed", "gating", "measure", "detail"))).alias("integrity")),
             back.select(backtest.alias("backtest")),
             audit.crossJoin(verdict.select("monotonic", "detail")).select(audited.alias("conviction_audit"))]
    config = F.struct(*[F.lit(getattr(params, field)).alias(name) for name, field in CONFIG.items()])
    out = parts[0].select(generated.alias("generated"), config.alias("config"), "universe_size")
    for part in parts[1:]:
        out = out.crossJoin(F.broadcast(part))
    return out


def write_record(record: DataFrame, universe: DataFrame, root: str, stamp: str) -> str:
    """The record as JSON, and the universe as a table, under a dated path."""
    path = f"{root}/{stamp}"
    record.write.mode("overwrite").option("ignoreNullFields", False).json(f"{path}/record")
    universe.select("ticker").distinct().write.mode("overwrite").parquet(f"{path}/universe")
    return path


def read_record(spark: SparkSession, path: str, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """What write_record wrote: the record, by the schema it was written with, and the universe."""
    return spark.read.schema(schema).json(f"{path}/record"), spark.read.parquet(f"{path}/universe")
