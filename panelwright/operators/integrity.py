"""Measured integrity checks; each yields one row (name, passed, measure, detail, gating, status)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.operators import features as ft
from panelwright.operators.features import FEATURES
from panelwright.params import JobParams

# Tolerances on R2, the cost floor and the position of the perturbation.
PERMUTATION_TOLERANCE = 0.02
LAG_TOLERANCE = 0.02
MIN_COST_BPS = 10.0
PERTURB_AFTER = 0.7
MIN_HISTORY = 400

COLUMNS = ["name", "passed", "measure", "detail", "gating", "status"]


def _row(df: DataFrame, name: str, passed: Column, measure: Column, detail: Column,
         gating: bool = False) -> DataFrame:
    ok = F.coalesce(passed, F.lit(False))
    return df.select(F.lit(name).alias("name"), ok.alias("passed"), measure.alias("measure"),
                     detail.alias("detail"), F.lit(gating).alias("gating"),
                     F.when(ok, "PASS").otherwise("FAIL").alias("status"))


def _fixed(x: Column, digits: int = 4) -> Column:
    return F.format_string(f"%.{digits}f", x)


# ------------------------------------------------------------- look-ahead
def perturbed_bars(bars: DataFrame, cut: DataFrame, seed: int = 17) -> DataFrame:
    """Bars with every row after its ticker's cut day scaled by 0.5 .. 1.6 and a new volume.

    Factor and volume come from integer arithmetic on the day number, so any
    engine reproduces them.
    """
    day = F.unix_date("date").cast("long") + F.lit(seed)
    factor = (F.lit(0.5) + F.pmod(day * 7919, F.lit(1101)) / F.lit(1000.0)).cast("float")
    later = F.col("date") > F.col("cut")
    rows = bars.join(cut, "ticker")
    return rows.select(
        "ticker", "date",
        *[F.when(later, F.col(c) * factor).otherwise(F.col(c)).cast("float").alias(c)
          for c in ("open", "high", "low", "close")],
        F.when(later, 1000 + F.pmod(day * 104729, F.lit(8_999_000))).otherwise(F.col("volume"))
        .cast("long").alias("volume"))


def cut_days(bars: DataFrame) -> DataFrame:
    """Day at 70 % of each ticker's history; tickers under the minimum length are left out."""
    from panelwright.functions import windows as w
    n = F.count(F.lit(1)).over(w.by_ticker())
    rows = bars.select("ticker", "date", (F.row_number().over(w.dated()) - 1).alias("i"), n.alias("n"))
    at = F.floor(F.col("n") * F.lit(PERTURB_AFTER))
    return rows.where((F.col("n") >= MIN_HISTORY) & (F.col("i") == at)).select(
        "ticker", F.col("date").alias("cut"))


def lookahead_changes(bars: DataFrame, params: JobParams = JobParams(), seed: int = 17, base: DataFrame | None = None,
                      other: DataFrame | None = None) -> DataFrame:
    """Largest feature change at or before and after the cut, per ticker, over all tickers.

    ``base`` holds the features of ``bars`` where they have been built already, ``other`` those of the perturbed ones.
    """
    cut = cut_days(bars)
    base = ft.features(bars, params) if base is None else base
    other = ft.features(perturbed_bars(bars, cut, seed), params) if other is None else other
    pairs = base.select("ticker", "date", F.array(*FEATURES).alias("a")).join(
        other.select("ticker", "date", F.array(*FEATURES).alias("b")), ["ticker", "date"], "full_outer")
    gap = F.array_max(F.zip_with("a", "b", lambda x, y: F.abs(x.cast("double") - y.cast("double"))))
    # What is joined on is the gap alone: after an outer join, rows are dealt by ticker anew.
    gaps = pairs.select("ticker", "date", gap.alias("gap"))
    # From the cut's side: a ticker that has history but no feature rows stays, with nothing compared.
    marked = cut.join(gaps, "ticker", "left").withColumn("early", F.col("date") <= F.col("cut"))
    return marked.groupBy("ticker", "cut").agg(
        F.sum(F.when(F.col("early"), 1).otherwise(0)).alias("rows_compared"),
        F.sum(F.when(F.col("early") & F.col("gap").isNull(), 1).otherwise(0)).alias("unmatched"),
        F.coalesce(F.max(F.when(F.col("early"), F.col("gap"))), F.lit(0.0)).alias("max_before"),
        F.coalesce(F.max(F.when(~F.col("early"), F.col("gap"))) > 0, F.lit(False)).alias("changed_after"))


def no_lookahead(changes: DataFrame) -> DataFrame:
    agg = changes.agg(F.count(F.lit(1)).alias("n"), F.sum("rows_compared").alias("rows"),
                      F.sum(F.col("unmatched") + F.when(F.col("rows_compared") == 0, 1).otherwise(0)).alias("unmatched"),
                      F.max("max_before").alias("gap"))
    ok = (F.col("n") > 0) & (F.col("unmatched") == 0) & (F.col("gap") == 0.0)
    measure = (F.when(F.col("n") == 0, "n/a")
               .when(F.col("unmatched") > 0, F.concat(F.lit("without a counterpart: "), F.col("unmatched").cast("string")))
               .otherwise(F.concat(F.lit("max change at or before t: "), F.format_string("%.2e", "gap"))))
    detail = F.when(F.col("n") == 0, "no ticker has enough history").otherwise(
        F.concat(F.lit("rows compared: "), F.col("rows").cast("string"),
                 F.lit(", tickers: "), F.col("n").cast("string")))
    return _row(agg, "No look-ahead", ok, measure, detail)


# ------------------------------------------------------------ fingerprints
def static_columns(feats: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(ticker, feature) pairs whose value never changes within the ticker."""
    cols = cols or FEATURES
    spread = feats.groupBy("ticker").agg(*[
        (F.when(F.count(c) > 1, F.max(c).cast("double") - F.min(c).cast("double"))).alias(c) for c in cols])
    long = spread.unpivot(["ticker"], cols, "feature", "spread")
    return long.where(F.col("spread") == 0).select("ticker", "feature")


def no_fingerprints(feats: DataFrame, cols: list[str] | None = None) -> DataFrame:
    static = static_columns(feats, cols).agg(
        F.array_sort(F.collect_set("feature")).alias("names")).withColumn("one", F.lit(1))
    seen = feats.agg(F.countDistinct("ticker").alias("n")).withColumn("one", F.lit(1))
    both = static.join(seen, "one")
    size = F.size("names")
    return _row(both, "No ticker fingerprints", size == 0,
                F.concat(size.cast("string"), F.lit(" static columns over "), F.col("n").cast("string"),
                         F.lit(" tickers")),
                F.concat(F.lit("static columns: "),
                         F.when(size == 0, "none").otherwise(F.array_join("names", ", "))))


# ------------------------------------------------------------------- folds
def cv_ordering(summary: DataFrame, params: JobParams = JobParams()) -> DataFrame:
    agg = summary.agg(F.count(F.lit(1)).alias("n"), F.min("gap_trading_days").alias("gap"),
                      F.bool_and("ordering_ok").alias("ok"))
    none = F.col("n") == 0
    return _row(
        agg, "Temporal folds with embargo", ~none & F.col("ok"),
        F.when(none, "0 folds").otherwise(F.concat(
            F.lit("min gap "), F.col("gap").cast("string"), F.lit(f" against embargo {params.embargo} over "),
            F.col("n").cast("string"), F.lit(" folds"))),
        F.when(none, "no folds recorded").when(F.col("ok"), "every fold keeps the embargo")
        .otherwise("a fold breaks the embargo"))


# ---------------------------------------------------------------- backtest
def _error(perf: DataFrame, lead: str) -> Column:
    return F.max(F.when(F.col("strategy") == lead, F.col("error")))


def costs_active(perf: DataFrame, params: JobParams = JobParams(), lead: str = "strategy") -> DataFrame:
    """A configured rate, and costs paid by the strategy or at least by equal weight."""
    def of(name: str, col: str) -> Column:
        return F.coalesce(F.max(F.when((F.col("strategy") == name) & F.col("error").isNull(), F.col(col))),
                          F.lit(0.0))

    agg = perf.agg(of(lead, "total_costs").alias("own"), of("equal_weight", "total_costs").alias("ew"),
                   of(lead, "turnover_annualized").alias("turn"), _error(perf, lead).alias("err"))
    fine = F.col("err").isNull()
    paid = (F.col("own") > 0) | (F.col("ew") > 0)
    return _row(
        agg, "Costs applied", fine & paid & F.lit(params.cost_bps >= MIN_COST_BPS),
        F.when(~fine, "window not run").otherwise(F.concat(
            F.lit(f"{params.cost_bps:.0f} bps per side, strategy "), _fixed(F.col("own"), 0),
            F.lit(" at turnover "), _fixed(F.col("turn") * 100, 0), F.lit(" %/yr, equal weight "),
            _fixed(F.col("ew"), 0))),
        F.when(~fine, F.col("err")).otherwise(F.format_string("paid: strategy %.0f, equal weight %.0f", "own", "ew")))


def benchmarks_present(perf: DataFrame, lead: str = "strategy") -> DataFrame:
    """Equal weight must be there; the index series may be missing."""
    def has(name: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("strategy") == name, F.col("error").isNull())), F.lit(False))

    agg = perf.agg(has("equal_weight").alias("ew"), has("index").alias("ix"), _error(perf, lead).alias("err"))
    fine = F.col("err").isNull()
    names = F.concat_ws(", ", F.when(F.col("ew"), "equal_weight"), F.when(F.col("ix"), "index"))
    return _row(
        agg, "Benchmarks on identical dates", fine & F.col("ew"),
        F.when(~fine, "window not run").otherwise(F.concat(
            F.lit("present: "), F.when(names == "", "none").otherwise(names))),
        F.when(~fine, F.col("err")).when(F.col("ix"), "index available").otherwise("index unavailable"))


# ----------------------------------------------------------- falsification
def permutation_gate(r2: DataFrame) -> DataFrame:
    """Gate: out-of-fold R2 on permuted labels must vanish. ``r2(kind, oof_r2)``; no rounds fail."""
    perm = F.when(F.col("kind") == "permuted", F.col("oof_r2"))
    agg = r2.agg(F.max(perm).alias("top"), F.avg(perm).alias("mean"), F.count(perm).alias("n"),
                 F.max(F.when(F.col("kind") == "real", F.col("oof_r2"))).alias("real"))
    none = F.col("n") == 0
    return _row(
        agg, "Falsification gate: permuted labels", ~none & (F.col("top") < PERMUTATION_TOLERANCE),
        F.when(none, "not run").otherwise(F.concat(
            F.lit("permuted R2 max "), _fixed(F.col("top")), F.lit(" mean "), _fixed(F.col("mean")),
            F.lit(" real "), F.coalesce(_fixed(F.col("real")), F.lit("n/a")))),
        F.when(none, "no permutation round produced an R2").otherwise(F.concat(
            F.lit("permutation rounds: "), F.col("n").cast("string"))), gating=True)


def feature_lag(r2: DataFrame) -> DataFrame:
    """One more day of lag must not raise R2."""
    agg = r2.agg(F.max(F.when(F.col("kind") == "real", F.col("oof_r2"))).alias("real"),
                 F.max(F.when(F.col("kind") == "lagged", F.col("oof_r2"))).alias("lagged"))
    delta = F.col("lagged") - F.col("real")
    return _row(
        agg, "Feature-lag test", delta <= LAG_TOLERANCE,
        F.when(delta.isNull(), "not run").otherwise(F.concat(F.lit("lagged - real "), _fixed(delta))),
        F.when(delta.isNull(), "one of the two R2 values is missing").otherwise(F.concat(
            F.lit("real "), _fixed(F.col("real")), F.lit(", lagged "), _fixed(F.col("lagged")))))


def survivorship(rows: DataFrame) -> DataFrame:
    """How many tickers are still there in the last month of all rows (ticker, date). A disclosure, so it always passes."""
    last = rows.groupBy("ticker").agg(F.max("date").alias("last"))
    end = last.agg(F.max("last").alias("end"))
    agg = last.crossJoin(F.broadcast(end)).agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum((F.datediff("end", "last") <= 31).cast("int")), F.lit(0)).alias("live"))
    return _row(agg, "Survivors in the universe", F.lit(True),
                F.format_string("%d of %d tickers have rows in the last 31 days", "live", "n"),
                F.format_string("tickers that ended earlier: %d", F.col("n") - F.col("live")))


def gate(checks: DataFrame) -> DataFrame:
    """Roll-up: counts, whether every gating check passed, and the gate's state."""
    gating = F.when(F.col("gating"), F.col("passed"))
    agg = checks.agg(F.count(F.lit(1)).alias("n_checks"),
                     F.coalesce(F.sum(F.col("passed").cast("int")), F.lit(0)).alias("n_passed"),
                     F.bool_and(gating).alias("all_ok"), F.count(gating).alias("n_gating"))
    ok = (F.col("n_checks") > 0) & F.coalesce(F.col("all_ok"), F.lit(True))
    return agg.select(
        "n_checks", "n_passed", "n_gating", ok.alias("gate_ok"),
        F.when(ok & (F.col("n_checks") > 0) & (F.col("n_gating") > 0), "PASSED")
        .when(F.col("n_gating") > 0, "FAILED").when(ok, "PASSED").otherwise("NOT RUN").alias("gate_state"))


def report(spark: SparkSession, *, changes: DataFrame, feats: DataFrame, summary: DataFrame,
           perf: DataFrame, r2: DataFrame | None, run_lag: bool = True,
           params: JobParams = JobParams()) -> DataFrame:
    """All checks in order. Without permutation rounds the failing gate row is still there."""
    empty = spark.createDataFrame([], "kind string, oof_r2 double")
    r2 = empty if r2 is None else r2
    parts = [no_lookahead(changes), no_fingerprints(feats), cv_ordering(summary, params),
             costs_active(perf, params), benchmarks_present(perf), permutation_gate(r2)]
    if run_lag:
        parts.append(feature_lag(r2))
    parts.append(survivorship(feats))
    out = parts[0].withColumn("ord", F.lit(0))
    for i, p in enumerate(parts[1:], 1):
        out = out.unionByName(p.withColumn("ord", F.lit(i)))
    return out
