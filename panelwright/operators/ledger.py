"""Costed portfolio accounting over a table of weight schedules.

Input is data, not a callback: ``rebalances(strategy, k, date)``,
``schedule(strategy, k, ticker, weight)``, ``policies(strategy,
invest_fraction, cost_rate, capital)`` and closes. Any number of strategies is
rolled forward in one job.

Everything scales with the portfolio value, so a rebalance is described by two
numbers per (strategy, k): ``scale``, the share of value left for targets after
the estimated cost, and ``cash``. They depend on the previous rebalance only
through the drifted holdings. Parallel passes over all rebalances solve the
recursion: after pass p the first p rebalances of every strategy are final, and
at usual cost rates all are after a few, as an error shrinks by about four cost
rates a pass. Passes end when nothing changes any more.

A pass puts the state beside the legs, adds up parts of each rebalance where the
legs are, and only then by rebalance, so that one with very many legs is spread
over tasks: the state is broadcast where its measured size allows, and is joined
with salted keys where it doesn't.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions import sizing, windows as w
from panelwright.params import JobParams

TRADE_FLOOR = 1.0
#: Change of scale and cash below which a pass has changed nothing; parts a rebalance is dealt into where states are many.
SETTLED = 1e-15
SALTS = 64
KEY = ["strategy", "k"]


# ---------------------------------------------------------------- calendar
def common_calendar(bars: DataFrame, start=None, end=None) -> DataFrame:
    """Dates on which every ticker has a bar, numbered from 0."""
    total = bars.select("ticker").distinct().count()
    days = bars.groupBy("date").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == total)
    if start is not None:
        days = days.where(F.col("date") >= F.lit(start))
    if end is not None:
        days = days.where(F.col("date") <= F.lit(end))
    return days.select("date", (F.row_number().over(Window.orderBy("date")) - 1).alias("pos"))


def align_series(series: DataFrame, dates: DataFrame) -> DataFrame:
    """Latest close at or before each date; NULL before the series starts.

    Both sides have at most one row per day, so one ordered pass is enough.
    """
    marks = (series.select("date", F.col("close").cast("double").alias("close"), F.lit(False).alias("asked"))
             .unionByName(dates.select("date", F.lit(None).cast("double").alias("close"),
                                       F.lit(True).alias("asked"))))
    order = Window.orderBy("date", "asked").rowsBetween(Window.unboundedPreceding, 0)
    filled = marks.withColumn("close", F.last("close", ignorenulls=True).over(order))
    return filled.where("asked").select("date", "close")


def rebalance_dates(calendar: DataFrame, params: JobParams = JobParams()) -> DataFrame:
    """Every ``rebalance_every``-th common date after the warm-up, never the last one."""
    whole = Window.partitionBy()
    sized = calendar.select("date", "pos", F.count(F.lit(1)).over(whole).alias("n"),
                            F.max("date").over(whole).alias("end_date"))
    start = F.least(F.lit(params.first_rebalance), F.floor(F.col("n") / 2))
    step = params.rebalance_every
    picked = sized.where((F.col("pos") >= start) & ((F.col("pos") - start) % step == 0)
                         & (F.col("date") < F.col("end_date")))
    return picked.select(((F.col("pos") - start) / step).cast("int").alias("k"), "date", "end_date")


#: Why a window can't be run: codes, in the order of the tests.
NO_DAYS, FEW_DAYS, NO_PERIODS = "no_common_days", "too_few_days", "no_periods"
LEAST_DAYS, LEAST_REBALANCES = 100, 2


def window_status(calendar: DataFrame, params: JobParams = JobParams()) -> DataFrame:
    """One row: days, rebalances, and the code of why a backtest over this calendar can't run, or NULL."""
    days = calendar.agg(F.count(F.lit(1)).alias("days"))
    found = rebalance_dates(calendar, params).agg(F.count(F.lit(1)).alias("rebalances"))
    code = (F.when(F.col("days") == 0, NO_DAYS).when(F.col("days") < LEAST_DAYS, FEW_DAYS)
            .when(F.col("rebalances") < LEAST_REBALANCES, NO_PERIODS))
    return days.crossJoin(found).select("days", "rebalances", code.alias("error"))


# --------------------------------------------------------------- schedules
def equal_weight(n_rebalances: int, tickers: DataFrame, n_tickers: int,
                 strategy: str = "equal_weight") -> DataFrame:
    """1/N in every ticker at every rebalance."""
    ks = F.sequence(F.lit(0), F.lit(n_rebalances - 1))
    return tickers.select("ticker").distinct().select(
        F.lit(strategy).alias("strategy"), F.explode(ks).alias("k"), "ticker",
        F.lit(1.0 / n_tickers).alias("weight"))


def single_holding(rebalances: DataFrame, ticker: str, strategy: str) -> DataFrame:
    return rebalances.select(F.lit(strategy).alias("strategy"), "k", F.lit(ticker).alias("ticker"),
                             F.lit(1.0).alias("weight"))


# ------------------------------------------------------------- one rebalance
def rebalance_costs(current: DataFrame, target: DataFrame, terms: DataFrame) -> DataFrame:
    """Two-pass sizing of independent rebalances.

    ``current(id, ticker, dollars)``, ``target(id, ticker, weight)``,
    ``terms(id, value, invest_fraction, cost_rate)``. The first pass estimates
    the cost, the second sizes targets on the value net of it.
    """
    legs = (current.select("id", "ticker", "dollars", F.lit(0.0).alias("weight"))
            .unionByName(target.select("id", "ticker", F.lit(0.0).alias("dollars"), "weight"))
            .groupBy("id", "ticker").agg(F.sum("dollars").alias("dollars"), F.sum("weight").alias("weight")))
    priced = legs.join(terms, "id")
    gross = F.col("weight") * F.col("invest_fraction")
    est = priced.groupBy("id").agg(
        F.sum(F.abs(gross * F.col("value") - F.col("dollars"))).alias("est"))
    net = F.col("value") - F.col("est") * F.col("cost_rate")
    sized = priced.join(est, "id").withColumn("goal", gross * net)
    out = sized.groupBy("id").agg(
        F.sum(F.abs(F.col("goal") - F.col("dollars"))).alias("traded"),
        F.sum("goal").alias("invested"), F.first("cost_rate").alias("rate"))
    return out.select("id", "traded", (F.col("traded") * F.col("rate")).alias("cost"), "invested")


# ------------------------------------------------------------ roll-forward
def legs(closes: DataFrame, schedule: DataFrame, rebalances: DataFrame) -> DataFrame:
    """Per (strategy, k, ticker): target weight and drifted previous weight.

    Weights without a finite positive price are dropped. Row k = last+1 stands
    for the valuation at the end date. A holding whose price has fallen to zero
    is worth nothing; one without a price on the next date is valued at its last
    one before.
    """
    per = Window.partitionBy("strategy").orderBy("k")
    dates = rebalances.select("strategy", "k", "date",
                              F.coalesce(F.lead("date").over(per), F.col("end_date")).alias("next"))
    px = closes.select("date", "ticker", w.finite(F.col("close").cast("double")).alias("p")).where("p IS NOT NULL")
    after = px.select(F.col("date").alias("next"), "ticker", F.col("p").alias("p_next"))
    rows = schedule.join(dates, KEY).join(px.where("p > 0"), ["date", "ticker"]).join(after, ["next", "ticker"], "left")
    # Only holdings without a price look for one in the days since the rebalance.
    open_ = rows.where("p_next IS NULL").select("ticker", F.col("date").alias("bought"), "next").distinct()
    seen = open_.join(px, "ticker").where("date >= bought AND date < next").groupBy("ticker", F.col("bought").alias("date"), "next").agg(
        F.max_by("p", "date").alias("p_last"))
    rows = rows.join(seen, ["ticker", "date", "next"], "left")
    rows = rows.select("strategy", "k", "ticker", "weight",
                       (F.col("weight") * F.coalesce("p_next", "p_last") / F.col("p")).alias("drift"))
    both = (rows.select("strategy", "k", "ticker", "weight", F.lit(0.0).alias("drift"))
            .unionByName(rows.select("strategy", (F.col("k") + 1).alias("k"), "ticker",
                                     F.lit(0.0).alias("weight"), "drift")))
    return both.groupBy("strategy", "k", "ticker").agg(
        F.sum("weight").alias("weight"), F.sum("drift").alias("drift"))


def _steps(rebalances: DataFrame, policies: DataFrame) -> DataFrame:
    """All (strategy, k), the end valuation included, with the policy of the strategy."""
    end = rebalances.groupBy("strategy").agg((F.max("k") + 1).alias("k"), F.max("end_date").alias("date"))
    steps = (rebalances.select("strategy", "k", "date", F.lit(False).alias("is_end"))
             .unionByName(end.select("strategy", "k", "date", F.lit(True).alias("is_end"))))
    return steps.join(policies, "strategy")


def _linked(state: DataFrame) -> DataFrame:
    """Growth since the previous rebalance and the factor turning drift into a share of value."""
    per = Window.partitionBy("strategy").orderBy("k")
    prev_scale, prev_cash = F.lag("scale").over(per), F.lag("cash").over(per)
    f = F.col("invest_fraction")
    grown = state.withColumns({
        "growth": F.coalesce(prev_cash + f * prev_scale * F.col("sum_d"), F.lit(1.0)),
        "held": F.coalesce(f * prev_scale, F.lit(0.0))})
    return grown.withColumn("unit", F.coalesce(w.ratio(F.col("held"), F.col("growth")), F.lit(0.0))).drop("held")


def _beside(rows: DataFrame, state: DataFrame) -> DataFrame:
    """The legs with the state of their rebalance, without moving legs by rebalance alone."""
    if sizing.fits_broadcast(state):
        return rows.join(F.broadcast(state), KEY)
    parts = F.pmod(F.xxhash64("ticker"), F.lit(SALTS)).cast("int")
    dealt = state.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("part", parts).join(dealt, [*KEY, "part"]).drop("part")


def _with_sums(state: DataFrame, rows: DataFrame, sums: dict) -> DataFrame:
    """Add sums over each step's legs to the step itself. Steps without legs keep their row."""
    found = _beside(rows, state).groupBy(*KEY).agg(*[e.alias(n) for n, e in sums.items()])
    return state.join(found, KEY, "left").select(
        *state.columns, *[F.coalesce(F.col(n), F.lit(0.0)).alias(n) for n in sums])


def _solve(rows: DataFrame, steps: DataFrame) -> DataFrame:
    """Scale, cash, growth and drift factor per (strategy, k)."""
    state = _with_sums(steps, rows, {"sum_w": F.sum("weight"), "sum_d": F.sum("drift")})
    state = sizing.cut(state.withColumns({
        "scale": F.lit(1.0), "cash": 1.0 - F.col("invest_fraction") * F.col("sum_w")}))
    goal = F.col("invest_fraction") * F.col("weight")
    have = F.col("unit") * F.col("drift")
    last = state.agg(F.max("k")).first()[0]
    for _ in range(0 if last is None else last + 1):
        summed = _with_sums(_linked(state), rows, {
            "est": F.sum(F.abs(goal - have)), "traded": F.sum(F.abs(goal * F.col("scale") - have))})
        scale = 1.0 - F.col("cost_rate") * F.col("est")
        cash = F.greatest(F.lit(0.0), 1.0 - F.col("cost_rate") * F.col("traded")
                          - F.col("invest_fraction") * scale * F.col("sum_w"))
        keep = [c for c in state.columns if c not in ("scale", "cash", "moved")]
        moved = F.abs(scale - F.col("scale")) + F.abs(cash - F.col("cash"))
        # Stored, so each pass is planned on its own instead of as part of one
        # ever longer plan; the state is one row per (strategy, k).
        state = sizing.cut(summed.select(*keep, scale.alias("scale"), cash.alias("cash"), moved.alias("moved")))
        if state.agg(F.max("moved")).first()[0] < SETTLED:
            break
    return _linked(state.drop("moved"))


def roll_forward(closes: DataFrame, schedule: DataFrame, rebalances: DataFrame,
                 policies: DataFrame) -> DataFrame:
    """Ledger: one row per rebalance plus the end valuation of every strategy.

    ``rebalances`` carries ``strategy, k, date, end_date``. ``value`` is net of
    the cost paid on that date, so the first value is already after entry cost.
    """
    rows = sizing.cut(legs(closes, schedule, rebalances))
    steps = sizing.cut(_steps(rebalances, policies))
    solved = sizing.cut(_solve(rows, steps))
    per = Window.partitionBy("strategy").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    valued = solved.withColumn("gross_value", F.col("capital") * F.product("growth").over(per))
    goal = F.col("invest_fraction") * F.col("weight") * F.col("scale")
    move = F.abs(goal - F.col("unit") * F.col("drift"))
    out = _with_sums(valued, rows, {
        "turnover": F.sum(move), "n_positions": F.sum(F.when(goal > 0, 1).otherwise(0)),
        "n_trades": F.sum(F.when(move * F.col("gross_value") > TRADE_FLOOR, 1).otherwise(0))})
    # Nothing is bought or sold once all is lost.
    out = out.withColumns({c: F.when(F.col("gross_value") != 0, F.col(c)).otherwise(0) for c in ("turnover", "n_positions")})
    live = ~F.col("is_end")
    cost = F.when(live, F.col("gross_value") * F.col("turnover") * F.col("cost_rate")).otherwise(0.0)
    return out.select(
        "strategy", "k", "date", "is_end", (F.col("gross_value") - cost).alias("value"),
        cost.alias("cost"), F.when(live, F.col("turnover")).alias("turnover"),
        F.when(live, F.col("n_positions").cast("long")).alias("n_positions"),
        F.when(live, F.col("n_trades").cast("long")).alias("n_trades"))


# ----------------------------------------------------------------- metrics
def period_returns(values: DataFrame) -> DataFrame:
    """Return of every step of a value path (strategy, date, value); the first step has none."""
    per = Window.partitionBy("strategy").orderBy("date")
    return values.select("strategy", "date", "value",
                         (w.ratio(F.col("value"), F.lag("value").over(per)) - 1).alias("period_return"))


def series_metrics(values: DataFrame, params: JobParams = JobParams(),
                   periods_per_year: float | None = None) -> DataFrame:
    """Net performance per strategy from its value path. A path has one row per rebalance."""
    ppy = params.periods_per_year if periods_per_year is None else periods_per_year
    per = Window.partitionBy("strategy").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    path = period_returns(values).withColumn("peak", F.max("value").over(per))
    agg = path.groupBy("strategy").agg(
        F.min_by("value", "date").alias("first"), F.max_by("value", "date").alias("final_value"),
        F.datediff(F.max("date"), F.min("date")).alias("days"),
        F.stddev_samp("period_return").alias("sd"), F.count("period_return").alias("n_periods"),
        F.min(F.col("value") / F.col("peak") - 1).alias("max_drawdown"))
    growth = F.col("final_value") / F.col("first")
    years = F.greatest(F.lit(0.1), F.col("days") / F.lit(365.25))
    rows = agg.select(
        "strategy", (growth - 1).alias("total_return"), (F.pow(growth, 1 / years) - 1).alias("cagr"),
        F.when(F.col("n_periods") > 1, F.col("sd") * math.sqrt(ppy)).otherwise(0.0).alias("volatility"),
        "max_drawdown", "final_value", years.alias("years"), "n_periods")
    sharpe = (F.col("cagr") - params.risk_free_rate) / F.greatest(F.col("volatility"), F.lit(1e-4))
    return rows.withColumn("sharpe_ratio", sharpe)


def performance(ledger: DataFrame, params: JobParams = JobParams(), lead: str = "strategy",
                policies: DataFrame | None = None, status: DataFrame | None = None) -> DataFrame:
    """Metrics, costs, annual turnover and active growth against the ``lead`` strategy.

    With ``policies`` and ``status`` (window_status) every strategy has a row: its metrics, or none of them and the error of a
    window that can't be run.
    """
    metrics = series_metrics(ledger.select("strategy", "date", "value"), params)
    flows = ledger.groupBy("strategy").agg(
        (F.avg("turnover") * params.periods_per_year).alias("turnover_annualized"),
        F.sum("cost").alias("total_costs"), F.sum("n_trades").alias("num_trades"))
    both = metrics.join(flows, "strategy")
    own = both.agg(F.max(F.when(F.col("strategy") == lead, F.col("cagr"))).alias("lead_cagr"))
    out = both.crossJoin(F.broadcast(own)).withColumn(
        "active_cagr", F.when(F.col("strategy") != lead, F.col("lead_cagr") - F.col("cagr"))).drop("lead_cagr")
    if status is None:
        return out.withColumn("error", F.lit(None).cast("string"))
    fine = out.crossJoin(F.broadcast(status.select("error"))).where("error IS NULL").drop("error")
    return policies.select("strategy").join(fine, "strategy", "left").crossJoin(F.broadcast(status.select("error")))
