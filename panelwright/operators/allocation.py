"""Capped allocation over the candidates of each as-of day.

A day has at most ``2 * max_positions`` candidates with at most a year of
returns each, so one day's problem is one row of small arrays whose size is set
by the parameters; days are processed side by side. All arithmetic is
higher-order array functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions import windows as w
from panelwright.operators.signals import VOL_FLOOR
from panelwright.params import JobParams

# Fixed values.
MIN_RETURNS = 20
SPARE_ROWS = 5
HELD = 0.01
# Our search grid: raw weight = er^g / vol^d, then capped.
RULES = [(g, d) for g in (0.0, 1.0, 2.0) for d in (0.0, 1.0, 2.0)]
CAP_ROUNDS = 30


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def _dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x * y))


def trailing_returns(cands: DataFrame, bars: DataFrame, params: JobParams = JobParams()) -> DataFrame:
    """Newest-first daily returns up to the as-of day, at most a year, per candidate.

    A candidate without bars counts as a year of zero returns.
    """
    year = params.trading_days
    close = F.col("close").cast("double")
    daily = bars.select("ticker", "date", (w.ratio(close, F.lag(close).over(w.dated())) - 1).alias("ret"))
    picked = cands.select("as_of", "ticker").join(daily, "ticker").where(
        (F.col("date") <= F.col("as_of")) & F.col("ret").isNotNull())
    newest = Window.partitionBy("as_of", "ticker").orderBy(F.col("date").desc())
    recent = picked.withColumn("n", F.row_number().over(newest)).where(F.col("n") <= year)
    arrays = recent.groupBy("as_of", "ticker").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("n", "ret"))), lambda s: s["ret"]).alias("rets"))
    known = bars.select("ticker").distinct().withColumn("known", F.lit(True))
    out = cands.join(arrays, ["as_of", "ticker"], "left").join(known, "ticker", "left")
    zeros = F.array_repeat(F.lit(0.0), year)
    empty = F.array().cast("array<double>")
    return out.withColumn("rets", F.coalesce("rets", F.when(F.col("known").isNull(), zeros), empty)) \
        .drop("known")


def problems(with_returns: DataFrame) -> DataFrame:
    """One row per as-of day: candidates in rank order and their aligned returns.

    Returns are aligned by position from the newest one and cut to the shortest history.
    """
    item = F.struct("pick", "ticker", "expected_return", "volatility", "sector", "rets")
    rows = with_returns.groupBy("as_of").agg(F.array_sort(F.collect_list(item)).alias("c"))
    rows = rows.withColumn("m", F.array_min(F.transform("c", lambda x: F.size(x["rets"]))))
    return rows.withColumn("r", F.transform("c", lambda x: F.slice(x["rets"], F.lit(1), F.col("m"))))


def covariance(problem: DataFrame) -> DataFrame:
    """Daily covariance per as-of day: diagonal for short histories, else shrunk to a scaled identity.

    Adds ``shrink``, ``mu`` and ``cov`` (array of rows). Shrinkage follows
    Ledoit and Wolf (2004) on centred returns.
    """
    m = F.col("m")
    centred = problem.withColumn("x", F.transform("r", lambda xs: w.let(
        _sum(xs) / F.size(xs), lambda mean: F.transform(xs, lambda v: v - mean))))
    p = F.size("c")
    short = m < p + SPARE_ROWS
    s = F.transform("x", lambda a: F.transform(F.col("x"), lambda b: _dot(a, b) / m))
    out = centred.withColumn("s", F.when(m > 0, s))
    diag = F.transform("x", lambda a: _dot(a, a) / m)
    out = out.withColumn("mu", _sum(diag) / p)
    squares = _sum(F.transform("s", lambda row: _dot(row, row)))
    days = F.sequence(F.lit(1), m)
    fourth = _sum(F.transform(days, lambda k: F.pow(
        _sum(F.transform(F.col("x"), lambda a: F.get(a, k - 1) * F.get(a, k - 1))), F.lit(2.0))))
    delta = squares - p * F.col("mu") * F.col("mu")
    beta = F.least((fourth / m - squares) / m, delta)
    rho = F.when(beta == 0, F.lit(0.0)).otherwise(w.ratio(beta, delta))
    out = out.withColumn("shrink", F.when(~short, F.coalesce(rho, F.lit(0.0))))
    shrunk = F.transform("s", lambda row, i: F.transform(row, lambda v, j: (
        F.when(F.col("shrink").isNull(), F.when(i == j, v).otherwise(0.0))
        .otherwise((1 - F.col("shrink")) * v
                   + F.when(i == j, F.col("shrink") * F.col("mu")).otherwise(0.0)))))
    return out.withColumn("cov", shrunk).drop("x", "s", "r")


def covariance_rows(cov: DataFrame) -> DataFrame:
    """The matrix as (as_of, ticker_i, ticker_j, cov); its size is the parameter's square."""
    rows = cov.select("as_of", "c", F.posexplode("cov").alias("i", "row"))
    cells = rows.select("as_of", "c", "i", F.posexplode("row").alias("j", "cov"))
    return cells.select("as_of", F.get(F.col("c.ticker"), F.col("i")).alias("ticker_i"),
                        F.get(F.col("c.ticker"), F.col("j")).alias("ticker_j"), "cov")


def _capped(raw: Column, sectors: Column, params: JobParams) -> Column:
    """Fixed rounds of: scale to one, clip each position, scale down full sectors."""
    cap, room = F.lit(params.max_position_size), F.lit(params.max_sector_exposure)

    def clip(wts: Column) -> Column:
        return w.let(_sum(wts), lambda total: F.transform(wts, lambda v: F.least(v / total, cap)))

    def relieve(clipped: Column) -> Column:
        def scale(pairs: Column) -> Column:
            return F.transform(pairs, lambda a: a["w"] * F.least(F.lit(1.0), room / F.aggregate(
                pairs, F.lit(0.0), lambda acc, b: acc + F.when(b["s"] == a["s"], b["w"]).otherwise(0.0))))
        return w.let(F.zip_with(clipped, sectors, lambda v, k: F.struct(v.alias("w"), k.alias("s"))), scale)

    rounds = F.sequence(F.lit(1), F.lit(CAP_ROUNDS))
    done = F.aggregate(rounds, raw, lambda acc, _: w.let(clip(acc), relieve))
    return w.let(done, lambda d: w.let(_sum(d), lambda total: F.transform(d, lambda v: v / total)))


def optimise(cov: DataFrame, params: JobParams = JobParams()) -> DataFrame:
    """Weights per as-of day: the best Sharpe ratio over the rule grid under the caps.

    This is a search over a fixed grid of weight rules, not a continuous solver:
    same objective, caps and fallback, but not the same optimum. Equal weights
    are used when the caps cannot add up to one or histories are too short.
    Weights under the threshold go to zero and the rest is scaled to one, which
    may lift positions over the caps again. Expected returns are per horizon
    while variance and the risk-free rate are annual.
    """
    er, vol, sector = F.col("c.expected_return"), F.col("c.volatility"), F.col("c.sector")
    n = F.size("c")
    uniform = F.array_repeat(1.0 / n, n)
    # Annual covariance computed once per day.
    base = cov.withColumn("annual", F.transform("cov", lambda row: F.transform(
        row, lambda v: v * float(params.trading_days))))
    counts = F.transform(F.array_distinct(sector), lambda s: F.least(
        F.lit(params.max_sector_exposure),
        params.max_position_size * F.size(F.filter(sector, lambda t: t == s))))
    base = base.withColumn("feasible", (_sum(counts) >= 1.0 - 1e-12) & (F.col("m") >= MIN_RETURNS))
    grid = F.array(*[F.struct(F.lit(i).alias("rule"), F.lit(g).alias("g"), F.lit(d).alias("d"))
                     for i, (g, d) in enumerate(RULES)])
    tried = base.select("*", F.explode(F.when(F.col("feasible"), grid).otherwise(
        F.slice(grid, 1, 1))).alias("rule"))
    raw = F.transform("c", lambda x: F.pow(x["expected_return"], F.col("rule.g"))
                      / F.pow(F.greatest(x["volatility"], F.lit(VOL_FLOOR)), F.col("rule.d")))
    tried = tried.withColumn("w", F.when(F.col("feasible"), _capped(raw, sector, params)).otherwise(uniform))
    # Materialise the weights before they are used several times below.
    variance = _dot(F.col("w"), F.transform("annual", lambda row: _dot(row, F.col("w"))))
    sharpe = (_dot(F.col("w"), er) - params.risk_free_rate) / F.sqrt(F.greatest(variance, F.lit(1e-10)))
    best = tried.withColumn("sharpe", sharpe).groupBy("as_of").agg(
        F.max_by(F.struct("c", "w", "rule.rule", "sharpe", "feasible"),
                 F.struct(F.round("sharpe", 12), -F.col("rule.rule"))).alias("b"))
    low = params.min_weight_threshold
    kept = F.transform(F.col("b.w"), lambda v: F.when(v < low, 0.0).otherwise(v))
    out = best.select("as_of", "b.c", kept.alias("w"), "b.rule", "b.sharpe", "b.feasible")
    total = _sum(F.col("w"))
    out = out.withColumn("w", w.let(total, lambda t: F.when(
        t > 0, F.transform(F.col("w"), lambda v: v / t)).otherwise(F.col("w"))))
    rows = out.select("as_of", "rule", "sharpe", "feasible",
                      F.explode(F.arrays_zip("c", "w")).alias("z"))
    return rows.select("as_of", F.col("z.c.ticker").alias("ticker"), F.col("z.w").alias("weight"),
                       F.col("z.c.expected_return").alias("expected_return"),
                       F.col("z.c.volatility").alias("volatility"),
                       F.col("z.c.sector").alias("sector"), "rule", "sharpe", "feasible")


def held(weights: DataFrame) -> DataFrame:
    return weights.where(F.col("weight") > HELD)


def portfolio_metrics(weights: DataFrame, params: JobParams = JobParams()) -> DataFrame:
    """Return, volatility (no correlation) and concentration of the held positions."""
    wt = F.col("weight")
    agg = held(weights).groupBy("as_of").agg(
        F.sum(wt * F.col("expected_return")).alias("expected_return"),
        F.sqrt(F.sum(wt * wt * F.col("volatility") * F.col("volatility"))).alias("expected_volatility"),
        F.count(F.lit(1)).alias("num_positions"), F.max(wt).alias("max_position"))
    return agg.select(
        "as_of", "expected_return", "expected_volatility",
        ((F.col("expected_return") - params.risk_free_rate)
         / F.greatest(F.col("expected_volatility"), F.lit(VOL_FLOOR))).alias("sharpe_ratio"),
        "num_positions", "max_position")


def sector_weights(weights: DataFrame) -> DataFrame:
    return held(weights).groupBy("as_of", "sector").agg(F.sum("weight").alias("weight"))


def positions(weights: DataFrame, sig: DataFrame) -> DataFrame:
    """Held weights with their signal."""
    cols = ["as_of", "ticker", "expected_return", "ci_low", "ci_high", "confidence", "conviction", "sector"]
    return held(weights).select("as_of", "ticker", "weight").join(sig.select(*cols), ["as_of", "ticker"])
