"""Indicator columns for all tickers in one pass.

A value at day t uses rows up to and including t of the same ticker. All columns
are taken by numpy over whole tickers, whose rows the calendar bounds, where
Spark deals and sorts them; a few tickers lie side by side in one array, and only
complete rows leave the pass.

Work per row does not grow with the window length. Means are differences of
running sums: prices are 24-bit floats widened to double, so those sums carry no
rounding error and the difference equals the direct sum. Moments and extremes of
long windows are merged from lagged 5-, 7- and 10-row blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.functions import rolling as rl, sizing, windows as w
from panelwright.params import JobParams

# Column families and their spans.
AVERAGE_SPANS = [10, 21, 50, 100, 200]
RETURN_SPANS = [5, 10, 21, 42, 63, 126, 252]
MOMENTUM_SPANS = {"mom_12_1": 252, "mom_6_1": 126, "mom_3_1": 63}
SKIP_DAYS = 21
VOL_SPANS = [10, 21, 63]
RSI_SPANS = [7, 14, 21]
REL_VOLUME_SPANS = [5, 21]
ZSCORE_SPANS = [21, 50]
REVERSION_SPANS = [5, 21]
MACD_FAST, MACD_SLOW, MACD_SIGNAL = 12, 26, 9
EMA_SPANS = sorted({*AVERAGE_SPANS, MACD_FAST, MACD_SLOW, MACD_SIGNAL})
BAND_SPAN = 20
YEAR = 252
MONTH = 21
EPS = 1e-8
FLAT_VARIANCE = 1e-14

FEATURES = (
    [f"price_sma_{n}" for n in AVERAGE_SPANS]
    + [f"price_ema_{n}" for n in AVERAGE_SPANS]
    + [f"ret_{n}d" for n in RETURN_SPANS]
    + list(MOMENTUM_SPANS)
    + [f"vol_{n}d" for n in VOL_SPANS]
    + ["vol_ratio", "parkinson_vol_21"]
    + [f"rsi_{n}" for n in RSI_SPANS]
    + ["macd_hist", "macd_hist_norm", "bb_position", "bb_width"]
    + [f"rel_vol_{n}" for n in REL_VOLUME_SPANS]
    + ["obv_trend", "dist_52w_high", "dist_52w_low", "breakout_20d", "golden_cross_dist",
       "skew_21", "kurt_21"]
    + [f"zscore_{n}" for n in ZSCORE_SPANS]
    + [f"mean_rev_{n}" for n in REVERSION_SPANS]
)


def _lag(name: str, n: int) -> Column:
    return F.lag(name, n).over(w.history())


def _rolled(c: np.ndarray, h: np.ndarray, low: np.ndarray, v: np.ndarray, horizon: int) -> dict[str, np.ndarray]:
    """Lagged prices, rolling sums, extremes and exponential means of tickers' rows, in order of date.

    Only 5-, 7- and 10-row frames go over rows; every longer window is put together from running sums or from
    lagged copies of these blocks.
    """
    c1 = rl.back(c, 1)
    ret, move = rl.ratio(c, c1) - 1, c - c1
    sums = {"c": rl.running(c), "v": rl.running(v),
            "gain": rl.running(np.fmax(move, 0.0)), "loss": rl.running(np.fmax(-move, 0.0))}
    out = {"y": rl.ratio(rl.back(c, -horizon), c) - 1}
    for n in RETURN_SPANS:
        out[f"ret_{n}d"] = rl.ratio(c, rl.back(c, n)) - 1
    for name, n in MOMENTUM_SPANS.items():
        out[name] = rl.ratio(rl.back(c, SKIP_DAYS), rl.back(c, SKIP_DAYS + n)) - 1
    # Powers of the returns and the day's range.
    powers = {1: ret, 2: ret * ret, 3: ret * ret * ret, 4: ret * ret * ret * ret}
    five, seven = {k: rl.near(powers[k], 5)[0] for k in (1, 2)}, {k: rl.near(x, 7)[0] for k, x in powers.items()}
    out["r1_5"] = five[1]
    out |= {f"r{k}_10": rl.stacked(five[k], range(0, 10, 5)) for k in (1, 2)}
    out |= {f"r{k}_21": rl.stacked(seven[k], range(0, 21, 7)) for k in (1, 2, 3, 4)}
    out |= {f"r{k}_63": rl.stacked(seven[k], range(0, 63, 7)) for k in (1, 2)}
    wide = rl.ratio(h, low)
    range_7, seen_7 = rl.near(np.log(wide, out=np.full(c.shape, np.nan), where=wide > 0), 7)
    whole = rl.stacked(seen_7, range(0, MONTH, 7)) == MONTH
    out["range_21"] = np.where(whole, rl.stacked(range_7, range(0, MONTH, 7)) / MONTH, np.nan)
    # Extremes.
    out["prior_high"] = rl.stacked(rl.near_best(h, 5), range(1, BAND_SPAN + 1, 5), np.fmax)
    half_seasons = [1 + 42 * k for k in range(YEAR // 42)]
    for name, best in (("top_year", np.fmax), ("bottom_year", np.fmin)):
        season = rl.stacked(rl.near_best(c, 7, best), range(0, 42, 7), best)
        out[name] = rl.after(YEAR, rl.stacked(season, half_seasons, best))
    # Squared deviations, merged from 10-row blocks around the common mean.
    ten, seen = rl.near(c, 10)
    m2_10 = np.zeros(c.shape)
    for k in range(9, -1, -1):
        gap = rl.back(c, k) - ten / seen
        m2_10 += np.nan_to_num(gap * gap)
    m2_10 *= 10 / seen

    def spread(n: int) -> np.ndarray:
        centre = rl.span_sum(sums["c"], n) / n
        gaps = [rl.span_sum(sums["c"], 10, k) / 10 - centre for k in range(0, n, 10)]
        return rl.stacked(m2_10, range(0, n, 10)) + 10 * sum([g * g for g in gaps[1:]], gaps[0] * gaps[0])

    before = rl.back(c, BAND_SPAN) - rl.span_sum(sums["c"], BAND_SPAN) / BAND_SPAN
    out["m2_c_20"], out["m2_c_50"] = rl.after(19, spread(20)), rl.after(49, spread(50))
    out["m2_c_21"] = rl.after(20, spread(20) + before * before * (20 / 21))
    # Means.
    for n in sorted({*AVERAGE_SPANS, BAND_SPAN}):
        out[f"sma_{n}"] = rl.after(n - 1, rl.span_sum(sums["c"], n) / n)
    for n in RSI_SPANS:
        out |= {f"{x}_{n}": rl.after(n, rl.span_sum(sums[x], n) / n) for x in ("gain", "loss")}
    for n in REL_VOLUME_SPANS:
        out[f"prior_v_{n}"] = rl.after(n, rl.span_sum(sums["v"], n, 1) / n)
    out["sum_flow"] = rl.running(np.nan_to_num(np.sign(ret)) * v)
    obv = rl.running(out["sum_flow"])
    out["obv_base"] = rl.after(MONTH, rl.span_sum(obv, MONTH, 1) / MONTH)
    return out | {f"ema_{n}": y for n, y in zip(EMA_SPANS, rl.exponential_means(c, tuple(EMA_SPANS)))}


def _signal_line(r: dict[str, np.ndarray]) -> np.ndarray:
    """Exponential mean of the fast-minus-slow line.

    An exponential mean of an exponential mean is a fixed combination of the
    two single ones (partial fractions), so no second pass is needed.
    """
    def keep(n: int) -> float:
        return 1.0 - 2.0 / (n + 1.0)

    def chained(n: int) -> np.ndarray:
        k, ks = keep(n), keep(MACD_SIGNAL)
        return (r[f"ema_{n}"] * ((1 - ks) * k / (k - ks))
                - r[f"ema_{MACD_SIGNAL}"] * ((1 - k) * ks / (k - ks)))

    return chained(MACD_FAST) - chained(MACD_SLOW)


def _columns(r: dict[str, np.ndarray], c: np.ndarray, v: np.ndarray) -> dict[str, np.ndarray]:
    """The 45 columns from rolling values; NaN in warm-up."""
    sd = {n: np.sqrt(r[f"m2_c_{n}"] / (n - 1)) for n in (BAND_SPAN, *ZSCORE_SPANS)}
    m, a2, a3, a4 = (r[f"r{k}_{MONTH}"] / MONTH for k in (1, 2, 3, 4))
    var = rl.after(MONTH, a2 - m * m)
    third = a3 - 3 * m * a2 + 2 * m * m * m
    fourth = a4 - 4 * m * a3 + 6 * m * m * a2 - 3 * m * m * m * m
    hist = r[f"ema_{MACD_FAST}"] - r[f"ema_{MACD_SLOW}"] - _signal_line(r)
    band_low, band_width = r[f"sma_{BAND_SPAN}"] - 2 * sd[BAND_SPAN], 4 * sd[BAND_SPAN]
    cols: dict[str, np.ndarray] = {}
    for n in AVERAGE_SPANS:
        cols[f"price_sma_{n}"] = rl.ratio(c, r[f"sma_{n}"])
        cols[f"price_ema_{n}"] = rl.ratio(c, r[f"ema_{n}"])
    cols |= {x: r[x] for x in (*[f"ret_{n}d" for n in RETURN_SPANS], *MOMENTUM_SPANS)}
    for n in VOL_SPANS:
        s1, s2 = r[f"r1_{n}"], r[f"r2_{n}"]
        cols[f"vol_{n}d"] = rl.after(n, np.sqrt(np.maximum(s2 - s1 * s1 / n, 0.0) / (n - 1)) * math.sqrt(YEAR))
    cols["vol_ratio"] = rl.ratio(cols["vol_21d"], cols["vol_63d"] + EPS)
    cols["parkinson_vol_21"] = r["range_21"] * math.sqrt(YEAR / (4 * math.log(2)))
    for n in RSI_SPANS:
        strength = rl.ratio(r[f"gain_{n}"], r[f"loss_{n}"] + EPS)
        cols[f"rsi_{n}"] = 100 - rl.ratio(np.full(c.shape, 100.0), 1 + strength)
    cols["macd_hist"] = hist
    cols["macd_hist_norm"] = rl.ratio(hist, c + EPS)
    cols["bb_position"] = rl.ratio(c - band_low, band_width + EPS)
    cols["bb_width"] = rl.ratio(band_width, r[f"sma_{BAND_SPAN}"] + EPS)
    for n in REL_VOLUME_SPANS:
        cols[f"rel_vol_{n}"] = rl.ratio(v, r[f"prior_v_{n}"] + 1)
    cols["obv_trend"] = rl.ratio(r["sum_flow"], r["obv_base"] + EPS)
    cols["dist_52w_high"] = rl.ratio(c, r["top_year"]) - 1
    cols["dist_52w_low"] = rl.ratio(c, r["bottom_year"]) - 1
    cols["breakout_20d"] = (c > rl.after(BAND_SPAN, r["prior_high"])).astype(float)
    cols["golden_cross_dist"] = rl.ratio(r["sma_50"], r["sma_200"] + EPS) - 1
    uneven = var > FLAT_VARIANCE
    cols["skew_21"] = np.where(uneven, w.skew_adjusted(third / (var * np.sqrt(var)), MONTH), np.nan)
    cols["kurt_21"] = np.where(uneven, w.kurt_adjusted(fourth / (var * var) - 3, MONTH), np.nan)
    for n in ZSCORE_SPANS:
        cols[f"zscore_{n}"] = rl.after(n - 1, rl.ratio(c - r[f"sma_{n}"], sd[n] + EPS))
    for n in REVERSION_SPANS:
        cols[f"mean_rev_{n}"] = rl.after(n, -r[f"r1_{n}"])
    return {f: np.where(np.isfinite(cols[f]), cols[f], np.nan) for f in FEATURES}


INDICATORS = pa.schema([
    ("ticker", pa.string()), ("date", pa.date32()), ("bar_no", pa.int32()), ("n_bars", pa.int64()), ("c", pa.float64()),
    *[(f, pa.float64()) for f in FEATURES], ("y", pa.float64()), ("label_end", pa.date32())])
STORED = pa.schema([
    ("ticker", pa.string()), ("date", pa.date32()), ("bar_no", pa.int32()), *[(f, pa.float32()) for f in FEATURES],
    ("y", pa.float64()), ("label_end", pa.date32()), ("row_no", pa.int64()), ("n_rows", pa.int64())])
#: Cells of the arrays that hold several tickers side by side, each as long as the longest; one ticker may have more.
CELLS = 1 << 14


def _declared(shape: pa.Schema) -> str:
    kinds = {pa.string(): "string", pa.date32(): "date", pa.int32(): "int", pa.int64(): "long", pa.float32(): "float", pa.float64(): "double"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in shape)


def _bar_values(bars: DataFrame) -> DataFrame:
    d = "double"
    return bars.select("ticker", "date", F.col("close").cast(d).alias("c"), F.col("high").cast(d).alias("h"),
                       F.col("low").cast(d).alias("l"), F.col("volume").cast(d).alias("v"))


def _taken(rows: pa.Table, sizes: np.ndarray, shape: pa.Schema, params: JobParams) -> pa.Table:
    """The columns of ``shape`` for whole tickers that follow each other, each in order of date.

    Of STORED only complete rows of tickers with enough of them are left, of INDICATORS all.
    """
    i = np.arange(sizes.max(), dtype=np.int32)
    there = i < sizes[:, None]

    def wide(name: str) -> np.ndarray:
        out = np.full(there.shape, np.nan)
        out[there] = rows.column(name).to_numpy()
        return out

    c, h, low, v = (wide(x) for x in ("c", "h", "l", "v"))
    with np.errstate(all="ignore"):
        rolled = _rolled(c, h, low, v, params.horizon)
        made = _columns(rolled, c, v) | {"y": rolled["y"], "c": c}
        made |= {"bar_no": np.broadcast_to(i, there.shape), "n_bars": np.broadcast_to(sizes[:, None], there.shape)}
        kept = there
        if "row_no" in shape.names:
            ok = np.logical_and.reduce([there, *[~np.isnan(made[f]) for f in FEATURES]])
            n = ok.sum(axis=1)[:, None]
            kept = ok & (n > params.min_feature_rows)
            made |= {"row_no": np.cumsum(ok, axis=1), "n_rows": np.broadcast_to(n, there.shape)}
            made |= {f: made[f].astype(np.float32) for f in FEATURES}
    at, later = np.flatnonzero(kept[there]), there & (i + params.horizon < sizes[:, None])
    date = rows.column("date").combine_chunks()
    own = {"ticker": rows.column("ticker").combine_chunks().take(pa.array(at)), "date": date.take(pa.array(at)),
           "label_end": date.take(pa.array(np.where(later[kept], at + params.horizon, 0), mask=~later[kept]))}
    return pa.Table.from_arrays([own[f.name] if f.name in own else pa.array(made[f.name][kept], f.type, from_pandas=True) for f in shape],
                                schema=shape)


def indicator_rows(bars: DataFrame, params: JobParams = JobParams()) -> DataFrame:
    """All indicator columns on every row of tickers that pass the length gate, NULL in warm-up."""
    def run(rows: pa.Table) -> pa.Table:
        if rows.num_rows < params.min_feature_bars:
            return INDICATORS.empty_table()
        return _taken(rows.sort_by("date"), np.array([rows.num_rows]), INDICATORS, params)

    rows = _bar_values(bars).groupBy("ticker").applyInArrow(run, _declared(INDICATORS))
    return rows.select("ticker", "date", w.segment_of(F.col("date")).alias("seg"), *rows.columns[2:])


def whole_tickers(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows that come in order of ticker, in tables of whole tickers, with the number of rows of each.

    Memory is bounded by a batch and the rows of one ticker.
    """
    def sizes(rows: pa.Table) -> np.ndarray:
        ends = pc.run_end_encode(rows.column("ticker").combine_chunks()).run_ends.to_numpy()
        return np.diff(ends, prepend=0)

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        first, last = batch.column("ticker")[0].as_py(), batch.column("ticker")[-1].as_py()
        if first != last or (held and held[0].column("ticker")[0].as_py() != last):
            rows = pa.Table.from_batches([*held, batch])
            found = sizes(rows)
            whole = rows.num_rows - int(found[-1])
            yield rows.slice(0, whole), found[:-1]
            held = rows.slice(whole).to_batches()
        else:
            held.append(batch)
    if held:
        rows = pa.Table.from_batches(held)
        yield rows, sizes(rows)


def features(bars: DataFrame, params: JobParams = JobParams()) -> DataFrame:
    """Complete indicator rows of tickers with more than ``min_feature_rows`` of them.

    ``y`` and ``label_end`` are the forward return over ``horizon`` rows of the
    ticker's own calendar; they ride along because they share the pass.
    ``row_no`` counts a ticker's complete rows from 1. Rows lie where ``sizing.dealt``
    puts their ticker, and rows in warm-up never leave the pass.
    """
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, sizes in whole_tickers(batches):
            long = sizes >= params.min_feature_bars
            rows, sizes = rows.filter(pa.array(np.repeat(long, sizes))), sizes[long]
            start = at = 0
            while start < len(sizes):
                stop = start + 1
                while stop < len(sizes) and (stop + 1 - start) * sizes[start:stop + 1].max() <= CELLS:
                    stop += 1
                n = int(sizes[start:stop].sum())
                yield from _taken(rows.slice(at, n), sizes[start:stop], STORED, params).to_batches()
                start, at = stop, at + n

    src = sizing.dealt(_bar_values(bars), "ticker").sortWithinPartitions("ticker", "date")
    return src.mapInArrow(run, _declared(STORED))


def _gated(rows: DataFrame, params: JobParams) -> DataFrame:
    """Complete rows of tickers with enough of them.

    Completeness is counted in the window pass rather than filtered first, so
    the optimizer does not copy the column expressions into a filter.
    """
    whole = rows.select("*", sum([F.col(f).isNotNull().cast("int") for f in FEATURES[1:]],
                                 F.col(FEATURES[0]).isNotNull().cast("int")).alias("seen"))
    ok = (F.col("seen") == len(FEATURES)).cast("int")
    counted = whole.select(
        *[x for x in whole.columns if x != "seen"], ok.alias("ok"),
        F.sum(ok).over(w.running()).alias("row_no"), F.sum(ok).over(w.by_ticker()).alias("n_rows"))
    return counted.where((F.col("ok") == 1) & (F.col("n_rows") > params.min_feature_rows)) \
        .drop("ok", "seg")


def lag_features(feats: DataFrame, k: int = 1, params: JobParams = JobParams()) -> DataFrame:
    """Every indicator shows the value from ``k`` rows earlier; short tickers are dropped."""
    rows = feats.withColumn("seg", w.segment_of(F.col("date")))
    shifted = rows.select(
        "ticker", "date", "seg", "bar_no", *[_lag(f, k).alias(f) for f in FEATURES],
        "y", "label_end")
    return _gated(shifted, params)
