"""Rolling values against pandas, in one pass over a ticker's rows, and the session's limit on generated methods."""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from panelwright.functions import rolling as rl, sizing
from panelwright.operators import falsify, features as ft
from panelwright.plans import catalog
from panelwright.sources import bars as bs


def test_rolling_values_with_gaps():
    rng = np.random.default_rng(5)
    x = rng.normal(size=1300)
    x[rng.random(1300) < 0.05] = np.nan
    p = pd.Series(x)
    total, count = rl.near(x, 7)
    assert np.allclose(total, p.rolling(7, min_periods=1).sum(), equal_nan=True) and (count == p.rolling(7, min_periods=1).count()).all()
    assert np.array_equal(rl.near_best(x, 5), p.rolling(5, min_periods=1).max(), equal_nan=True)
    whole = p.fillna(0.5).to_numpy()
    assert np.allclose(rl.span_sum(rl.running(whole), 21, 2)[22:], pd.Series(whole).rolling(21).sum().shift(2)[22:])
    for span, y in zip((9, 200), rl.exponential_means(whole, (9, 200))):
        assert np.allclose(y, pd.Series(whole).ewm(span=span, adjust=False).mean(), rtol=1e-12)
    assert len(rl.back(x[:3], 5)) == len(rl.back(x[:3], -5)) == 3


def test_rolling_values_take_no_later_row():
    x = np.random.default_rng(6).normal(size=1300) + 5
    cut = ft._rolled(*[x[:700]] * 4, 21)
    for name, whole in ft._rolled(*[x] * 4, 21).items():
        assert name == "y" or np.array_equal(whole[:700], cut[name], equal_nan=True), name


def test_indicators_need_no_stack_of_windows(spark):
    plan = ft.indicator_rows(spark.createDataFrame([], bs.BAR_SCHEMA))._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("FlatMapGroupsInArrow") == 1


def test_tickers_side_by_side_have_the_values_they_have_alone():
    rng = np.random.default_rng(7)
    long, short = rng.normal(size=1300) + 5, rng.normal(size=300) + 5
    both = np.full((2, 1300), np.nan)
    both[0], both[1, :300] = long, short
    side = ft._rolled(*[both] * 4, 21)
    for k, x in enumerate((long, short)):
        for name, alone in ft._rolled(*[x] * 4, 21).items():
            assert np.array_equal(side[name][k, :len(x)], alone, equal_nan=True), name


def test_batches_are_cut_between_tickers():
    names = ["A"] * 3 + ["B"] * 9 + ["C"] + [None] * 2
    rows = pa.table({"ticker": names, "n": range(len(names))})
    for size in (1, 2, 4, 5, 100):
        found = list(ft.whole_tickers(rows.to_batches(size)))
        assert [int(n) for _, sizes in found for n in sizes] == [3, 9, 1, 2]
        assert pa.concat_tables([t for t, _ in found]).equals(rows) and all(t.num_rows == sizes.sum() for t, sizes in found)
    assert list(ft.whole_tickers([])) == []


def test_features_are_stored_where_they_are_made(spark, supplier_bars, feats):
    """Neither a window nor a second exchange follows the pass, and only complete rows leave it, as counted by Spark."""
    made = ft.features(spark.createDataFrame([], bs.BAR_SCHEMA))._jdf.queryExecution()
    before_rows = made.executedPlan().toString().split("MapInArrow")[0]
    assert "Window" not in made.optimizedPlan().toString() and "Exchange" not in before_rows
    whole = ft.indicator_rows(supplier_bars).where(" AND ".join(f"{f} IS NOT NULL" for f in ft.FEATURES))
    n = whole.groupBy("ticker").agg(F.count("*").alias("n_rows")).where("n_rows > 100")
    want = whole.join(n, "ticker").select("ticker", "date", "bar_no", *[F.col(f).cast("float").alias(f) for f in ft.FEATURES], "y", "label_end", "n_rows")
    got = feats.select(*want.columns)
    assert got.count() == want.count() > 0 and got.exceptAll(want).count() == 0
    assert feats.groupBy("ticker", "n_rows").agg(F.max("row_no").alias("top"), F.count("*").alias("n")).where("top <> n_rows OR n <> n_rows").count() == 0


def test_zero_prices_leave_gaps(spark):
    days = pd.bdate_range("2020-01-01", periods=300)
    rows = [("T", d.date(), p, p, p, p, 10) for i, d in enumerate(days) for p in [0.0 if i == 200 else 1.0 + i % 7]]
    got = ft.indicator_rows(spark.createDataFrame(rows, "ticker string, date date, open double, high double, low double, close double, volume long"))
    row = got.where("bar_no = 205").first()
    assert row["ret_5d"] is None and row["mean_rev_5"] is not None and row["parkinson_vol_21"] is None
    assert got.where(F.col("price_sma_10").isNotNull()).count() == 291


def test_generated_methods_stay_compiled(spark, sf):
    own = spark.conf.get("spark.sql.codegen.hugeMethodLimit")
    try:
        catalog.Stage(spark, sf)
        assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= sizing.JIT_BYTES
    finally:
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", own)


def test_permutation_does_not_depend_on_the_split(spark, monkeypatch):
    """One group a date while a task can number it; more digits only as dates grow, with the same labels."""
    days = pd.bdate_range("2024-01-01", periods=4)
    panel = spark.createDataFrame([(d.date(), f"T{i}", float(i)) for d in days for i in range(90)], "date date, ticker string, y double")
    assert falsify.prefix_digits(panel) == 0 == falsify.prefix_digits(panel.limit(0))
    drawn = [sorted(map(tuple, falsify.permute_labels(panel, 7, n).collect())) for n in (0, 1, 3)]
    assert drawn[0] == drawn[1] == drawn[2] and len(drawn[0]) == 360
    monkeypatch.setattr(falsify, "PREFIX_ROWS", 3)
    assert falsify.prefix_digits(panel) == 2
