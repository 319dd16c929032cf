"""Features against plain pandas, prefix invariance, and independence from row blocks."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelwright.functions import windows as w
from panelwright.operators import features as ft, integrity
from panelwright.sources import bars as bs


def test_45_columns_and_no_forbidden(feats):
    assert len(ft.FEATURES) == 45 == len(set(ft.FEATURES))
    assert not {"market_cap", "sector", "average_volume"} & set(feats.columns)


def test_blocked_walk_equals_single_block(spark, sf, supplier_bars):
    split = bs.bars(spark, sf, "supplier", block=100)
    assert split.exceptAll(supplier_bars).count() == 0
    assert supplier_bars.exceptAll(split).count() == 0


def test_against_pandas(supplier_bars):
    ticker = supplier_bars.agg(F.min("ticker")).first()[0]
    one = supplier_bars.where(F.col("ticker") == ticker)
    p = one.toPandas().sort_values("date").reset_index(drop=True)
    got = ft.indicator_rows(one).toPandas().sort_values("date").reset_index(drop=True)
    c, v = p["close"].astype(float), p["volume"].astype(float)
    ret = c.pct_change()
    want = {
        "price_sma_50": c / c.rolling(50).mean(),
        "price_ema_200": c / c.ewm(span=200, adjust=False).mean(),
        "vol_63d": ret.rolling(63).std() * np.sqrt(252),
        "skew_21": ret.rolling(21).skew(), "kurt_21": ret.rolling(21).kurt(),
        "dist_52w_high": c / c.rolling(252).max().shift(1) - 1,
        "rel_vol_21": v / (v.rolling(21).mean().shift(1) + 1),
        "zscore_50": (c - c.rolling(50).mean()) / (c.rolling(50).std() + 1e-8),
        "mom_12_1": c.pct_change(252).shift(21),
    }
    macd = c.ewm(span=12, adjust=False).mean() - c.ewm(span=26, adjust=False).mean()
    want["macd_hist"] = macd - macd.ewm(span=9, adjust=False).mean()
    for name, x in want.items():
        a, b = got[name].astype(float).to_numpy(), x.to_numpy()
        assert (np.isnan(a) == np.isnan(b)).all(), name
        assert np.nanmax(np.abs(a - b)) < 1e-9, name


def test_flat_prices_have_zero_spread(spark):
    rows = [("T", d.date(), 50.0, 50.0, 50.0, 50.0, 10) for d in pd.bdate_range("2020-01-01", periods=300)]
    df = spark.createDataFrame(rows, bs.BAR_SCHEMA)
    got = ft.indicator_rows(df).where("bar_no = 299").first()
    assert got["bb_position"] == 0.0 and got["bb_width"] == 0.0 and got["zscore_50"] == 0.0
    assert got["skew_21"] is None


def test_no_lookahead_is_exactly_zero(supplier_bars):
    changes = integrity.lookahead_changes(supplier_bars).collect()
    assert changes and all(r["max_before"] == 0.0 and r["unmatched"] == 0 for r in changes)
    assert any(r["changed_after"] for r in changes)


def test_static_columns_found(feats):
    planted = feats.withColumn("planted", F.lit(1.0))
    found = {r["feature"] for r in integrity.static_columns(planted, ft.FEATURES + ["planted"]).collect()}
    assert found == {"planted"}


def test_lag_keeps_columns_and_drops_first_row(feats):
    lag = ft.lag_features(feats, 1)
    assert lag.count() == feats.count() - feats.select("ticker").distinct().where(
        F.col("ticker").isNotNull()).count()
