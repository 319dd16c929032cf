"""Folds, permutation, ranks, ridge, audit, gate and sources."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelwright.functions import ranks
from panelwright.operators import audit, ensemble, falsify, folds, integrity, panel as pn, signals as sg
from panelwright.params import JobParams
from panelwright.sources import snapshots as sn


def test_params_are_frozen():
    p = JobParams()
    with pytest.raises(Exception):
        p.horizon = 3
    assert p.with_(horizon=42).horizon == 42 and p.horizon == 21


def test_five_growing_folds_on_500_dates(spark):
    days = [d.date() for d in pd.bdate_range("2020-01-01", periods=500)]
    panel = spark.createDataFrame([(d, t) for d in days for t in "ABC"], "date date, ticker string")
    pos = folds.date_positions(panel)
    rows = folds.fold_summary(panel, folds.day_roles(pos), JobParams()).orderBy("fold").collect()
    assert len(rows) == 5
    assert [r["train_rows"] for r in rows] == sorted(r["train_rows"] for r in rows)
    assert all(r["ordering_ok"] and r["gap_trading_days"] == 22 for r in rows)
    bounds = folds.fold_bounds(pos).orderBy("fold").collect()
    edges = np.linspace(0, 500, 7).astype(int)
    assert [r["val_start"] for r in bounds] == list(edges[1:-1])


def test_permutation_keeps_each_dates_labels(spark):
    rng = np.random.default_rng(0)
    rows = [(d.date(), f"T{i}", float(rng.normal())) for d in pd.bdate_range("2024-01-01", periods=20) for i in range(6)]
    panel = spark.createDataFrame(rows, "date date, ticker string, y double")
    a = {(r["date"], r["ticker"]): r["y"] for r in falsify.permute_labels(panel, 1).collect()}
    assert len(a) == len(rows)
    moved = 0
    for d in {r[0] for r in rows}:
        assert sorted(r[2] for r in rows if r[0] == d) == sorted(v for k, v in a.items() if k[0] == d)
    moved = sum(a[(d, t)] != y for d, t, y in rows)
    assert moved > len(rows) / 2


def test_rank_with_heavy_ties(spark):
    rows = [("g", float(i % 7), f"{i:04d}") for i in range(700)]
    df = spark.createDataFrame(rows, "g string, v double, t string")
    got = [(r["v"], r["t"]) for r in ranks.by_value_desc(df, ["g"], "v", "t", "rank").orderBy("rank").collect()]
    assert got == sorted(((v, t) for _, v, t in rows), key=lambda x: (-x[0], x[1]))


def test_ridge_equals_brute_force_leave_one_out(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 2)) * 0.3
    y = 0.4 * x[:, 0] - 0.2 * x[:, 1] + rng.normal(size=60) * 0.05 + 0.1
    df = spark.createDataFrame([(1, float(a), float(b), float(c)) for (a, b), c in zip(x, y)],
                               "model int, rf double, gb double, y double")
    best = None
    for alpha in ensemble.RIDGE_ALPHAS:
        def solve(xs, ys):
            mx, my = xs.mean(0), ys.mean()
            wts = np.linalg.solve((xs - mx).T @ (xs - mx) + alpha * np.eye(2), (xs - mx).T @ (ys - my))
            return wts, my - mx @ wts
        err = 0.0
        for i in range(60):
            keep = np.arange(60) != i
            wts, b = solve(x[keep], y[keep])
            err += (y[i] - x[i] @ wts - b) ** 2 / 60
        if best is None or err < best[0]:
            best = (err, alpha, *solve(x, y))
    row = ensemble.fit_ridge(df).first()
    assert row["alpha"] == best[1]
    assert row["loo_error"] == pytest.approx(best[0], rel=1e-9)
    assert [row["w_rf"], row["w_gb"]] == pytest.approx(list(best[2]))
    assert row["intercept"] == pytest.approx(best[3])


def test_zscore_of_zero_variance_is_zero(spark):
    df = spark.createDataFrame([(1, "a", 2.0, 1.0), (1, "b", 2.0, 3.0), (2, "a", 5.0, 5.0)],
                               "date int, ticker string, u double, v double")
    got = {(r["date"], r["ticker"]): (r["u"], r["v"]) for r in pn.normalise(df, "date", ["u", "v"]).collect()}
    assert got[(1, "a")][0] == 0.0 and got[(2, "a")] == (0.0, 0.0)
    assert got[(1, "b")][1] == pytest.approx(2 ** -0.5)


OOF = {"HIGH": (0.10, 0.02, 0.9), "MEDIUM": (0.04, 0.10, 0.5), "LOW": (0.02, 0.10, 0.35)}


@pytest.mark.parametrize("y,ok", [({"HIGH": 0.08, "MEDIUM": 0.03, "LOW": 0.01}, True),
                                  ({"HIGH": 0.00, "MEDIUM": 0.06, "LOW": 0.02}, False)])
def test_tier_audit(spark, y, ok):
    rows = [(*OOF[t], y[t], 0.02) for t in OOF for _ in range(20)]
    oof = spark.createDataFrame(rows, "pred double, tree_std double, confidence double, y double, residual_std double")
    table = audit.tier_table(audit.tiered(oof))
    assert {r["tier"]: r["n"] for r in table.collect()} == {t: 20 for t in OOF}
    assert audit.verdict(table).first()["monotonic"] is ok


def test_gate_states(spark):
    r2 = spark.createDataFrame([("permuted", 0.01), ("permuted", 0.03), ("real", 0.1)], "kind string, oof_r2 double")
    assert integrity.permutation_gate(r2).first()["status"] == "FAIL"
    assert integrity.permutation_gate(r2.where("oof_r2 < 0.02 OR kind = 'real'")).first()["status"] == "PASS"
    none = integrity.permutation_gate(r2.limit(0))
    assert none.first()["status"] == "FAIL" and none.first()["gating"]
    assert integrity.gate(none).first()["gate_state"] == "FAILED"
    assert integrity.gate(none.limit(0)).first()["gate_state"] == "NOT RUN"


def test_landing_rules(spark):
    days = pd.bdate_range("2023-01-02", periods=120)
    rows = [("OK", d.date(), 1.0, 1.0, 1.0, 1.0, 5) for d in days]
    rows += [("SHORT", d.date(), 1.0, 1.0, 1.0, 1.0, 5) for d in days[:50]]
    rows += [("BAD", d.date(), 1.0, 1.0, 1.0, 0.0, 5) for d in days]
    raw = spark.createDataFrame(rows, "ticker string, date date, open double, high double, low double, close double, volume int")
    out = sn.normalise_prices(raw)
    assert {r["ticker"] for r in out.select("ticker").distinct().collect()} == {"OK"}
    assert dict(out.dtypes)["close"] == "float" and dict(out.dtypes)["volume"] == "bigint"
    listed = spark.createDataFrame([("OK",), ("SHORT",), ("BAD",), ("GONE",)], "ticker string")
    got = {r["ticker"]: r["reason"] for r in sn.rejected(listed, raw).collect()}
    assert got == {"SHORT": "short history", "BAD": "no valid rows", "GONE": "missing"}


def test_columns_are_standardised(spark):
    df = spark.createDataFrame([(1, 1, 1, 1, 1)], " Open int, HIGH int, low int, Close int, Volume int")
    assert sn.standard_columns(df).columns == ["open", "high", "low", "close", "volume"]
    assert sn.standard_columns(df.drop("Volume")) is None


def test_missing_snapshot_is_empty(spark, tmp_path):
    assert sn.scan_snapshot(spark, str(tmp_path), "info", dt.date(2024, 1, 1)).count() == 0


def test_votes(spark):
    row = spark.createDataFrame([([3.0, 1.0, 2.0, 10.0],)], "v array<double>").select(
        ensemble.vote_std(F.col("v")).alias("s"), ensemble.vote_percentile(F.col("v"), 90.0).alias("p")).first()
    assert row["s"] == pytest.approx(np.std([3, 1, 2, 10]))
    assert row["p"] == pytest.approx(np.percentile([3, 1, 2, 10], 90))


def test_day_statistics_do_not_depend_on_the_split(spark):
    """Counts, means and deviations are combined from parts of a day, without NULLs and without a row of Spark's per value."""
    rows = [(None if i % 11 == 0 else i % 3, 1e6 + (i * 37 % 101) / 7, None if i % 5 == 0 else float(i)) for i in range(400)] + [(9, 4.0, None)]
    df = spark.createDataFrame(rows, "g int, a double, b double")
    want = {r["g"]: tuple(r)[1:] for r in df.groupBy("g").agg(F.avg("a"), F.avg("b"), F.stddev_samp("a"), F.stddev_samp("b")).collect()}
    for parts in (1, 7):
        stats = pn.cross_section_stats(df.repartition(parts), "g", ["a", "b"])
        got = {r["g"]: (r["a__m"], r["b__m"], r["a__s"], r["b__s"]) for r in stats.collect()}
        assert got.keys() == want.keys()
        for g, values in want.items():
            assert [x is None for x in got[g]] == [x is None for x in values]
            assert all(x is None or abs(x - y) < 1e-9 * abs(y) for x, y in zip(got[g], values))
    assert "MapInArrow" in stats._jdf.queryExecution().optimizedPlan().toString()
    assert pn.cross_section_stats(df.limit(0), "g", ["a"]).collect() == []
