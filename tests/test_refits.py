"""Many models at once, and what they stand on: panels by cutoff, folds, selection, ranks, ledger passes, single files."""

import datetime as dt
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.functions import ranks, sizing
from panelwright.operators import forests, ledger
from panelwright.operators.features import FEATURES
from panelwright.params import JobParams
from panelwright.plans import refits
from panelwright.sources import snapshots as sn
from tests.test_ledger import DAYS

SMALL = JobParams(n_folds=2, rf_trees=6, rf_depth=3, rf_leaf=10, gb_rounds=5, gb_depth=2, gb_rate=0.3, gb_leaf=10, horizon=2, min_oof_rows=20)


@pytest.fixture(scope="module")
def z(spark):
    """A signal in the first feature, on 60 days of 12 tickers."""
    rng = np.random.default_rng(4)
    rows = []
    for d in range(60):
        for t in range(12):
            x = rng.normal(size=len(FEATURES))
            rows.append((dt.date(2020, 1, 1) + dt.timedelta(days=d), f"T{t}", *map(float, x), float(0.5 * x[0] + 0.05 * rng.normal())))
    return sizing.cut(spark.createDataFrame(rows, ["date", "ticker", *FEATURES, "y"]))


def trained(data, fits):
    return forests.train(data, fits, SMALL)


def test_many_models_are_the_models_alone(z):
    data = sizing.cut(forests.rows(z, F.lit(0), F.lit(0), F.array("y", -F.col("y"))))
    fits = [forests.Fit(0, 0), forests.Fit(0, 1), forests.Fit(0, 0, 18_290)]
    whole = trained(data, fits)
    for m, fit in enumerate(fits):
        alone = trained(sizing.cut(data.repartition(3)), [fit])
        assert (whole.forest.feature[m] == alone.forest.feature[0]).all() and (whole.boosted.cut[m] == alone.boosted.cut[0]).all()
        assert np.allclose(whole.forest.value[m], alone.forest.value[0]) and np.allclose(whole.boosted.value[m], alone.boosted.value[0])
    # Turned labels give turned trees.
    assert np.allclose(whole.boosted.value[0], -whole.boosted.value[1]) and whole.rows[2] < whole.rows[0] == 720


def test_splits_are_the_best_ones(z):
    """The first boosted tree's root against a search of all features and bins."""
    data = sizing.cut(forests.rows(z, F.lit(0), F.lit(0), F.array("y")))
    made = forests.train(data, [forests.Fit(0, 0)], SMALL.with_(gb_subsample=2.0, gb_rounds=1))
    rows = data.select("bins", F.get("ys", F.lit(0)).alias("y")).collect()
    bins, y = np.array([r["bins"] for r in rows]), np.array([r["y"] for r in rows])
    y = y - y.mean()
    best = max(((y[bins[:, f] <= c].sum() ** 2 / (bins[:, f] <= c).sum() + y[bins[:, f] > c].sum() ** 2 / (bins[:, f] > c).sum(), -f, -c)
                for f in range(len(FEATURES)) for c in range(forests.BINS - 1) if 10 <= (bins[:, f] <= c).sum() <= len(y) - 10))
    assert (made.boosted.feature[0, 0, 0], made.boosted.cut[0, 0, 0]) == (-best[1], -best[2])
    assert FEATURES[made.boosted.feature[0, 0, 0]] == FEATURES[0]


def test_scores_follow_the_trees_and_states_change_nothing(z, monkeypatch):
    data = sizing.cut(forests.rows(z, F.lit(0), F.lit(0), F.array("y"), "ticker"))
    made = trained(data.drop("ticker"), [forests.Fit(0, 0)])
    monkeypatch.setattr(forests, "STATE_EVERY", 2)
    monkeypatch.setattr(forests, "DRIVER_BYTES", 0)
    monkeypatch.setattr(forests, "HISTOGRAM_BYTES", 1)
    again = trained(data.drop("ticker"), [forests.Fit(0, 0)])
    assert np.allclose(made.boosted.value, again.boosted.value) and (made.forest.feature == again.forest.feature).all()
    rows = forests.score(data.select("ticker", "bins", F.lit(0).alias("number"), F.get("ys", F.lit(0)).alias("y")), made).collect()
    assert all(abs(np.mean(r["votes"]) - r["rf"]) < 1e-12 for r in rows)
    assert np.corrcoef([r["gb"] for r in rows], [r["y"] for r in rows])[0, 1] > 0.8


def test_refits_find_the_signal_and_permutations_lose_it(z):
    found, kinds = refits.falsification(z, z.withColumn(FEATURES[0], F.lit(0.0)), [1000, 1001], SMALL)
    r2 = {(r["kind"], r["seed"]): r["oof_r2"] for r in refits.named(found.calibration, kinds).collect()}
    assert set(r2) == {("real", None), ("permuted", 1000), ("permuted", 1001), ("lagged", None)}
    assert r2["real", None] > 0.5 and max(v for k, v in r2.items() if k[0] != "real") < 0.1
    folds = found.oof.groupBy("model", "fold").agg(F.min("date").alias("d"), F.count("*").alias("n")).collect()
    assert {(r["fold"], r["d"], r["n"]) for r in folds} == {(0, dt.date(2020, 1, 21), 240), (1, dt.date(2020, 2, 10), 240)}


def test_panels_by_cutoff_are_those_of_the_cut_table(spark):
    """Tickers with calendars of their own: each panel equals the one built from the rows before its cutoff."""
    rng = np.random.default_rng(8)
    rows = []
    for t in range(5):
        days = sorted(rng.choice(200, 150, replace=False))
        for i, d in enumerate(days):
            end = dt.date(2020, 1, 1) + dt.timedelta(days=int(days[i + 3])) if i + 3 < len(days) else None
            rows.append((f"T{t}", dt.date(2020, 1, 1) + dt.timedelta(days=int(d)), i + 1, float(rng.normal()) if end else None, end,
                         *map(float, rng.normal(size=len(FEATURES)))))
    feats = sizing.cut(spark.createDataFrame(rows, ["ticker", "date", "row_no", "y", "label_end", *FEATURES]))
    params, cutoffs = JobParams(min_feature_rows=60), [dt.date(2020, 4, 1), dt.date(2020, 5, 1), dt.date(2020, 6, 15)]
    made = refits.panels(feats, cutoffs, params).toPandas()
    from panelwright.operators import panel as pn
    for j, cutoff in enumerate(cutoffs):
        seen = feats.where(F.col("date") < F.lit(cutoff))
        enough = seen.groupBy("ticker").count().where("count > 60").select("ticker")
        want = pn.normalise(pn.build_panel(seen.join(enough, "ticker", "left_semi"), cutoff)).toPandas().sort_values(["date", "ticker"])
        got = made[(made["since"] <= j) & (j <= made["until"])].sort_values(["date", "ticker"])
        assert list(zip(got["date"], got["ticker"])) == list(zip(want["date"], want["ticker"])) and len(want)
        assert np.allclose(got[FEATURES].to_numpy(float), want[FEATURES].to_numpy(float))
    assert len(made) < sum((made["since"] <= j).sum() for j in range(3))


def test_medians_are_selected_exactly(spark, monkeypatch):
    monkeypatch.setattr(ranks, "PIECES", 4)
    rng = np.random.default_rng(1)
    groups = {"a": rng.normal(size=501).tolist(), "b": [3.0] * 40, "c": [1.0, 2.0], "d": [7.5], "e": np.round(rng.normal(size=300), 1).tolist(),
              "f": [1e300, -1e300, 0.0, 5.0]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("g", None), ("a", None), (None, 1.0)]
    found = {r["t"]: r["v"] for r in ranks.percentile(spark.createDataFrame(rows, "t string, v double"), "t", "v").collect()}
    assert found == pytest.approx({g: statistics.median(vs) for g, vs in groups.items()})


def test_ranks_with_nulls_and_one_value(spark):
    rows = [(1, 2.0, f"t{i:03d}") for i in range(200)] + [(1, None, "n1"), (1, None, "n0"), (1, 9.0, "x"), (None, 1.0, "b"), (None, 1.0, "a"), (None, None, "c")]
    df = spark.createDataFrame(rows, "g int, v double, t string").repartition(4)
    found = {(r["g"], r["t"]): r["rank"] for r in ranks.by_value_desc(df, ["g"], "v", "t", "rank").collect()}
    assert found == {(1, "x"): 1, **{(1, f"t{i:03d}"): i + 2 for i in range(200)}, (1, "n0"): 202, (1, "n1"): 203, (None, "a"): 1, (None, "b"): 2, (None, "c"): 3}


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_ledger_at_a_high_rate_and_without_a_price(spark, monkeypatch, limit):
    """At 20 % a side against a walk in plain numbers; a holding whose price ends keeps its last one."""
    monkeypatch.setattr(sizing, "BROADCAST_BYTES", limit)
    price = {"A": [10, 11, 12, 13, 9, 8], "B": [5, 5, 6, 7, 7, 7], "C": [4, 3, None, None, None, None]}
    closes = spark.createDataFrame([(DAYS[i], t, float(p)) for t, ps in price.items() for i, p in enumerate(ps) if p], "date date, ticker string, close double")
    plan = [{"A": 0.7, "C": 0.3}, {"B": 1.0}, {"A": 0.5, "B": 0.5}, {}]
    at = [0, 2, 3, 4]
    schedule = spark.createDataFrame([("s", k, t, w) for k, ws in enumerate(plan) for t, w in ws.items()], "strategy string, k int, ticker string, weight double")
    rebalances = spark.createDataFrame([("s", k, DAYS[i], DAYS[5]) for k, i in enumerate(at)], "strategy string, k int, date date, end_date date")
    policy = spark.createDataFrame([("s", 1.0, 0.2, 1000.0)], "strategy string, invest_fraction double, cost_rate double, capital double")
    found = ledger.roll_forward(closes, schedule, rebalances, policy).orderBy("k").collect()
    cash, held, want = 1000.0, {}, []
    for k, i in enumerate([*at, 5]):
        def last(t, i=i):
            return next(p for p in reversed(price[t][:i + 1]) if p)
        value = cash + sum(n * last(t) for t, n in held.items())
        if k == len(at):
            want.append(value)
            break
        now = {t: n * last(t) for t, n in held.items()}
        est = sum(abs(plan[k].get(t, 0) * value - now.get(t, 0)) for t in {*plan[k], *now})
        goal = {t: w * (value - 0.2 * est) for t, w in plan[k].items()}
        traded = sum(abs(goal.get(t, 0) - now.get(t, 0)) for t in {*goal, *now})
        cash = max(0.0, value - 0.2 * traded - sum(goal.values()))
        held = {t: g / price[t][i] for t, g in goal.items()}
        want.append(value - 0.2 * traded)
    assert [r["value"] for r in found] == pytest.approx(want)


def test_legs_are_not_dealt_by_rebalance(spark):
    rows = spark.createDataFrame([("s", 0, f"T{i}", 0.1, 0.0) for i in range(10)], "strategy string, k int, ticker string, weight double, drift double")
    state = spark.createDataFrame([("s", 0, 1.0)], "strategy string, k int, scale double")
    plan = ledger._beside(rows, state)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning(strategy" not in plan


def test_wall_clocks_do_not_depend_on_the_session(spark):
    rows = spark.createDataFrame([(0, "Asia/Tokyo"), (3600 * 16, "Asia/Tokyo"), (3600 * 3, "America/New_York"), (3600 * 23, "UTC")], "s long, zone string")
    own, seen = spark.conf.get("spark.sql.session.timeZone"), []
    try:
        for zone in ("UTC", "America/Los_Angeles"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            seen.append([r["d"] for r in rows.select(sn.wall_clock_date(F.timestamp_seconds("s"), F.col("zone")).alias("d")).collect()])
    finally:
        spark.conf.set("spark.sql.session.timeZone", own)
    day = dt.date(1970, 1, 1)
    assert seen[0] == seen[1] == [day, day + dt.timedelta(days=1), day - dt.timedelta(days=1), day]
