"""What single fits keep, move and store."""

from pyspark.sql import functions as F

from panelwright.operators import ensemble, folds, panel as pn
from panelwright.operators.features import FEATURES
from panelwright.params import JobParams
from panelwright.plans import catalog

SMALL = JobParams(n_folds=2, rf_trees=3, rf_depth=2, rf_leaf=5, gb_rounds=2, gb_depth=2, gb_leaf=5)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_the_normalised_panel_is_no_second_copy_of_the_features(spark, sf):
    """It is read from the stored features and a row a day beside them, and holds what normalising anew does."""
    s = catalog.Stage(spark, sf)
    before = spark.catalog.listTables()
    s.features
    stored = len(spark.catalog.listTables()) - len(before)
    assert s.z.count() == s.panel.count()
    assert len(spark.catalog.listTables()) - len(before) == stored == 1
    names = ["ret_21d", "vol_21d", "kurt_21"]
    want = {(r["date"], r["ticker"]): r for r in pn.normalise(s.panel, "date").select("date", "ticker", *names).collect()}
    for r in s.z.select("date", "ticker", *names).collect():
        assert all(abs(r[n] - want[r["date"], r["ticker"]][n]) < 1e-9 for n in names)


def test_folds_of_large_panels_run_one_by_one():
    assert ensemble.side_by_side(26_000, 5) == ensemble.MOST_FOLDS
    assert ensemble.side_by_side(26_000, 2) == 2
    assert ensemble.side_by_side(2 * ensemble.SIDE_BY_SIDE, 5) == 1


def test_folds_keep_and_move_no_rows_of_the_panels_width(spark, feats, monkeypatch):
    z = pn.normalise(pn.build_panel(feats))
    roles = folds.day_roles(folds.date_positions(z), SMALL).localCheckpoint()
    trained = []

    def fit(train, params, fit_base=ensemble.fit_base):
        trained.append(train)
        return fit_base(train, params)

    monkeypatch.setattr(ensemble, "fit_base", fit)
    rows = ensemble.out_of_fold(z, roles, SMALL)
    assert len(trained) == roles.select("fold").distinct().count()
    assert all(not t.is_cached for t in trained)
    assert all("BroadcastHashJoin" in _plan(t) and "LeftSemi" in _plan(t) and "SortMergeJoin" not in _plan(t).split("LeftSemi")[0] for t in trained)
    val = z.join(roles.where("role = 'val'").select("date"), "date")
    assert rows.count() == val.count() and rows.where(F.col("rf").isNull()).isEmpty()


def test_histograms_and_nodes_equal_a_walk_row_by_row():
    """Nodes from a batch's flat bins, and a tree's histograms at a level where one branch has ended."""
    import numpy as np
    import pyarrow as pa
    from panelwright.operators import forests

    rng, n, width, k = np.random.default_rng(5), 300, len(forests.FEATURES), 4
    bins, ys, days = rng.integers(0, forests.BINS, (n, width)).astype(np.int8), rng.integers(-4, 5, n) / 4.0, rng.integers(0, 9, n).astype(np.int32)
    lists = [pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * a.shape[1]), pa.array(a.ravel())) for a in (ys[:, None], bins)]
    batch = pa.RecordBatch.from_arrays([pa.array(days), pa.array(np.zeros(n, np.int32)), pa.array(np.zeros(n, np.int32)), pa.array(rng.integers(0, 1 << 62, n)), *lists],
                                       names=["day", "since", "until", "draw", "ys", "bins"])
    trees = forests.Trees.none(1, 1, 3)
    trees.feature[0, 0, [0, 1]], trees.cut[0, 0, [0, 1]] = [7, 3], [15, 9]
    nodes, weights = [3, 4], rng.integers(0, 4, n).astype(float)
    features = np.array([[0, 3, 7, 20], [1, 2, 30, width - 1]])
    unit = forests._Unit(0, 0, nodes, features)
    made = list(forests._histograms([batch], [forests.Fit(0, 0, 6)], [unit], trees, 2, lambda b, tree: weights, lambda b, model, own: b.ys[own, 0]))
    found = np.frombuffer(made[0].column(1)[0].as_py()).reshape(2, 2, k, forests.BINS)
    expected, reached = np.zeros_like(found), []
    for i in range(n):
        node = 0
        for _ in range(2):
            f = trees.feature[0, 0, node]
            node = node if f < 0 else 2 * node + 1 + int(bins[i, f] > trees.cut[0, 0, node])
        reached.append(node)
        if node in nodes and days[i] < 6:
            for j, f in enumerate(features[nodes.index(node)]):
                expected[:, nodes.index(node), j, bins[i, f]] += weights[i], weights[i] * ys[i]
    assert (found == expected).all() and found[0].sum() > 0
    assert forests._nodes(bins.ravel(), np.arange(n) * width, trees.feature[0, 0], trees.cut[0, 0], 2).tolist() == reached
