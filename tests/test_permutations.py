"""Permutations of all seeds in one deal of the rows by date."""

from panelwright.operators import falsify
from panelwright.plans import catalog


def test_all_seeds_at_once_equal_each_by_itself(spark, sf):
    panel = catalog.stage(spark, sf).panel
    want = [{(r["date"], r["ticker"]): r["y"] for r in falsify.permute_labels(panel, seed, 1).collect()} for seed in (7, 8)]
    for whole_rows in (falsify.WHOLE_ROWS, 1):
        rows = falsify.permutations(panel, [7, 8], whole_rows).collect()
        assert len(rows) == panel.count()
        for k in range(2):
            assert {(r["date"], r["ticker"]): r[f"y{k}"] for r in rows} == want[k]


def test_rows_are_dealt_once_for_all_seeds(spark, sf):
    dealt = falsify.permutations(catalog.stage(spark, sf).panel, [1, 2, 3])._jdf.queryExecution().executedPlan().toString()
    assert dealt.count("Exchange hashpartitioning") == 1 and "md5" not in dealt.split("Exchange hashpartitioning")[1]


def test_features_are_compared_where_they_are_stored(spark, sf, monkeypatch):
    """The join of the look-ahead check moves no features."""
    plans = []

    def cut(df, cut=catalog.sizing.cut):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df)

    monkeypatch.setattr(catalog.sizing, "cut", cut)
    s = catalog.Stage(spark, sf)
    assert s.lookahead.count() > 0
    joined = plans[-1].split("FullOuter")[1].split("InMemoryTableScan")[0]
    assert "Bucketed: true" in joined and "Exchange" not in joined
