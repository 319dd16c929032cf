"""A single fit trains its folds together, over one stored matrix of bins."""

import pytest
from pyspark.sql import functions as F

from panelwright.operators import ensemble, forests, panel as pn
from panelwright.params import JobParams
from panelwright.plans import refits, research

SMALL = JobParams(n_folds=2, rf_trees=3, rf_depth=2, rf_leaf=5, gb_rounds=2, gb_depth=2, gb_leaf=5)


def test_folds_are_trained_together_and_apart_from_the_whole_fit(spark, feats, monkeypatch):
    z = pn.normalise(pn.build_panel(feats)).persist()
    trained = []

    def train(data, fits, params, train=forests.train):
        trained.append(len(fits))
        return train(data, fits, params)

    def no_copy(*_):
        raise AssertionError("a fold was fitted by itself")

    monkeypatch.setattr(forests, "train", train)
    monkeypatch.setattr(ensemble, "fit_base", no_copy)
    model = research.fit(z, SMALL)
    assert trained == [2, 1]
    assert model.oof.select("date", "ticker").distinct().count() == model.oof.count() == model.calibration.first()["n_oof"] > 0
    # Folds and the whole fit are those of a run that trains all of them at once.
    data = research.matrix(z)
    at_once = refits.fit(data, data.select(F.lit(0).alias("panel"), "date").distinct(), [(0, 0)], SMALL, whole=True)
    last = at_once.last[0]
    assert (model.base.forest.feature[0] == at_once.made.forest.feature[last]).all()
    assert model.base.boosted.value[0] == pytest.approx(at_once.made.boosted.value[last])
    assert model.calibration.first()["oof_r2"] == pytest.approx(at_once.calibration.first()["oof_r2"])
    # Importances: a tree counts as much as another, however large its gains.
    share = forests.importances(model.base, 0)
    assert share.sum() == pytest.approx(1)
    gain = model.base.forest.gain[0]
    assert share == pytest.approx(sum(g / g.sum() for g in gain) / len(gain))
    voted = research.votes(model.base, z.withColumnRenamed("date", "as_of")).limit(50).collect()
    assert all(len(r["votes"]) == 3 and r["rf"] == pytest.approx(sum(r["votes"]) / 3) for r in voted)


def test_labels_are_joined_to_bins_and_not_to_features(spark, feats, monkeypatch):
    """Permuted refits move a byte a feature: no join holds a z-score, and what is stored are files of columns."""
    z = pn.normalise(pn.build_panel(feats)).persist()
    stored = []

    def written(df, written=refits.sizing.written):
        stored.append(df._jdf.queryExecution().optimizedPlan().toString())
        return written(df)

    monkeypatch.setattr(refits.sizing, "written", written)
    refits.falsification(z, z, [7], SMALL)
    joins = stored[0].split("Join Inner")
    assert len(joins) > 1
    # Below the join, the panel's side is projected to its bins.
    assert "bins" in joins[1].split("InMemoryRelation")[0]
