"""One stacked fit: out-of-fold rows, ridge, calibration and the refit on the whole panel."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.functions import sizing
from panelwright.operators import ensemble, folds, forests, panel as pn, scoring
from panelwright.params import JobParams
from panelwright.plans import refits


@dataclass(frozen=True)
class StackedModel:
    """The fitted trees of the whole panel and the small tables that complete them (one row per model)."""

    base: forests.Ensembles
    ridge: DataFrame
    calibration: DataFrame
    oof: DataFrame
    summary: DataFrame
    model: int

    def score(self, latest_z: DataFrame, params: JobParams) -> DataFrame:
        voted = votes(self.base, latest_z).withColumn("model", F.lit(self.model))
        return scoring.predictions(ensemble.stacked(voted, self.ridge), self.calibration, params)


def votes(base: forests.Ensembles, latest_z: DataFrame) -> DataFrame:
    """as_of, ticker, rf, gb and the votes of the forest's trees."""
    return forests.score(latest_z.select("as_of", "ticker", F.lit(0).alias("number"), forests.binned().alias("bins")), base).drop("number")


def matrix(z: DataFrame) -> DataFrame:
    """The binned rows of a normalised panel, stored; all of its fits read them."""
    return sizing.written(forests.rows(z, F.lit(0), F.lit(0), F.array("y"), "date", "ticker"))


def whole(data: DataFrame, params: JobParams) -> forests.Ensembles:
    """Both learners over all rows of a matrix."""
    return forests.train(data.select(*(c.split()[0] for c in forests.ROW.split(", "))), [forests.Fit(0, 0)], params)


def out_of_fold(z: DataFrame, params: JobParams, model: int = 1, data: DataFrame | None = None):
    """Stacked out-of-fold rows, ridge, calibration and fold summary of one normalised panel.

    None when the panel or the out-of-fold table is too small. ``z`` is read from stored tables, without the lineage of its features;
    ``data`` is its matrix, where that is stored already. All folds are trained together, a pass over the matrix for a level of all trees.
    """
    if not pn.large_enough(z, params):
        return None
    roles = sizing.cut(folds.day_roles(folds.date_positions(z), params))
    if roles.isEmpty():
        return None
    summary = sizing.cut(folds.fold_summary(z, roles, params))
    data = matrix(z) if data is None else data
    days = data.select(F.lit(0).alias("panel"), "date").distinct()
    found = refits.fit(data, days, [(0, 0)], params)
    if found.calibration.isEmpty():
        return None
    oof, ridge, calibration = (t.withColumn("model", F.lit(model)) for t in (found.oof, found.ridge, found.calibration))
    return oof, ridge, calibration, summary


def fit(z: DataFrame, params: JobParams, model: int = 1) -> StackedModel | None:
    """Out-of-fold stack plus the final refit on the whole panel."""
    data = matrix(z)
    parts = out_of_fold(z, params, model, data)
    if parts is None:
        return None
    oof, ridge, calibration, summary = parts
    return StackedModel(whole(data, params), ridge, calibration, oof, summary, model)
