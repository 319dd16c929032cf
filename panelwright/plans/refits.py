"""Many refits of the stack in one go: permuted and lagged panels, and the retrains of a walk-forward run.

A refit is a panel, a label and the folds of its dates. All refits share one stored matrix of binned rows (forests.rows);
their folds' models and their last ones are trained together, their out-of-fold rows are scored together, and ridge,
calibration and R2 are aggregates by refit.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions import sizing, windows as w
from panelwright.operators import allocation, ensemble, falsify, folds, forests, panel as pn, scoring, signals as sg
from panelwright.operators.features import FEATURES
from panelwright.params import JobParams


@dataclass(frozen=True)
class Refits:
    """What all refits came to. Tables have a row for each refit (column model), `oof` one for each of its validation rows."""

    made: forests.Ensembles
    #: Of each refit that had data enough, the number of its model over the whole panel; empty where none was asked for.
    last: dict[int, int]
    oof: DataFrame
    ridge: DataFrame
    calibration: DataFrame


def fold_days(days: DataFrame, params: JobParams) -> DataFrame:
    """panel, fold, train_stop, val_start, val_stop as dates, from the panels' dates (panel, date); ends are exclusive, and
    a null val_stop has no end. A panel has a row a day, so numbering its days is no burden."""
    order = Window.partitionBy("panel").orderBy("date")
    placed = days.withColumn("pos", F.row_number().over(order) - 1)
    size = placed.groupBy("panel").agg(F.count("*").cast("int").alias("n_dates"))
    block = size.select("panel", "n_dates", F.explode(F.sequence(F.lit(1), F.lit(params.n_folds))).alias("i"))
    at = folds._bounds(F.col("n_dates"), params)
    block = block.select("panel", "i", at(F.col("i")).alias("a"), at(F.col("i") + 1).alias("b")).withColumn("stop", F.col("a") - params.embargo)
    block = block.where("stop >= 1 and b > a").withColumn("fold", F.row_number().over(Window.partitionBy("panel").orderBy("i")) - 1)
    for name, place in (("train_stop", "stop"), ("val_start", "a"), ("val_stop", "b")):
        block = block.join(placed.select("panel", F.col("pos").alias(place), F.col("date").alias(name)), ["panel", place], "left")
    return block.select("panel", "fold", "train_stop", "val_start", "val_stop")


def _day(date: dt.date | None) -> int:
    return forests.EVER if date is None else (date - dt.date(1970, 1, 1)).days


def fit(data: DataFrame, days: DataFrame, refits: list[tuple[int, int]], params: JobParams, whole: bool = False) -> Refits:
    """All refits (panel, label) over `data` (forests.rows with date and ticker, stored), whose panels have the dates `days`.

    A refit's number is its place in `refits`. Refits without folds or with too few rows have no rows in any table.
    """
    by_panel: dict[int, list] = {}
    for r in fold_days(days, params).orderBy("panel", "fold").collect():  # folds of each panel, at most
        by_panel.setdefault(r["panel"], []).append(r)
    models, spans, last = [], [], {}
    for number, (panel, label) in enumerate(refits):
        for r in by_panel.get(panel, []):
            spans.append((panel, label, number, len(models), r["fold"], _day(r["val_start"]), _day(r["val_stop"])))
            models.append(forests.Fit(panel, label, _day(r["train_stop"])))
        if whole and panel in by_panel:
            last[number] = len(models)
            models.append(forests.Fit(panel, label))
    trained = data.select(*(c.split()[0] for c in forests.ROW.split(", ")))
    made = forests.train(trained, models, params)
    session = data.sparkSession
    # A row for each fold of each refit.
    held = session.createDataFrame(spans, "panel int, label int, model int, number int, fold int, first int, stop int")
    inside = ((F.col("panel") >= F.col("since")) & (F.col("panel") <= F.col("until")) & (F.col("day") >= F.col("first")) & (F.col("day") < F.col("stop")))
    wanted = data.join(F.broadcast(held), inside).select("model", "number", "fold", "date", "ticker", F.get("ys", F.col("label")).alias("y"), "bins")
    voted = forests.score(wanted, made)
    raw = sizing.written(voted.select("model", "date", "ticker", "fold", "rf", "gb", ensemble.vote_std(F.col("votes")).alias("tree_std"), "y"))
    enough = raw.groupBy("model").agg(F.count("*").alias("n")).where(F.col("n") >= params.min_oof_rows).select("model")
    raw = ensemble.complete_oof(raw).join(F.broadcast(enough), "model", "left_semi")
    ridge = sizing.cut(ensemble.fit_ridge(raw))
    oof = ensemble.stacked(raw, ridge)
    return Refits(made, last, oof, ridge, sizing.cut(ensemble.calibration(oof)))


# ------------------------------------------------------------------ falsification
def falsification(z: DataFrame, lagged_z: DataFrame, seeds: list[int], params: JobParams) -> tuple[Refits, list[tuple[str, int | None]]]:
    """Refits of the true labels, of each permutation within days, and of features lagged by a row; and what each refit is.

    The permuted labels ride beside the true one, so the matrix is stored once for all of them.
    """
    # What the joins move are bins and labels, a byte a feature.
    here = z.select("date", "ticker", "y", forests.binned().alias("bins"))
    here = here.join(falsify.permutations(z, seeds), ["date", "ticker"])
    here = forests.rows(here, F.lit(0), F.lit(0), F.array("y", *(f"y{k}" for k in range(len(seeds)))), "date", "ticker")
    there = forests.rows(lagged_z, F.lit(1), F.lit(1), F.array(*[F.col("y")] * (1 + len(seeds))), "date", "ticker")
    data = sizing.written(here.unionByName(there))
    days = data.select(F.col("since").alias("panel"), "date").distinct()
    kinds: list[tuple[str, int | None]] = [("real", None), *(("permuted", s) for s in seeds), ("lagged", None)]
    refits = [(0, label) for label in range(1 + len(seeds))] + [(1, 0)]
    return fit(data, days, refits, params), kinds


def named(found: DataFrame, kinds: list[tuple[str, int | None]]) -> DataFrame:
    """A table by refit with kind and seed in place of its number."""
    names = F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(s).cast("int").alias("seed")) for k, s in kinds))
    return found.withColumn("what", F.get(names, F.col("model"))).select("what.*", *[c for c in found.columns if c != "model"])


# ------------------------------------------------------------------ walk-forward
def joined_from(cutoffs: list[dt.date], ready: Column) -> Column:
    """Number of the first cutoff after `ready`; as many as there are cutoffs, if none is."""
    return F.size(F.filter(F.array(*map(F.lit, cutoffs)), lambda c: c <= ready))


def panels(feats: DataFrame, cutoffs: list[dt.date], params: JobParams) -> DataFrame:
    """Normalised rows of the panels at all cutoffs, valid from panel `since` to panel `until`.

    A row is a member from the first cutoff after its label's end at which its ticker has rows enough. A day whose members
    are all there by some cutoff has one cross-section from then on, which all later panels share; only before that is
    it normalised for each panel by itself. So a panel more costs the rows of its unfinished days, not its whole past.
    """
    n = len(cutoffs)
    gate = feats.where(F.col("row_no") == params.min_feature_rows + 1).select("ticker", F.col("date").alias("gated"))
    members = pn.build_panel(feats).join(gate, "ticker")
    since = joined_from(cutoffs, F.greatest("label_end", "gated"))
    members = sizing.cut(members.withColumn("joined", since).where(F.col("joined") < n).drop("gated"))
    # Rows that no cutoff lets in are no members, but keep a day from being finished only where they'd join it later.
    whole = members.groupBy("date").agg(F.max("joined").alias("whole"))
    members = members.join(whole, "date")
    shared = members.withColumn("since", F.col("whole")).withColumn("until", F.lit(n - 1))
    early = members.where("joined < whole").withColumn("since", F.explode(F.sequence("joined", F.col("whole") - 1))).withColumn("until", F.col("since"))
    return pn.normalise(shared.unionByName(early).withColumn("section", F.struct("date", "since")), "section", params=params).drop(
        "section", "joined", "whole")


def walk_forward(feats: DataFrame, bars: DataFrame, info: DataFrame, rebalances: DataFrame, params: JobParams,
                 span: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Model-driven schedule(strategy, k, ticker, weight) over the rebalance dates, and the calibration by retrain.

    Features are computed once and cut by date, which is valid because they don't depend on later rows. Every
    `retrain_stride`-th rebalance refits on rows before it, and the rebalances up to the next refit are scored by it. A
    refit that lacks data leaves the model before it in place.
    """
    dates = [(r["k"], r["date"]) for r in rebalances.select("k", "date").orderBy("k").collect()]
    empty = rebalances.sparkSession.createDataFrame([], "strategy string, k int, ticker string, weight double")
    none = rebalances.sparkSession.createDataFrame([], "model int, cutoff date, n_oof long, oof_r2 double, residual_std double")
    cutoffs = [d for _, d in dates[::params.retrain_stride]]
    if not cutoffs:
        return empty, none
    z = panels(feats, cutoffs, params)
    data = sizing.written(forests.rows(z, F.col("since"), F.col("until"), F.array("y"), "date", "ticker"))
    spans = data.groupBy("date").agg(F.min("since").alias("first"))
    days = spans.select(F.explode(F.sequence("first", F.lit(len(cutoffs) - 1))).alias("panel"), "date")
    found = fit(data, days, [(j, 0) for j in range(len(cutoffs))], params, whole=True)
    cal = found.calibration.join(rebalances.sparkSession.createDataFrame(list(enumerate(cutoffs)), "model int, cutoff date"), "model")
    cal = cal.select("model", "cutoff", "n_oof", "oof_r2", "residual_std")
    usable = {r["model"] for r in cal.select("model").collect()}
    usable = sorted(j for j in usable if found.made.rows[found.last[j]] >= params.min_panel_rows)
    serving = []
    for at, (_, date) in enumerate(dates):
        own = [j for j in usable if j <= at // params.retrain_stride]
        if own:
            serving.append((date, own[-1], found.last[own[-1]]))
    if not serving:
        return empty, cal
    latest = sizing.cut(scoring.latest_rows_at(feats, [d for _, d in dates], params))
    scored = scoring.normalised_latest(latest, len(dates), params).select("as_of", "ticker", forests.binned().alias("bins"))
    by_date = rebalances.sparkSession.createDataFrame(serving, "as_of date, model int, number int")
    voted = forests.score(scored.join(F.broadcast(by_date), "as_of"), found.made)
    preds = scoring.predictions(ensemble.stacked(voted, found.ridge), found.calibration, params).drop("model")
    cands = sg.candidates(sg.signals(preds, latest, info, params), params.backtest_min_return, params)
    weights = allocation.optimise(allocation.covariance(allocation.problems(allocation.trailing_returns(cands, bars, params))), params)
    held = allocation.held(weights).join(rebalances.select("k", F.col("date").alias("as_of")), "as_of")
    return held.select(F.lit("strategy").alias("strategy"), "k", "ticker", "weight"), cal
