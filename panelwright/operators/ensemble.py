"""Stacked ensemble: bagged and boosted trees out of fold, then a ridge on top.

Tree fitting is MLlib's distributed histogram training. Everything after it
(per-tree spread, ridge, calibration) is DataFrame arithmetic.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import (GBTRegressionModel, GBTRegressor,
                                   RandomForestRegressionModel, RandomForestRegressor)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.functions import sizing, windows as w
from panelwright.operators.features import FEATURES
from panelwright.params import JobParams

# Ridge penalties tried, agreement slope, fallback residual deviation.
RIDGE_ALPHAS = [0.1, 1.0, 10.0, 100.0]
AGREEMENT_SLOPE = 5.0
DEFAULT_RESIDUAL_STD = 0.10
SUSPICIOUS_R2 = 0.05
POWERLESS_R2 = -0.05
#: Panel rows, times the folds that are fitted at a time, that MLlib may hold binned copies of, and such folds at most.
SIDE_BY_SIDE, MOST_FOLDS = 4_000_000, 4


def assembled(panel: DataFrame, cols: list[str] | None = None) -> DataFrame:
    return VectorAssembler(inputCols=cols or FEATURES, outputCol="x").transform(panel)


@dataclass(frozen=True)
class BaseModels:
    """Fitted forest and boosted trees; ``centre`` is the mean target removed before boosting."""

    forest: RandomForestRegressionModel
    boosted: GBTRegressionModel
    centre: float

    def predict(self, rows: DataFrame) -> DataFrame:
        """Add ``rf``, ``gb`` and the forest's leaf indices to assembled rows."""
        out = self.forest.transform(rows).withColumnRenamed("prediction", "rf")
        out = self.boosted.transform(out).withColumn("gb", F.col("prediction") + self.centre)
        return out.drop("prediction")


def fit_base(train: DataFrame, params: JobParams) -> BaseModels:
    """Fit both learners on assembled training rows (columns ``x``, ``y``)."""
    centre = train.agg(F.avg("y")).first()[0]
    forest = RandomForestRegressor(
        featuresCol="x", labelCol="y", numTrees=params.rf_trees, maxDepth=params.rf_depth,
        minInstancesPerNode=params.rf_leaf, featureSubsetStrategy="sqrt", maxBins=128,
        seed=params.seed, leafCol="leaf").fit(train)
    boosted = GBTRegressor(
        featuresCol="x", labelCol="y0", maxIter=params.gb_rounds, maxDepth=params.gb_depth,
        stepSize=params.gb_rate, minInstancesPerNode=params.gb_leaf, maxBins=128,
        subsamplingRate=params.gb_subsample, seed=params.seed,
    ).fit(train.withColumn("y0", F.col("y") - centre))
    return BaseModels(forest, boosted, centre)


def leaf_table(models: BaseModels, key: str, value) -> DataFrame:
    """One row: ``key`` and the forest's leaf values as array<array<double>>, by tree and leaf.

    The size is set by the parameters: trees x 2^depth values. Leaf k of a tree
    is its k-th leaf in node-id order, read back from the stored model.
    """
    from pyspark.sql import SparkSession
    session = SparkSession.active()
    path = sizing.shared_path(session, "forest")
    models.forest.save(path)
    nodes = session.read.parquet(f"{path}/data").select("treeID", "nodeData.*")
    leaves = nodes.where(F.col("leftChild") < 0)
    trees = leaves.groupBy("treeID").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("id", "prediction"))),
                    lambda n: n["prediction"]).alias("values"))
    forest = trees.agg(F.transform(F.array_sort(F.collect_list(F.struct("treeID", "values"))),
                                   lambda t: t["values"]).alias("leaf_values"))
    return forest.select(F.lit(value).alias(key), "leaf_values")


def tree_votes(rows: DataFrame, leaves: DataFrame, key: str) -> DataFrame:
    """Add ``votes``, the per-tree predictions. ``leaves`` has one row per fitted forest."""
    joined = rows.join(F.broadcast(leaves), key)
    index = vector_to_array("leaf")
    votes = F.zip_with(F.col("leaf_values"), index,
                       lambda values, k: F.get(values, k.cast("int")))
    return joined.withColumn("votes", votes).drop("leaf", "leaf_values")


def vote_std(votes: Column) -> Column:
    """Population deviation over an array of votes."""
    n = F.size(votes)
    total = F.aggregate(votes, F.lit(0.0), lambda a, v: a + v)
    square = w.let(total / n, lambda mean: F.aggregate(
        votes, F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean)))
    return F.sqrt(square / n)


def vote_percentile(votes: Column, pct: float) -> Column:
    """Percentile of an array with linear interpolation between order statistics."""
    at = (F.size(votes) - 1) * F.lit(pct / 100.0)
    low = F.floor(at).cast("int")

    def between(ordered: Column) -> Column:
        a = F.get(ordered, low)
        b = F.get(ordered, F.least(low + 1, F.size(votes) - 1))
        return a + (b - a) * (at - low)

    return w.let(F.array_sort(votes), between)


def side_by_side(rows: int, folds: int) -> int:
    """Folds over a panel of so many rows that are fitted at a time."""
    return max(1, min(MOST_FOLDS, folds, SIDE_BY_SIDE // max(1, rows)))


def out_of_fold(panel: DataFrame, roles: DataFrame, params: JobParams) -> DataFrame:
    """Predictions of both learners on every validation row, with the vote deviation.

    ``panel`` (normalised, cheap to read) is read once a pass and filtered per fold;
    ``roles`` is the stored per-day fold table. MLlib keeps a binned copy of a
    fold's training rows, so nothing else of the panel's width is kept or moved.
    Folds are independent jobs; as many run side by side as SIDE_BY_SIDE allows.
    """
    rows = assembled(panel).select("date", "ticker", "x", "y")
    folds = [r["fold"] for r in roles.select("fold").distinct().orderBy("fold").collect()]
    small = sizing.fits_broadcast(roles)

    def part(fold: int, role: str) -> DataFrame:
        days = roles.where((F.col("fold") == fold) & (F.col("role") == role)).select("date")
        return rows.join(F.broadcast(days) if small else days, "date", "left_semi")

    def one(fold: int) -> DataFrame:
        models = fit_base(part(fold, "train").select("x", "y"), params)
        scored = models.predict(part(fold, "val")).withColumn("fold", F.lit(fold))
        voted = tree_votes(scored, leaf_table(models, "fold", fold), "fold")
        return voted.select("date", "ticker", "fold", "rf", "gb",
                            vote_std(F.col("votes")).alias("tree_std"), "y")

    with ThreadPoolExecutor(max_workers=side_by_side(panel.count(), len(folds))) as pool:
        parts = list(pool.map(one, folds))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return sizing.cut(out)


def complete_oof(oof: DataFrame) -> DataFrame:
    """Rows both learners predicted."""
    return oof.where(F.col("rf").isNotNull() & F.col("gb").isNotNull())


def _ridge_terms(alpha: float):
    a, b, c = F.col("s_rr") + alpha, F.col("s_gg") + alpha, F.col("s_rg")
    det = a * b - c * c
    return a, b, c, det


def fit_ridge(oof: DataFrame, by: str = "model") -> DataFrame:
    """Two-input ridge per ``by`` group, penalty picked by leave-one-out error.

    Closed form from one aggregate; a second pass averages the squared
    leave-one-out residual e/(1-h) of all penalties at once. The result has one
    row per model.
    """
    n = F.col("n")
    moments = oof.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.avg("rf").alias("m_r"), F.avg("gb").alias("m_g"),
        F.avg("y").alias("m_y"), F.var_pop("rf").alias("v_rr"), F.var_pop("gb").alias("v_gg"),
        F.covar_pop("rf", "gb").alias("v_rg"), F.covar_pop("rf", "y").alias("v_ry"),
        F.covar_pop("gb", "y").alias("v_gy"))
    sums = moments.select(by, "n", "m_r", "m_g", "m_y",
                          *[(F.col(f"v_{k}") * n).alias(f"s_{k}") for k in ("rr", "gg", "rg", "ry", "gy")])
    solved = []
    for i, alpha in enumerate(RIDGE_ALPHAS):
        a, b, c, det = _ridge_terms(alpha)
        solved += [((b * F.col("s_ry") - c * F.col("s_gy")) / det).alias(f"w_r{i}"),
                   ((a * F.col("s_gy") - c * F.col("s_ry")) / det).alias(f"w_g{i}")]
    fits = sums.select("*", *solved)
    rows = oof.select(by, "rf", "gb", "y").join(F.broadcast(fits), by)
    r, g = F.col("rf") - F.col("m_r"), F.col("gb") - F.col("m_g")
    errors = []
    for i, alpha in enumerate(RIDGE_ALPHAS):
        a, b, c, det = _ridge_terms(alpha)
        leverage = 1.0 / n + (b * r * r - 2 * c * r * g + a * g * g) / det
        residual = F.col("y") - F.col("m_y") - r * F.col(f"w_r{i}") - g * F.col(f"w_g{i}")
        loo = residual / (1 - leverage)
        errors.append(F.avg(loo * loo).alias(f"loo_{i}"))
    scored = rows.groupBy(by).agg(*errors).join(fits, by)
    best = F.array_min(F.array(*[
        F.struct(F.col(f"loo_{i}").alias("loo"), F.lit(alpha).alias("alpha"),
                 F.col(f"w_r{i}").alias("w_r"), F.col(f"w_g{i}").alias("w_g"))
        for i, alpha in enumerate(RIDGE_ALPHAS)]))
    out = scored.select(by, "n", "m_r", "m_g", "m_y", best.alias("b"))
    return out.select(
        by, "n", F.col("b.alpha").alias("alpha"), F.col("b.loo").alias("loo_error"),
        F.col("b.w_r").alias("w_rf"), F.col("b.w_g").alias("w_gb"),
        (F.col("m_y") - F.col("b.w_r") * F.col("m_r") - F.col("b.w_g") * F.col("m_g")).alias("intercept"))


def agreement(rf: Column, gb: Column) -> Column:
    return 1.0 / (1.0 + AGREEMENT_SLOPE * F.abs(rf - gb))


def stacked(rows: DataFrame, ridge: DataFrame, by: str = "model") -> DataFrame:
    """Add the ridge prediction and the agreement score. ``ridge`` has one row per model."""
    out = rows.join(F.broadcast(ridge.select(by, "w_rf", "w_gb", "intercept")), by)
    pred = F.col("intercept") + F.col("w_rf") * F.col("rf") + F.col("w_gb") * F.col("gb")
    return out.select(*rows.columns, pred.alias("pred"),
                      agreement(F.col("rf"), F.col("gb")).alias("confidence"))


def calibration(oof: DataFrame, by: str = "model") -> DataFrame:
    """R2, residual deviation and error per model, with the sanity flag.

    The ridge is scored on the rows it was fitted on, so this R2 leans upward.
    """
    e = F.col("y") - F.col("pred")
    out = oof.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_oof"), F.sum(e * e).alias("_sse"),
        (F.var_pop("y") * F.count(F.lit(1))).alias("_sst"),
        F.stddev_pop(e).alias("residual_std"), F.avg(F.abs(e)).alias("residual_mae"))
    r2 = 1 - F.try_divide(F.col("_sse"), F.col("_sst"))
    return out.select(
        by, "n_oof", r2.alias("oof_r2"), "residual_std", "residual_mae",
        F.when(r2 > SUSPICIOUS_R2, "suspicious").when(r2 < POWERLESS_R2, "powerless")
        .otherwise("plausible").alias("r2_flag"))


def importances(models: BaseModels, cols: list[str] | None = None) -> DataFrame:
    """Forest importances by column; one row per column."""
    return named_importances(models.forest.featureImportances.toArray(), cols)


def named_importances(values, cols: list[str] | None = None) -> DataFrame:
    from pyspark.sql import SparkSession
    rows = [(c, float(v)) for c, v in zip(cols or FEATURES, values)]
    return SparkSession.active().createDataFrame(rows, "feature string, importance double")
