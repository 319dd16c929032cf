"""Pooled (date, ticker) panel: labels, cutoff purge, cross-sectional z-scores."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from panelwright.functions import sizing, windows as w
from panelwright.operators.features import FEATURES
from panelwright.params import JobParams


def labels(bars: DataFrame, params: JobParams = JobParams()) -> DataFrame:
    """Forward return over ``horizon`` rows of the ticker's own calendar, and its end date."""
    close = F.col("close").cast("double")
    src = bars.select("ticker", "date", close.alias("c"))
    ahead = src.select(
        "*", F.lead("c", params.horizon).over(w.dated()).alias("c_next"),
        F.lead("date", params.horizon).over(w.dated()).alias("label_end"))
    return ahead.select("ticker", "date", (w.ratio(F.col("c_next"), F.col("c")) - 1).alias("y"),
                        "label_end").where(F.col("y").isNotNull())


def build_panel(feats: DataFrame, cutoff: dt.date | None = None,
                label_table: DataFrame | None = None) -> DataFrame:
    """Labelled indicator rows in double precision; labels must end before ``cutoff``.

    Features already carry their label. A separate ``label_table`` (permuted or
    foreign labels) replaces it by an inner join on (ticker, date).
    """
    rows = feats
    if label_table is not None:
        rows = feats.drop("y", "label_end").join(
            label_table.select("ticker", "date", "y", "label_end"), ["ticker", "date"])
    if cutoff is not None:
        rows = rows.where(F.col("label_end") < F.lit(cutoff))
    kept = rows.select("date", "ticker", *[F.col(f).cast("double").alias(f) for f in FEATURES],
                       w.finite(F.col("y")).alias("y"), "label_end")
    return kept.where(F.col("y").isNotNull() & F.col("label_end").isNotNull())


def cross_section_stats(rows: DataFrame, by: str, cols: list[str]) -> DataFrame:
    """Mean and sample deviation per cross-section, combined in the task and once more per cross-section.

    One day may hold any share of the tickers, so tasks add up counts, means and squared deviations per day, which the calendar
    bounds, and only these are dealt by day; the result has one row per day. NULL values don't count. Keys of several
    fields, which Arrow can't number, are left to Spark's aggregate.
    """
    if isinstance(rows.schema[by].dataType, T.StructType):
        return rows.groupBy(by).agg(*[F.avg(c).alias(f"{c}__m") for c in cols], *[F.stddev_samp(c).alias(f"{c}__s") for c in cols])
    kind, width = rows.schema[by].dataType.simpleString(), len(cols)

    def parts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place: dict = {}
        sums = np.zeros((3, 0, width))
        for batch in batches:
            found = batch.column(by).dictionary_encode(null_encoding="encode")
            here, at = found.dictionary.to_pylist(), found.indices.to_numpy()
            if not here:
                continue
            for day in here:
                place.setdefault(day, len(place))
            if len(place) > sums.shape[1]:
                sums = np.concatenate([sums, np.zeros((3, len(place), width))], axis=1)
            order = np.argsort(at, kind="stable")
            starts = np.flatnonzero(np.diff(at[order], prepend=-1))
            there = np.stack([np.asarray(batch.column(c).is_valid()) for c in cols], axis=1)[order]
            x = np.where(there, np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in cols], axis=1)[order], 0.0)
            n = np.add.reduceat(there.astype(float), starts, axis=0)
            mean = np.add.reduceat(x, starts, axis=0) / np.maximum(n, 1)
            gap = np.where(there, x - mean[at[order]], 0.0)
            own = [place[day] for day in here]
            sums[:, own] = _merged(np.stack([sums[:, own], np.stack([n, mean, np.add.reduceat(gap * gap, starts, axis=0)])]))
        days = pa.array(list(place), shape.field(by).type)
        for at in range(0, len(days), 1024):
            part = sums[:, at:min(at + 1024, len(days))]
            yield pa.RecordBatch.from_arrays([days[at:at + 1024], *[pa.array(list(x), pa.list_(pa.float64())) for x in part]], schema=shape)

    shape = pa.schema([(by, to_arrow_type(rows.schema[by].dataType)), *[(x, pa.list_(pa.float64())) for x in ("n", "mean", "m2")]])

    def whole(group: pa.Table) -> pa.Table:
        tables = [group.column(x).combine_chunks().flatten().to_numpy().reshape(-1, width) for x in ("n", "mean", "m2")]
        n, mean, m2 = _merged(np.stack(tables, axis=1))
        with np.errstate(all="ignore"):
            sd = np.sqrt(m2 / (n - 1))
        values = {f"{c}__m": pa.array(mean[k:k + 1], mask=n[k:k + 1] < 1) for k, c in enumerate(cols)}
        values |= {f"{c}__s": pa.array(sd[k:k + 1], mask=n[k:k + 1] < 2) for k, c in enumerate(cols)}
        return pa.table({by: group.column(by)[:1]} | values)

    made = rows.select(by, *cols).mapInArrow(parts, f"{by} {kind}, n array<double>, mean array<double>, m2 array<double>")
    return made.groupBy(by).applyInArrow(whole, ", ".join([f"{by} {kind}", *[f"{c}__{x} double" for x in "ms" for c in cols]]))


def _merged(parts: np.ndarray) -> np.ndarray:
    """Counts, means and squared deviations (second axis) of all parts (first axis) together."""
    n, mean, m2 = parts[:, 0], parts[:, 1], parts[:, 2]
    total = n.sum(axis=0)
    centre = (n * mean).sum(axis=0) / np.maximum(total, 1)
    return np.stack([total, centre, (m2 + n * (mean - centre) ** 2).sum(axis=0)])


def z_score(x: Column, mean: Column, sd: Column) -> Column:
    return (x - mean) / F.coalesce(F.nullif(w.finite(sd), F.lit(0.0)), F.lit(1.0))


def normalise(rows: DataFrame, by: str = "date", cols: list[str] | None = None,
              span: int | None = None, params: JobParams = JobParams(), stats: DataFrame | None = None) -> DataFrame:
    """Z-score every column across the tickers of each ``by`` group.

    ``rows`` is read twice, so hand in a persisted or stored table. ``span`` is
    the measured calendar span, which decides whether the statistics are broadcast.
    ``stats`` holds the cross_section_stats of ``rows`` where they have been stored already.
    """
    cols = cols or FEATURES
    stats = cross_section_stats(rows, by, cols) if stats is None else stats
    joined = sizing.attach_by_day(rows, stats, by, span, params.broadcast_days)
    other = [c for c in rows.columns if c not in cols]
    return joined.select(*other, *[
        z_score(F.col(c), F.col(f"{c}__m"), F.col(f"{c}__s")).alias(c) for c in cols])


def panel_profile(panel: DataFrame) -> DataFrame:
    """Row, date and ticker counts, and the target's mean and sample deviation."""
    return panel.agg(
        F.count(F.lit(1)).alias("n_rows"), F.lit(len(FEATURES)).alias("n_features"),
        F.countDistinct("date").alias("n_dates"), F.countDistinct("ticker").alias("n_tickers"),
        F.avg("y").alias("y_mean"), F.stddev_samp("y").alias("y_std"))


def large_enough(panel: DataFrame, params: JobParams = JobParams()) -> bool:
    return panel.limit(params.min_panel_rows).count() >= params.min_panel_rows
