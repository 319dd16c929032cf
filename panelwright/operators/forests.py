"""Tree ensembles of many models at once: folds, label permutations, lagged panels and retrains over one binned matrix.

All models read the same stored rows. A row is valid for a range of panels and carries a label for each permutation, so a
model is no table of its own but a condition: panel, label and the day before which its rows lie. Trees grow level by level.
A pass over the rows adds up, in every task, the histograms of all open nodes of all models; the histograms of a tree
meet in one task, which picks the splits. What comes to the driver are splits, whose number is set by the parameters.
Forests need a pass a level for as many trees as fit into HISTOGRAM_BYTES, boosted trees a pass a round and level.

Features are z-scores, so their bins are fixed: BINS equal steps between -SPREAD and SPREAD deviations. No edge is learnt
from later rows. Bootstrap weights and samples are drawn from a hash of the row's key and the tree, so that any order,
partitioning or repeated task gives the same trees.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.functions import sizing
from panelwright.operators.features import FEATURES
from panelwright.params import JobParams

BINS, SPREAD = 32, 4.0
#: Histograms that a task holds at a time.
HISTOGRAM_BYTES = 96 << 20
#: Histograms of all tasks together that the driver adds up itself; larger ones meet by tree in tasks.
DRIVER_BYTES = 32 << 20
#: Rows of a task at least: every task gives out the histograms of all open nodes, whatever its rows.
TASK_ROWS = 10_000
#: Rounds of boosting after which each row's sums of earlier trees are stored.
STATE_EVERY = 20
#: Cumulative chances of 0, 1, 2, ... draws of a row in a bootstrap sample of the rows.
_DRAWN = np.cumsum([np.exp(-1.0) / f for f in (1, 1, 2, 6, 24, 120, 720, 5040)])
ROW = "day int, since int, until int, draw long, ys array<double>, bins array<tinyint>"
EVER = np.iinfo(np.int32).max


@dataclass(frozen=True)
class Fit:
    """A model: it trains on the rows of `panel` on days before `stop`, with the labels of number `label`."""

    panel: int
    label: int
    stop: int = EVER


@dataclass
class Trees:
    """Trees of all models as heaps: node k has children 2k + 1 and 2k + 2; feature -1 ends. Gains are by model, tree and feature."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    @staticmethod
    def none(models: int, trees: int, depth: int) -> "Trees":
        shape = (models, trees, 2 ** (depth + 1) - 1)
        return Trees(np.full(shape, -1, np.int8), np.zeros(shape, np.int8), np.zeros(shape), np.zeros((models, trees, len(FEATURES))))


@dataclass
class Ensembles:
    """Forest and boosted trees of every model, the mean label each started from, and its number of training rows."""

    fits: list[Fit]
    forest: Trees
    boosted: Trees
    centre: np.ndarray
    rows: np.ndarray
    rate: float


def binned(cols: list[str] | None = None) -> Column:
    """Bins of z-scored columns."""
    step = BINS / (2 * SPREAD)
    return F.array(*[F.least(F.lit(BINS - 1.0), F.greatest(F.lit(0.0), F.floor(F.col(c) * step) + BINS / 2)).cast("tinyint")
                     for c in cols or FEATURES])


def rows(z: DataFrame, since: Column, until: Column, labels: Column, *keys: str) -> DataFrame:
    """Training rows of a normalised panel, with the columns `keys` beside. A panel that has `bins` already needs no z-scores."""
    return z.select(*keys, F.unix_date("date").alias("day"), since.cast("int").alias("since"), until.cast("int").alias("until"),
                    F.xxhash64("date", "ticker").alias("draw"), labels.alias("ys"), F.col("bins") if "bins" in z.columns else binned().alias("bins"))


# ------------------------------------------------------------------ inside tasks
class _Batch:
    def __init__(self, batch: pa.RecordBatch) -> None:
        column = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        self.n = batch.num_rows
        self.bins = column["bins"].flatten().to_numpy(zero_copy_only=False).reshape(self.n, -1)
        #: All bins in a row, and where each row's begin.
        self.flat, self.base = self.bins.ravel(), np.arange(self.n) * self.bins.shape[1]
        self.day, self.since, self.until = (column[c].to_numpy() for c in ("day", "since", "until"))
        self.draw = column["draw"].to_numpy().view(np.uint64)
        self.ys = column["ys"].flatten().to_numpy(zero_copy_only=False).reshape(self.n, -1)
        self.sums = column["sums"].flatten().to_numpy(zero_copy_only=False).reshape(self.n, -1) if "sums" in column else None

    # Places are known to lie inside of what they're taken from, so takes needn't check them (mode="wrap").
    def of(self, fit: Fit) -> np.ndarray:
        return np.flatnonzero((self.since <= fit.panel) & (fit.panel <= self.until) & (self.day < fit.stop))

    def uniform(self, seed: int) -> np.ndarray:
        """Numbers in [0, 1) for every row, from its key and the seed."""
        x = self.draw + np.uint64((seed * 0x9E3779B97F4A7C15) % (1 << 64))
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        return (x ^ (x >> np.uint64(31))) / 2.0 ** 64


def _nodes(flat: np.ndarray, base: np.ndarray, feature: np.ndarray, cut: np.ndarray, depth: int) -> np.ndarray:
    """Node that each row has reached after `depth` steps: a row's bins begin at `base` in `flat`. A row stays where a tree ends."""
    node = np.zeros(len(base), np.intp)
    held, ends = np.maximum(feature, 0).astype(np.intp), feature < 0
    stops = bool(ends[:2 ** depth - 1].any())
    for _ in range(depth):
        down = 2 * node + 1 + (flat.take(base + held.take(node, mode="wrap"), mode="wrap") > cut.take(node, mode="wrap"))
        node = np.where(ends.take(node, mode="wrap"), node, down) if stops else down
    return node


def _boosted(flat: np.ndarray, base: np.ndarray, trees: Trees, model: int, first: int, rounds: int) -> np.ndarray:
    depth, total = int(np.log2(trees.feature.shape[2] + 1)) - 1, np.zeros(len(base))
    for t in range(first, rounds):
        total += trees.value[model, t][_nodes(flat, base, trees.feature[model, t], trees.cut[model, t], depth)]
    return total


@dataclass
class _Unit:
    """A tree's open nodes at one level."""

    model: int
    tree: int
    nodes: list[int]
    features: np.ndarray  # a row for each node

    @property
    def size(self) -> int:
        return self.features.size * BINS


def _histograms(batches: Iterable[pa.RecordBatch], fits: list[Fit], units: list[_Unit], trees: Trees, depth: int,
                weight: Callable, target: Callable) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    slots = np.full(trees.feature.shape[2], -1)
    for batch in map(_Batch, batches):
        weights: dict[int, np.ndarray] = {}
        own, goal = {}, {}
        for u, unit in enumerate(units):
            if unit.tree not in weights:
                weights[unit.tree] = weight(batch, unit.tree)
            if unit.model not in own:
                own[unit.model] = batch.of(fits[unit.model])
                goal[unit.model] = target(batch, unit.model, own[unit.model])
            w = weights[unit.tree].take(own[unit.model], mode="wrap")
            drawn = np.flatnonzero(w)
            at, y, w = (x.take(drawn, mode="wrap") for x in (own[unit.model], goal[unit.model], w))
            first = batch.base.take(at, mode="wrap")
            slots[unit.nodes] = np.arange(len(unit.nodes))
            slot = slots.take(_nodes(batch.flat, first, trees.feature[unit.model, unit.tree], trees.cut[unit.model, unit.tree], depth), mode="wrap")
            slots[unit.nodes] = -1
            inside = np.flatnonzero(slot >= 0)
            if len(inside) < len(slot):
                first, y, w, slot = (x.take(inside, mode="wrap") for x in (first, y, w, slot))
            # One drawn feature at a time, so that what is gathered stays in the processor's cache; each bin has its place in the node's histogram.
            k = unit.features.shape[1]
            if u not in held:
                held[u] = np.zeros((2, unit.size))
            n, s = held[u].reshape(2, len(unit.nodes), k, BINS)
            place, wy, size = slot * BINS, w * y, len(unit.nodes) * BINS
            ones = bool((w == 1).all())
            for j, drawn_feature in enumerate(unit.features.T):
                same = drawn_feature[0] if (drawn_feature == drawn_feature[0]).all() else drawn_feature.take(slot, mode="wrap")
                bins = place + batch.flat.take(first + same, mode="wrap")
                n[:, j] += np.bincount(bins, None if ones else w, size).reshape(-1, BINS)
                s[:, j] += np.bincount(bins, wy, size).reshape(-1, BINS)
    for u, histogram in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([u], pa.int32()), pa.array([histogram.tobytes()], pa.binary())], names=["unit", "sums"])


_SPLIT = "unit int, slot int, feature int, cut int, n double, s double, n_left double, s_left double, gain double"


def _splits(batches: Iterable[pa.RecordBatch], units: list[_Unit], leaf: int) -> Iterator[pa.RecordBatch]:
    """The best split of each node, from the sorted partial histograms of its tree."""
    def best(u: int, total: np.ndarray) -> pa.RecordBatch:
        unit = units[u]
        n, s = total.reshape(2, len(unit.nodes), -1, BINS)
        left_n, left_s = np.cumsum(n, axis=2)[:, :, :-1], np.cumsum(s, axis=2)[:, :, :-1]
        whole_n, whole_s = n[:, :1].sum(axis=2, keepdims=True), s[:, :1].sum(axis=2, keepdims=True)
        right_n, right_s = whole_n - left_n, whole_s - left_s
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = left_s ** 2 / left_n + right_s ** 2 / right_n - whole_s ** 2 / whole_n
        gain = np.where((left_n >= leaf) & (right_n >= leaf) & (gain > 1e-12), gain, -1.0).reshape(len(unit.nodes), -1)
        at = gain.argmax(axis=1)
        slot = np.arange(len(unit.nodes))
        top = gain[slot, at]
        which, cut = np.divmod(at, BINS - 1)
        values = [np.full(len(slot), u), slot, np.where(top > 0, unit.features[slot, which], -1), cut, whole_n[:, 0, 0], whole_s[:, 0, 0],
                  left_n.reshape(len(slot), -1)[slot, at], left_s.reshape(len(slot), -1)[slot, at], top]
        kinds = [pa.int32()] * 4 + [pa.float64()] * 5
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], names=[f.split()[0] for f in _SPLIT.split(", ")])

    now, total = None, None
    for batch in batches:
        for u, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
            part = np.frombuffer(raw.as_buffer(), np.float64)
            if u != now:
                if now is not None:
                    yield best(now, total)
                now, total = u, part.copy()
            else:
                total += part
    if now is not None:
        yield best(now, total)


# ------------------------------------------------------------------ growing trees
@lru_cache(1 << 16)
def _drawn_features(seed: int, tree: int, node: int, k: int) -> tuple[int, ...]:
    return tuple(np.sort(np.random.default_rng([seed, tree, node]).choice(len(FEATURES), k, replace=False)).tolist())


def _grow(data: DataFrame, fits: list[Fit], trees: Trees, which: list[tuple[int, int]], depth: int, leaf: int, k: int, seed: int,
          weight: Callable, target: Callable) -> None:
    """Grow the trees (model, tree) of `which` to `depth` levels."""
    open_ = {pair: [0] for pair in which}
    for level in range(depth):
        todo = [_Unit(m, t, nodes, np.array([_drawn_features(seed, t, node, k) for node in nodes], np.int64)) for (m, t), nodes in open_.items() if nodes]
        open_, at = {}, 0
        while at < len(todo):
            end, held = at, 0
            while end < len(todo) and (end == at or held + 16 * todo[end].size <= HISTOGRAM_BYTES):
                held += 16 * todo[end].size
                end += 1
            units, at = todo[at:end], end
            # Only what a pass needs goes into its tasks: the models of its units.
            models = {m: i for i, m in enumerate(dict.fromkeys(u.model for u in units))}
            some = Trees(trees.feature[list(models)], trees.cut[list(models)], trees.value[list(models)], trees.gain[:0])
            own, names = [_Unit(models[u.model], u.tree, u.nodes, u.features) for u in units], list(models)
            some_fits = [fits[m] for m in names]

            def goal(batch: _Batch, model: int, rows_: np.ndarray, names: list[int] = names) -> np.ndarray:
                return target(batch, names[model], rows_)

            small = held * data.rdd.getNumPartitions() <= DRIVER_BYTES
            parts = data.mapInArrow(lambda batches, own=own, some=some, some_fits=some_fits, goal=goal, level=level: _histograms(
                batches, some_fits, own, some, level, weight, goal), "unit int, sums binary")
            if small:
                sums = pa.RecordBatch.from_pylist(sorted(({"unit": r["unit"], "sums": bytes(r["sums"])} for r in parts.collect()), key=lambda r: r["unit"]),
                                                  pa.schema([("unit", pa.int32()), ("sums", pa.binary())]))
                found = [r for batch in _splits([sums], own, leaf) for r in batch.to_pylist()]
            else:
                split = parts.repartition("unit").sortWithinPartitions("unit")
                found = split.mapInArrow(lambda batches, own=own: _splits(batches, own, leaf), _SPLIT).collect()
            for r in found:
                unit = units[r["unit"]]
                m, t, node = unit.model, unit.tree, unit.nodes[r["slot"]]
                if not r["n"]:
                    continue
                trees.value[m, t, node] = r["s"] / r["n"]
                if r["feature"] < 0:
                    continue
                trees.feature[m, t, node], trees.cut[m, t, node] = r["feature"], r["cut"]
                trees.gain[m, t, r["feature"]] += r["gain"]
                for child, n, s in ((2 * node + 1, r["n_left"], r["s_left"]), (2 * node + 2, r["n"] - r["n_left"], r["s"] - r["s_left"])):
                    trees.value[m, t, child] = s / n
                    if n >= 2 * leaf:
                        open_.setdefault((m, t), []).append(child)


def _means(data: DataFrame, fits: list[Fit]) -> tuple[np.ndarray, np.ndarray]:
    """Training rows and mean label of every model."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, len(fits)))
        for batch in map(_Batch, batches):
            for m, fit in enumerate(fits):
                own = batch.of(fit)
                total[:, m] += len(own), batch.ys[own, fit.label].sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(fits)), pa.int32()), *map(pa.array, total)], names=["model", "n", "s"])

    found = data.mapInArrow(run, "model int, n double, s double").groupBy("model").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()
    n, mean = np.zeros(len(fits)), np.zeros(len(fits))
    for r in found:
        n[r["model"]], mean[r["model"]] = r["n"], r["s"] / r["n"] if r["n"] else 0.0
    return n, mean


def train(data: DataFrame, fits: list[Fit], params: JobParams) -> Ensembles:
    """All models of `fits` over `data` (rows(), stored). Models without rows have trees of a single node.

    The rows are kept in memory, as far as it goes, while passes read them; what is lost is read again from where they're stored.
    """
    parts = max(1, -(-data.count() // TASK_ROWS))
    data = (data.coalesce(parts) if parts < data.rdd.getNumPartitions() else data).persist()
    forest = Trees.none(len(fits), params.rf_trees, params.rf_depth)
    boosted = Trees.none(len(fits), params.gb_rounds, params.gb_depth)
    n, centre = _means(data, fits)
    used = [m for m in range(len(fits)) if n[m]]
    k = max(1, int(np.sqrt(len(FEATURES))))
    label = [f.label for f in fits]
    _grow(data, fits, forest, [(m, t) for m in used for t in range(params.rf_trees)], params.rf_depth, params.rf_leaf, k, params.seed,
          lambda batch, tree: np.searchsorted(_DRAWN, batch.uniform(2 * tree), "right").astype(np.float64),
          lambda batch, model, own: batch.ys[own, label[model]])
    stored = 0
    for t in range(params.gb_rounds):
        if t and t % STATE_EVERY == 0:
            before, data, stored = data, sizing.cut(_with_sums(data, boosted, stored, t)).persist(), t
            before.unpersist()
        done = Trees(boosted.feature[:, stored:t], boosted.cut[:, stored:t], boosted.value[:, stored:t], boosted.gain[:0])

        def left(batch: _Batch, model: int, own: np.ndarray, done: Trees = done) -> np.ndarray:
            before = batch.sums[own, model] if batch.sums is not None else 0.0
            return batch.ys[own, label[model]] - centre[model] - before - _boosted(batch.flat, batch.base[own], done, model, 0, done.feature.shape[1])

        now = Trees(boosted.feature[:, t:t + 1], boosted.cut[:, t:t + 1], boosted.value[:, t:t + 1], boosted.gain[:, t:t + 1])
        _grow(data, fits, now, [(m, 0) for m in used], params.gb_depth, params.gb_leaf, len(FEATURES), params.seed,
              lambda batch, tree, t=t: (batch.uniform(2 * t + 1) < params.gb_subsample).astype(np.float64), left)
        boosted.value[:, t] *= params.gb_rate
    data.unpersist()
    return Ensembles(fits, forest, boosted, centre, n, params.gb_rate)


def importances(made: Ensembles, model: int) -> np.ndarray:
    """By feature, the share of a tree's gain that its splits have, on average over the forest's trees."""
    gain = made.forest.gain[model]
    shares = gain / np.maximum(gain.sum(axis=1, keepdims=True), 1e-300)
    return shares.sum(axis=0) / max(shares.sum(), 1e-300)


def _with_sums(data: DataFrame, boosted: Trees, first: int, rounds: int) -> DataFrame:
    """The rows with `sums`: of each model, the boosted trees so far."""
    models = boosted.feature.shape[0]
    trees = Trees(boosted.feature[:, first:rounds], boosted.cut[:, first:rounds], boosted.value[:, first:rounds], boosted.gain[:0])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for raw in batches:
            batch = _Batch(raw)
            sums = np.stack([_boosted(batch.flat, batch.base, trees, m, 0, rounds - first) for m in range(models)], axis=1)
            sums = sums if batch.sums is None else sums + batch.sums
            kept = [raw.column(raw.schema.names.index(c.split()[0])) for c in ROW.split(", ")]
            yield pa.RecordBatch.from_arrays([*kept, pa.ListArray.from_arrays(pa.array(np.arange(batch.n + 1, dtype=np.int32) * models), pa.array(sums.ravel()))],
                                             names=[*(c.split()[0] for c in ROW.split(", ")), "sums"])

    return data.mapInArrow(run, f"{ROW}, sums array<double>")


def score(wanted: DataFrame, made: Ensembles) -> DataFrame:
    """`wanted` (number: of the model; bins; any other columns) with rf, gb and votes, the forest's predictions by tree."""
    others = [c for c in wanted.columns if c != "bins"]
    depth = int(np.log2(made.forest.feature.shape[2] + 1)) - 1

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            number = batch.column(batch.schema.names.index("number")).to_numpy()
            bins = batch.column(batch.schema.names.index("bins")).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            flat, base = bins.ravel(), np.arange(batch.num_rows) * bins.shape[1]
            votes, gb = np.zeros((batch.num_rows, made.forest.feature.shape[1])), np.zeros(batch.num_rows)
            for m in np.unique(number):
                at = np.flatnonzero(number == m)
                for t in range(votes.shape[1]):
                    votes[at, t] = made.forest.value[m, t][_nodes(flat, base[at], made.forest.feature[m, t], made.forest.cut[m, t], depth)]
                gb[at] = made.centre[m] + _boosted(flat, base[at], made.boosted, m, 0, made.boosted.feature.shape[1])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(votes) + 1, dtype=np.int32) * votes.shape[1]), pa.array(votes.ravel()))
            kept = [batch.column(batch.schema.names.index(c)) for c in others]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(votes.mean(axis=1)), pa.array(gb), lists], names=[*others, "rf", "gb", "votes"])

    kinds = ", ".join(f"`{c}` {wanted.schema[c].dataType.simpleString()}" for c in others)
    return wanted.mapInArrow(run, f"{kinds}, rf double, gb double, votes array<double>")
