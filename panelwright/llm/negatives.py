"""Hard negatives by threshold joins with an inverted index, pruned by norms (after L2AP).

Every anchor first looks for its nearest rows of the same label, its positives; then, for each positive, for the highest
rows of other labels within a window of scores below it. Both are joins of anchors with rows at a threshold for each
anchor. A task holds a block of rows and reads the anchors, which are stored in the shared folder, a portion at a time:

- The dimensions are ordered by falling mean square and dealt in chunks. A chunk's posting list names the rows whose
  remaining norm, from that chunk on, times the portion's largest anchor norm still reaches the portion's least threshold.
  All later dimensions are covered by that bound and omitted, and a row that the bound covers whole isn't indexed at all.
- Partial scores are added up list by list. After each, rows are dropped whose partial score and product of remaining
  norms stay below every threshold; the omitted dimensions are only added for the rows left.
- Thresholds begin high and are lowered, for those anchors alone whose windows aren't full yet, until they fill or every
  row was let in: for positives from a level that, by the corpus's means and deviations for each dimension, some 16 rows of the
  label should reach, for negatives from 9/10 of the positive's score.

So a stated set of anchors meets all rows in blocks; nothing is sampled or capped. A task gives out at most `count` rows
for each anchor, window and block of rows, so that any number of copies of one vector costs no more; windows are closed by
a top-k, which Spark takes before the shuffle. Rows aren't shuffled at all. Each pass reads the rows once and, for every
block of BLOCK_BYTES, the anchors once.

Defined cases: rows without id, label or vector, and with components that are null or not finite, take no part; shorter vectors
count as filled up with zeros; rows that repeat an id count each as partners of others, never as partners of that id;
as an anchor, an id counts once, with its least label and vector; ties go to the smaller id; an empty table gives an
empty result. Scores are exact up to 2^53. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.llm.common import cut, shared_folder, stored

#: Bytes of rows that a task holds at a time, rows and anchors joined at a time, and dimensions of a chunk.
BLOCK_BYTES = 32 << 20
ROWS, ANCHORS, CHUNK = 4096, 256, 16
#: Rows of a label that the first threshold lets in, as estimated; deviations by which it's lowered before all are let in.
EXPECTED, LOWERED = 16, (0.0, 1.0)
#: Shares of a positive's score, in hundredths, from which negatives are taken; the last one is the window's own end.
FIRST_SHARE = 90
_FOUND = "anchor_id long, slot int, vec_id long, score long"


def whole_numbers(table: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, label and v, the floors of `scale` times the components, of the rows that take part."""
    x = F.col("embedding").cast("array<double>")
    fit = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return table.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & fit).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
        F.transform(x, lambda c: F.floor(c * scale)).alias("v"))


# ------------------------------------------------------------------ a block of rows against a portion of anchors
def matrix(column: pa.Array, width: int, order: np.ndarray) -> np.ndarray:
    """Vectors as rows of doubles, filled up with zeros, with their dimensions in `order`."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(sizes), width))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out[:, order]


def remaining(x: np.ndarray) -> np.ndarray:
    """Norms of each row from each chunk's start on, and zero at the end; a trifle too high rather than too low."""
    starts = range(0, x.shape[1], CHUNK)
    squares = np.stack([np.einsum("ij,ij->i", x[:, a:a + CHUNK], x[:, a:a + CHUNK]) for a in starts], axis=1) if x.shape[1] else np.zeros((len(x), 0))
    left = np.sqrt(np.cumsum(squares[:, ::-1], axis=1)[:, ::-1]) * (1 + 1e-12)
    return np.concatenate([left, np.zeros((len(x), 1))], axis=1)


def survivors(q: np.ndarray, q_left: np.ndarray, floors: np.ndarray, x: np.ndarray, x_left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the rows of x that may reach some anchor's floor, and all anchors' whole scores with them."""
    chunks = x_left.shape[1] - 1
    covered = x_left[:, :-1] * q_left[:, 0].max(initial=0.0) < floors.min(initial=np.inf)
    indexed = (~covered).sum(axis=1)
    # Postings of chunk c: the rows with more than c indexed chunks, which stand first.
    rows = np.argsort(-indexed, kind="stable")
    if not np.isneginf(floors.min(initial=np.inf)):
        rows = rows[:int((indexed > 0).sum())]
    scores = np.zeros((len(q), len(rows)))
    for c in range(chunks):
        n = int((indexed[rows] > c).sum())
        if not n:
            break
        at = slice(c * CHUNK, (c + 1) * CHUNK)
        scores[:, :n] += q[:, at] @ x[rows[:n], at].T
        reach = scores[:, :n] + q_left[:, c + 1, None] * x_left[rows[:n], c + 1]
        stay = np.concatenate([(reach >= floors[:, None]).any(axis=0), np.ones(len(rows) - n, bool)])
        if not stay.all():
            rows, scores = rows[stay], scores[:, stay]
    for c in range(chunks):  # what the index omits
        n = int((indexed[rows] > c).sum())
        if n < len(rows):
            at = slice(c * CHUNK, (c + 1) * CHUNK)
            scores[:, n:] += q[:, at] @ x[rows[n:], at].T
    return rows, scores


def first(anchor: np.ndarray, slot: np.ndarray, ids: np.ndarray, scores: np.ndarray, count: int) -> np.ndarray:
    """Places of the `count` highest of each anchor and slot, ties by smaller id."""
    order = np.lexsort((ids, -scores, slot, anchor))
    a, s = anchor[order], slot[order]
    new = np.concatenate(([True], (a[1:] != a[:-1]) | (s[1:] != s[:-1]))) if len(a) else np.zeros(0, bool)
    starts = np.flatnonzero(new)
    rank = np.arange(len(a)) - np.repeat(starts, np.diff(np.append(starts, len(a))))
    return order[rank < count]


class _Rows:
    """A block of rows by label, in pieces of ROWS."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray) -> None:
        order = np.argsort(labels, kind="stable")
        self.ids, self.labels, self.x = ids[order], labels[order], x[order]
        self.left = remaining(self.x)

    def pieces(self, label: int | None) -> Iterator[slice]:
        a, b = (0, len(self.ids)) if label is None else np.searchsorted(self.labels, [label, label + 1])
        for at in range(int(a), int(b), ROWS):
            yield slice(at, min(at + ROWS, int(b)))


def _matches(block: _Rows, anchors: dict, same: bool, count: int) -> np.ndarray:
    """anchor, slot, vec_id and score of the block's `count` first rows in each window of each anchor."""
    kept = np.zeros((4, 0))
    labels = np.unique(anchors["label"]) if same else [None]
    for label in labels:
        own = np.flatnonzero(anchors["label"] == label) if same else np.arange(len(anchors["label"]))
        q, left, low, high, ids = (anchors[k][own] for k in ("q", "left", "low", "high", "id"))
        held = []
        for piece in block.pieces(label):
            rows, scores = survivors(q, left, low.min(axis=1, initial=np.inf), block.x[piece], block.left[piece])
            partner = block.ids[piece][rows]
            fit = partner != ids[:, None]
            if not same:
                fit &= block.labels[piece][rows] != anchors["label"][own][:, None]
            for slot in range(low.shape[1]):
                a, r = np.nonzero(fit & (scores >= low[:, slot, None]) & (scores <= high[:, slot, None]))
                found = np.stack([ids[a], np.full(len(a), slot), partner[r], scores[a, r].astype(np.int64)])
                held.append(found[:, first(*found, count)])
        if held:
            found = np.concatenate(held, axis=1)
            kept = np.concatenate([kept, found[:, first(*found, count)]], axis=1) if kept.size else found[:, first(*found, count)]
    return kept


def _portions(folder: str, width: int, order: np.ndarray) -> Iterator[dict]:
    """The stored anchors, ANCHORS at a time."""
    system, path = stored(folder)
    for info in sorted(system.get_file_info(fs.FileSelector(path)), key=lambda i: i.path):
        if not info.path.endswith(".parquet"):
            continue
        with system.open_input_file(info.path) as file:
            for batch in pq.ParquetFile(file).iter_batches(ANCHORS):
                ids, labels, low, high = (batch.column(batch.schema.names.index(n)) for n in ("anchor_id", "label", "low", "high"))
                q = matrix(batch.column(batch.schema.names.index("v")), width, order)
                windows = [np.array(c.to_pylist(), np.float64).reshape(len(ids), -1) for c in (low, high)]
                yield dict(id=ids.to_numpy(), label=labels.to_numpy(), q=q, left=remaining(q), low=windows[0], high=windows[1])


def search(rows: DataFrame, folder: str, width: int, order: np.ndarray, same: bool, count: int) -> DataFrame:
    """anchor_id, slot, vec_id and score: for each window of each anchor stored in `folder`, its `count` first rows with the
    anchor's label (same) or another one, by falling score and rising id."""
    held = max(1, BLOCK_BYTES // (8 * max(1, width)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def joined(parts: list) -> Iterator[pa.RecordBatch]:
            block = _Rows(*(np.concatenate(p) for p in zip(*parts)))
            for anchors in _portions(folder, width, order):
                found = _matches(block, anchors, same, count).astype(np.int64)
                if found.shape[1]:
                    yield pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1].astype(np.int32)), pa.array(found[2]),
                                                      pa.array(found[3])], names=["anchor_id", "slot", "vec_id", "score"])

        parts, n = [], 0
        for batch in batches:
            if batch.num_rows:
                parts.append((batch.column(0).to_numpy(), batch.column(1).to_numpy(), matrix(batch.column(2), width, order)))
                n += batch.num_rows
                if n >= held:
                    yield from joined(parts)
                    parts, n = [], 0
        if parts:
            yield from joined(parts)

    best = rows.select("vec_id", "label", "v").mapInArrow(run, _FOUND)
    top = Window.partitionBy("anchor_id", "slot").orderBy(F.col("score").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= count)


# ------------------------------------------------------------------ rounds of falling thresholds
def moments(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Mean and mean square of each dimension over all rows, and the number of rows."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, squares = 0, np.zeros(0), np.zeros(0)
        for batch in batches:
            column = batch.column(0)
            width = max(len(sums), int(np.diff(column.offsets.to_numpy()).max(initial=0)))
            x = matrix(column, width, np.arange(width))
            sums, squares = (np.pad(s, (0, width - len(s))) + t for s, t in ((sums, x.sum(axis=0)), (squares, (x * x).sum(axis=0))))
            n += len(x)
        yield pa.RecordBatch.from_pylist([dict(dim=-1, n=n, total=0.0, square=0.0)] + [
            dict(dim=k, n=n, total=float(a), square=float(b)) for k, (a, b) in enumerate(zip(sums, squares))],
            pa.schema([("dim", pa.int32()), ("n", pa.int64()), ("total", pa.float64()), ("square", pa.float64())]))

    found = rows.select("v").mapInArrow(run, "dim int, n long, total double, square double").groupBy("dim").agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("square").alias("square")).orderBy("dim").collect()
    n = next((r["n"] for r in found if r["dim"] < 0), 0)
    dims = [r for r in found if r["dim"] >= 0]
    return np.array([r["total"] for r in dims]) / max(n, 1), np.array([r["square"] for r in dims]) / max(n, 1), n


def _summed(values: Column, weights: np.ndarray, square: bool = False) -> Column:
    """Sum of the components (or their squares) times `weights`."""
    given = F.array(*(F.lit(float(w)) for w in weights)) if len(weights) else F.array().cast("array<double>")
    products = F.zip_with(values, given, lambda v, w: F.coalesce(v * v if square else v, F.lit(0)).cast("double") * w)
    return F.aggregate(products, F.lit(0.0), lambda a, p: a + F.coalesce(p, F.lit(0.0)))


def _stored(anchors: DataFrame) -> str:
    """Folder of the anchors (anchor_id, label, v, low, high) in order of their labels."""
    folder = shared_folder(anchors.sparkSession)
    anchors.repartitionByRange("label", "anchor_id").sortWithinPartitions("label", "anchor_id").write.parquet(folder)
    return folder


def positives(rows: DataFrame, anchors: DataFrame, stats: tuple, count: int) -> DataFrame:
    """anchor_id, rank (from 1), vec_id and score of each anchor's first `count` rows of its label."""
    mean, square, _ = stats
    order = np.argsort(-square, kind="stable")
    sizes = rows.groupBy(F.col("label").alias("own")).agg(F.count("*").alias("size"))
    ratio = F.log(F.greatest(F.col("size") / EXPECTED, F.lit(1.0))) * 2
    reach = F.sqrt(F.greatest(F.lit(0.0), ratio - F.log(F.greatest(ratio, F.lit(1.0))) - float(np.log(2 * np.pi))))
    left = cut(anchors.join(sizes, F.col("label") == F.col("own")).select(
        F.col("vec_id").alias("anchor_id"), "label", "v", "size", reach.alias("reach"), _summed(F.col("v"), mean).alias("middle"),
        F.sqrt(_summed(F.col("v"), np.maximum(square - mean * mean, 0), True)).alias("deviation")))
    out = None
    for lowered in (*LOWERED, None):
        low = F.lit(float("-inf")) if lowered is None else F.when(F.col("size") > 4 * EXPECTED, F.col("middle") + (
            F.col("reach") - lowered) * F.col("deviation")).otherwise(float("-inf"))
        folder = _stored(left.select("anchor_id", "label", "v", F.array(low).alias("low"), F.array(F.lit(float("inf"))).alias("high")))
        found = cut(search(rows, folder, len(mean), order, True, count))
        full = found.groupBy("anchor_id").agg(F.count("*").alias("n")).where(F.col("n") >= count)
        done = found if lowered is None else found.join(full, "anchor_id", "left_semi")
        out = done if out is None else out.unionByName(done)
        if lowered is not None:
            left = cut(left.join(full, "anchor_id", "left_anti"))
            if left.isEmpty():
                break
    return out.select("anchor_id", "rank", "vec_id", "score")


def negatives(rows: DataFrame, anchors: DataFrame, found: DataFrame, stats: tuple, count: int, share: int) -> DataFrame:
    """anchor_id, slot (the positive's rank less 1), rank, vec_id and score of the first `count` rows of other labels whose score
    is within `share` hundredths and all of the positive's score."""
    mean, square, _ = stats
    order = np.argsort(-square, kind="stable")
    score = F.col("score").cast("decimal(20,0)")
    out, left = None, found.where("score >= 0").select("anchor_id", (F.col("rank") - 1).alias("slot"), "score")
    most = found.agg(F.max("rank")).first()[0] or 0
    for hundredths in (FIRST_SHARE, share):
        window = F.struct("slot", F.ceil(score * hundredths / 100).cast("double").alias("low"), F.col("score").cast("double").alias("high"))
        open_ = left.groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.struct("slot", window))).alias("windows"))

        def side(name: str, closed: float) -> Column:
            return F.array(*(F.coalesce(F.col("windows")[F.lit(k)][name], F.lit(closed)) for k in range(most))).alias(name)

        own = anchors.join(open_, F.col("vec_id") == F.col("anchor_id")).select(
            "anchor_id", "label", "v", side("low", float("inf")), side("high", float("-inf")))
        got = cut(search(rows, _stored(own), len(mean), order, False, count))
        full = got.groupBy("anchor_id", "slot").agg(F.count("*").alias("n")).where(F.col("n") >= count)
        done = got if hundredths == share else got.join(full, ["anchor_id", "slot"], "left_semi")
        out = done if out is None else out.unionByName(done)
        if hundredths != share:
            left = cut(left.join(full, ["anchor_id", "slot"], "left_anti"))
            if left.isEmpty():
                break
    return out.select("anchor_id", "slot", "rank", "vec_id", "score")


def mine(rows: DataFrame, anchors: DataFrame, n_positives: int = 5, n_negatives: int = 5, share: int = 80) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score. `rows` and `anchors`, some of the rows, have
    vec_id, label and v (whole_numbers())."""
    stats = moments(rows)
    anchors = cut(anchors.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("own")).select("vec_id", "own.label", "own.v"))
    near = cut(positives(rows, anchors, stats, n_positives))
    hard = negatives(rows, anchors, near, stats, n_negatives, share)
    held = near.select("anchor_id", (F.col("rank") - 1).alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return hard.join(held, ["anchor_id", "slot"]).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
