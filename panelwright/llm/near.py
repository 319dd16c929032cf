"""Near copies by the Jaccard similarity of their word shingles.

Candidates come from two sides: SimHash fingerprints that link, and sketches. A sketch is the least values of BANDS x ROWS
hash functions over a text's shingles; texts that agree in a whole band share a bucket, which at a similarity of 0.8
happens with a probability of 1 - (1 - 0.8^5)^20 = 0.9996, at 0.5 of 0.47, and at 0.2 of 0.006. MORE functions besides
sharpen what a sketch says about a pair. Whether a candidate pair is similar is then counted on the whole shingle
sets, so that a pair which isn't is never linked. SimHash's two bits reach few pairs of 0.8; most links come from the sketches.

Every bucket has two representatives, drawn by a hash of bucket and member, so that a text meets other ones in each of
its buckets. It is compared with the one whose sketch is nearest first, then with those others that lie in
another component. What these links leave outside of a bucket's largest component is last compared with all its members,
in pieces of PIECE by PIECE members, of which a task holds one at a time. A piece gives out which components are bound by
pairs whose sketches and sizes allow a similarity of 0.8, each binding but those that follow from others: fewer rows than it
has members. What is bound together is dealt into such pieces once more, now with the whole sets, and a piece gives out
the similar pairs that join components. So a group of many copies costs its size, one with stragglers its size
times their number, and no pairs of a group are written out. Of a group, links to representatives and the membership are kept.

Texts are told apart by their SHA-256; distinct ones get a number, by which they are joined.

Defined cases: null, empty and blank texts are equal; texts of fewer words than a shingle are one shingle; an empty
table gives an empty result. Case of A-Z and white space don't count for similarity. Very long texts are read whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm import simhash
from panelwright.llm.common import cut, parts, portions, utf8_of

BANDS, ROWS, MORE = 20, 5, 92
FUNCTIONS = BANDS * ROWS + MORE
#: Functions that agree for a pair to be counted: at 0.8, 154 of 192 do, with a deviation of 5.5.
AGREE = 134
#: Members of a bucket on each side of a comparison in one task, about.
PIECE = 256
_RNG = np.random.default_rng(8)
_XOR = _RNG.integers(0, 1 << 64, (FUNCTIONS, 1), np.uint64)
_ODD = _RNG.integers(0, 1 << 64, (FUNCTIONS, 1), np.uint64) | np.uint64(1)


def described(text: bytes, words: int) -> tuple[int, np.ndarray, int]:
    """Fingerprint, least value of each function, and number of different shingles."""
    least, votes, n, sets = np.full(FUNCTIONS, np.iinfo(np.uint64).max, np.uint64), np.zeros(simhash.BITS, np.int64), 0, []
    for block in simhash.shingles(text, words):
        own = np.unique(block)
        sets.append(own)
        for at in range(0, len(own), 512):
            least = np.minimum(least, ((own[at:at + 512][None, :] ^ _XOR) * _ODD).min(axis=1))
        for at in range(0, len(block), 8192):
            bits = np.unpackbits(block[at:at + 8192].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            votes += bits.sum(axis=0, dtype=np.int64)
        n += len(block)
    fp = int.from_bytes(np.packbits(2 * votes > n).tobytes(), "big") if text.strip() else 0
    return fp, least, len(sets[0]) if len(sets) == 1 else len(np.unique(np.concatenate(sets)))


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, digest of the text, fp, size (different shingles), keys (of the bands) and low (a byte of each function's value)."""
    source = docs.select("doc_id", utf8_of().alias("utf8"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for p in parts(batches) for b in portions([p], 1)):
            texts = batch.column(1).to_pylist()
            found = [described(t, words) for t in texts]
            keys = [np.array([xxhash.xxh64_intdigest(least[i:i + ROWS].tobytes(), i) for i in range(0, BANDS * ROWS, ROWS)],
                             np.uint64).view(np.int64) for _, least, _ in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()),
                 pa.array(np.array([fp for fp, _, _ in found], np.uint64).view(np.int64)), pa.array([n for _, _, n in found], pa.int64()),
                 pa.array(keys, pa.list_(pa.int64())), pa.array([least.astype(np.uint8).tobytes() for _, least, _ in found], pa.binary())],
                names=["doc_id", "digest", "fp", "size", "keys", "low"])

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, digest binary, fp long, size long, keys array<long>, low binary")


def _lows(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, FUNCTIONS)


def _likely(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            agree = (_lows(batch.column(2)) == _lows(batch.column(3))).sum(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(agree)], names=["a", "b", "agree"]).filter(pa.array(agree >= AGREE))


def _close(out: pa.Table, every: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Places in `out` and `every` (id, root, size, apart, low) of the pairs of different components whose sketches and sizes
    allow a similarity of 0.8, nearest first. Two members that are both apart meet in one of their two pieces."""
    (ida, ra, na), (idb, rb, nb) = ([t.column(k).to_numpy() for k in ("id", "root", "size")] for t in (out, every))
    a, b = _lows(out.column("low")), _lows(every.column("low"))
    once = (ida[:, None] < idb[None, :]) | ~every.column("apart").to_numpy()[None, :]
    i, j = np.nonzero((ra[:, None] != rb[None, :]) & once & (5 * na[:, None] >= 4 * nb[None, :]) & (5 * nb[None, :] >= 4 * na[:, None]))
    agree = np.array([n for at in range(0, len(i), 1 << 14) for n in (a[i[at:at + (1 << 14)]] == b[j[at:at + (1 << 14)]]).sum(axis=1)], np.int64)
    order = np.argsort(-agree, kind="stable")
    order = order[agree[order] >= AGREE]
    return i[order], j[order]


def _top(tops: dict[int, int], x: int) -> int:
    while (up := tops.setdefault(x, x)) != x:
        tops[x] = x = tops.setdefault(up, up)
    return x


def _crossed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of components that likely pairs of one piece bind, but for those that earlier ones have bound: rows of out, every."""
    for batch in batches:
        for row in range(batch.num_rows):
            out, every = (pa.Table.from_struct_array(batch.column(k)[row].values) for k in (0, 1))
            if not (out.num_rows and every.num_rows):
                continue
            (i, j), tops, bound = _close(out, every), {}, []
            for a, b in zip(out.column("root").to_numpy()[i].tolist(), every.column("root").to_numpy()[j].tolist()):
                if (x := _top(tops, a)) != (y := _top(tops, b)):
                    tops[x] = y
                    bound.append((a, b))
            if bound:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*bound)], names=["a", "b"])


def _verified(rows: pa.Table) -> pa.Table:
    """Similar pairs of one piece, counted on the whole sets, but for those whose texts earlier ones have joined."""
    out, every = (rows.filter(x) for x in (rows.column("out"), pc.invert(rows.column("out"))))
    links = []
    if out.num_rows and every.num_rows:
        (i, j), tops = _close(out, every), {}
        sets = [[x.values.to_numpy() for x in t.column("shingles")] for t in (out, every)]
        (ida, ra), (idb, rb) = ([t.column(k).to_pylist() for k in ("id", "root")] for t in (out, every))
        for m, n in zip(i.tolist(), j.tolist()):
            x, y = _top(tops, ra[m]), _top(tops, rb[n])
            if x != y and _alike(sets[0][m], sets[1][n]):
                tops[x] = y
                links.append((min(ida[m], idb[n]), max(ida[m], idb[n])))
    return pa.table([pa.array(x, pa.int64()) for x in (zip(*links) if links else ((), ()))], names=["a", "b"])


def _alike(a: np.ndarray, b: np.ndarray) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 9 * shared >= 4 * (len(a) + len(b))


def _sets(batches: Iterable[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in parts([batch], 64):
            own = [np.unique(np.concatenate([*simhash.shingles(t, words)])).view(np.int64) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(own, pa.list_(pa.int64()))], names=["id", "shingles"])


def _beside(pairs: DataFrame, own: DataFrame, value: str) -> DataFrame:
    """The pairs a, b with the value of both in `own` (id, value)."""
    for side in "ab":
        pairs = pairs.join(own.select(F.col("id").alias(side), F.col(value).alias(f"{value}_{side}")), side)
    return pairs.select("a", "b", f"{value}_a", f"{value}_b")


def likely(pairs: DataFrame, distinct: DataFrame) -> DataFrame:
    """The pairs a, b whose sketches allow a similarity of 0.8 or more, and how many functions agree."""
    return _beside(pairs, distinct, "low").mapInArrow(_likely, "a long, b long, agree long")


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs a, b of different components."""
    for side in "ab":
        own = roots.select(F.col("node").alias(f"node_{side}"), F.col("root").alias(f"root_{side}"))
        pairs = pairs.join(own, F.col(side) == F.col(f"node_{side}"), "left")
    return pairs.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b", "agree")


def _nearest(pairs: DataFrame) -> DataFrame:
    """Of every text, its pair with the nearest sketch."""
    ends = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("end"), F.col("b").alias("other"), "agree"), F.struct(
        F.col("b").alias("end"), F.col("a").alias("other"), "agree"))).alias("p")).select("p.*")
    best = ends.groupBy("end").agg(F.max_by("other", F.struct("agree", "other")).alias("other"))
    return best.select(F.least("end", "other").alias("a"), F.greatest("end", "other").alias("b")).distinct()


def confirmed(pairs: DataFrame, distinct: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """The similar ones of `pairs` (a, b, agree), but for those whose texts other links have joined already.

    Of every text the nearest pair is counted first; what still lies in different components then is counted after it.
    """
    first = cut(_nearest(pairs))
    found = similar(first, distinct, docs, words)
    rest = cut(_apart(pairs.join(first, ["a", "b"], "left_anti"), cut(simhash.components(found))))
    return found if rest.isEmpty() else found.unionByName(similar(rest, distinct, docs, words))


def shingled(ids: DataFrame, distinct: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """id and the whole shingle set of the numbered texts in `ids` (id)."""
    named = ids.join(distinct.select("id", "digest"), "id")
    texts = docs.select(F.unhex(F.sha2(utf8_of(), 256)).alias("digest"), utf8_of().alias("utf8"))
    texts = texts.join(named, "digest").dropDuplicates(["id"]).select("id", "utf8")
    return cut(texts.mapInArrow(lambda batches: _sets(batches, words), "id long, shingles array<long>"))


def similar(pairs: DataFrame, distinct: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """The pairs a, b of numbered texts with a similarity of 0.8 or more. `pairs` is read twice: cut it before."""
    sets = shingled(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), distinct, docs, words)
    shared = F.size(F.array_intersect("shingles_a", "shingles_b"))
    # shared / (all - shared) >= 4 / 5
    return cut(_beside(pairs, sets, "shingles").where(9 * shared >= 4 * (F.size("shingles_a") + F.size("shingles_b"))).select("a", "b"))


def _pieces(members: DataFrame, roots: DataFrame, values: DataFrame) -> DataFrame:
    """For each key of `members` (key, id) with several components, those outside of its largest one (out) beside all members,
    in pieces (key, o, m), with the columns of `values` (id, ...)."""
    rooted = cut(members.select("key", "id").join(roots, F.col("id") == F.col("node"), "left").select(
        "key", "id", F.coalesce("root", "id").alias("root")))
    sizes = rooted.groupBy("key", "root").agg(F.count("*").alias("n"))
    apart = sizes.groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.sum("n").alias("all"), F.max("n").alias("most")).where("all > most")
    deal = apart.select("key", "main", F.ceil((F.col("all") - F.col("most")) / PIECE).cast("int").alias("outs"), F.ceil(F.col("all") / PIECE).cast("int").alias("alls"))
    rows = rooted.join(deal, "key").withColumn("apart", F.col("root") != F.col("main")).join(values, "id")
    own = ["id", "root", "apart", *(c for c in values.columns if c != "id")]

    def dealt(by: str, across: str) -> tuple:
        return F.pmod(F.xxhash64("id"), by).cast("int"), F.explode(F.sequence(F.lit(0), F.col(across) - 1))

    at, over = dealt("outs", "alls")
    out = rows.where("apart").select("key", at.alias("o"), over.alias("m"), F.lit(True).alias("out"), *own)
    at, over = dealt("alls", "outs")
    return out.unionByName(rows.select("key", at.alias("m"), over.alias("o"), F.lit(False).alias("out"), *own))


def across(members: DataFrame, found: DataFrame, distinct: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """Links between the components that `found` makes of the members of a bucket (key, id).

    Pieces of the buckets tell which components likely pairs bind; of what is bound together, pieces then count whole sets.
    """
    own, sketched = cut(simhash.components(found)), distinct.select("id", "size", "low")
    at = F.struct("id", "root", "size", "apart", "low")
    pieces = _pieces(members, own, sketched).groupBy("key", "o", "m").agg(
        F.collect_list(F.when(F.col("out"), at)).alias("out"), F.collect_list(F.when(~F.col("out"), at)).alias("every"))
    bound = cut(pieces.select("out", "every").mapInArrow(_crossed, "a long, b long").distinct())
    if bound.isEmpty():
        return bound
    wide = simhash.components(bound).select(F.col("node").alias("bound"), F.col("root").alias("key"))
    rooted = distinct.select("id").join(own, F.col("id") == F.col("node"), "left").select("id", F.coalesce("root", "id").alias("bound"))
    within = cut(rooted.join(wide, "bound").select("key", "id"))
    values = sketched.join(shingled(within.select("id"), distinct, docs, words), "id")
    return cut(_pieces(within, own, values).groupBy("key", "o", "m").applyInArrow(_verified, "a long, b long"))


def groups(docs: DataFrame, words: int = 5) -> DataFrame:
    """doc_id, digest and root of every row of `docs` (doc_id, text): rows with the same root are linked by pairs with a
    similarity of 0.8 or more."""
    rows = cut(sketches(docs, words))
    distinct = cut(rows.drop("doc_id").dropDuplicates(["digest"]).withColumn("id", F.monotonically_increasing_id()))
    held = distinct.select("id", F.explode(F.concat("keys", F.array(F.xxhash64("fp")))).alias("key"))
    drawn = F.xxhash64("id", "key")
    shared = cut(held.groupBy("key").agg(F.min_by("id", drawn).alias("least"), F.max_by("id", drawn).alias("most")).where("least != most"))
    members = cut(held.join(shared, "key"))
    alike = cut(distinct.groupBy("fp").agg(F.min("id").alias("id")))
    linked = simhash.links(alike.select("fp"))
    for side in "ab":
        linked = linked.join(alike.select(F.col("fp").alias(side), F.col("id").alias(f"{side}_id")), side)
    pairs = linked.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))
    for drawn in ("least", "most"):
        pairs = pairs.unionByName(members.where(F.col("id") != F.col(drawn)).select(F.col(drawn).alias("a"), F.col("id").alias("b")))
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    tried = cut(likely(pairs, distinct))
    found = confirmed(tried, distinct, docs, words)
    found = found.unionByName(across(members, found, distinct, docs, words))
    roots = cut(simhash.components(found))
    named = distinct.select("digest", "id").join(roots, F.col("id") == F.col("node"), "left").select("digest", F.coalesce("root", "id").alias("root"))
    return rows.select("doc_id", "digest").join(named, "digest")
