"""SimHash near-duplicates by multi-index hashing.

A fingerprint is 64 majority votes of the XXH64 hashes of a text's word shingles. Two fingerprints link at `radius`
or fewer differing bits. Their bits are cut into segments with a small radius each, chosen so that linked fingerprints
lie within a segment's radius in one segment at least; a table holds each fingerprint under its value in each segment,
and the values in the small ball around a fingerprint's own are looked up there. Whole distances are verified inside
that join, so that it gives out links only. A fingerprint has at most 64 choose (1..radius) others within reach, so
links grow with the number of fingerprints, not with the square of a group's size.

Work is on distinct fingerprints: copies meet once, in a map-side combined aggregate. Nothing but a row for each
fingerprint and link is shuffled; texts stay where they are read.

Defined cases: null and blank texts have fingerprint zero, linked like any other; texts of fewer words than a shingle
are one shingle; repeated rows keep a row each; null ids are allowed, and a component of null ids only has a null id;
an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import cut, parts, utf8_of

BITS = 64
SEED = 42
#: Shingles hashed at a time, so that a very long text needs no more memory for its hashes.
BLOCK = 1 << 16
#: Edges of a partition while components are looked for, about.
EDGES = 100_000


def shingles(text: bytes, words: int = 3) -> Iterator[np.ndarray]:
    """XXH64 hashes of the shingles of UTF-8 bytes, BLOCK at a time; A-Z are lower-cased and words end at ASCII white
    space. A text without words has one empty shingle."""
    found = text.lower().split() or [b""]
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(found) - words + 1)
    first, last = starts[:n].tolist(), ends[min(words, len(found)) - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, BLOCK):
        yield np.fromiter((digest(joined[a:b], SEED) for a, b in zip(first[at:at + BLOCK], last[at:at + BLOCK])),
                          np.uint64, min(BLOCK, n - at))


def fingerprint(text: bytes, words: int = 3) -> int:
    """Unsigned, of the votes of all shingles."""
    if not text.strip():
        return 0
    votes, n = np.zeros(BITS, np.int64), 0
    for hashes in shingles(text, words):
        votes += np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int.from_bytes(np.packbits(2 * votes > n).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 3, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The `keep` columns and fp, the fingerprint as a signed long."""
    source = docs.select(*keep, utf8_of().alias("utf8"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            at = batch.schema.names.index("utf8")
            found = np.array([fingerprint(t, words) for t in batch.column(at).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(found)],
                                             names=[*batch.schema.names[:at], "fp"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return source.mapInArrow(run, f"{kinds}, fp long")


def hex_of(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), BITS // 4, "0")


def balls(radius: int, segments: int) -> list[tuple[int, int, int]]:
    """(first bit, bits, radius) of each segment. Were every segment beyond its radius, the bits that differ would be
    radius + 1 at least. A radius of -1 leaves a segment out."""
    edges = [BITS * i // segments for i in range(segments + 1)]
    share, more = divmod(radius + 1, segments)
    return [(a, b - a, share - 1 + (i < more)) for i, (a, b) in enumerate(zip(edges, edges[1:]))]


def _key(segment: int, value: Column) -> Column:
    return F.struct(F.lit(segment).alias("segment"), value.alias("value"))


def _ball(segment: int, value: Column, masks: list[int]) -> Column:
    around = F.transform(F.array(*map(F.lit, masks)).cast("array<bigint>"), lambda mask: value.bitwiseXOR(mask))
    return F.transform(F.filter(around, lambda x: x >= value), lambda x: _key(segment, x))


def links(distinct: DataFrame, radius: int = 2, segments: int = 2) -> DataFrame:
    """`segments`: 2 or more. Pairs a, b of different fingerprints of `distinct` (column fp) with `radius` or fewer differing bits, each pair
    once or more. Any number of segments gives the same pairs; more make smaller balls and larger buckets.

    Only values above a fingerprint's own are looked up: of a pair, the one with the lower value finds the other.
    """
    tables, probes = [], []
    for i, (first, bits, reach) in enumerate(balls(radius, segments)):
        if reach < 0:
            continue
        value = F.call_function("shiftrightunsigned", F.col("fp"), F.lit(first)).bitwiseAND(F.lit((1 << bits) - 1))
        masks = [sum(1 << k for k in c) for n in range(reach + 1) for c in combinations(range(bits), n)]
        tables.append(_key(i, value))
        probes.append(_ball(i, value, masks))
    table = distinct.select(F.col("fp").alias("b"), F.explode(F.array(*tables)).alias("at")).select("at.*", "b")
    probe = distinct.select(F.col("fp").alias("a"), F.explode(F.concat(*probes)).alias("at")).select(
        F.col("at.segment").alias("p_segment"), F.col("at.value").alias("p_value"), "a")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    # Neighbours with equal values in a segment find each other twice there, those with different ones once.
    return probe.join(table, (F.col("p_segment") == F.col("segment")) & (F.col("p_value") == F.col("value"))
                      & (F.col("a") != F.col("b")) & near).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """node, root of every node of `edges` (a, b): root is the least node that can be reached.

    Stars by turns: every node hands its larger neighbours to the least of its neighbours, then its smaller ones, until
    nothing changes. A round is an aggregate and a join for each; rounds grow with the logarithm of the longest path. Edges
    are held in as many partitions as their number asks for, since every task leaves files, however little it holds.
    """
    def least(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("u").agg(F.min("v").alias("m"))

    now = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    held, seen = now.count() // EDGES + 1, None
    now = now.coalesce(held)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(least(both).withColumn("m", F.least("u", "m")), "u").where("v > u").select(
            F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct().coalesce(held)
        down = least(large)
        small = large.join(down, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            down.select("u", F.col("m").alias("v"))).distinct().coalesce(held)
        now = cut(small)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    root = now.groupBy("u").agg(F.min("v").alias("root"))
    return root.select(F.col("u").alias("node"), "root").unionByName(
        root.select(F.col("root").alias("node"), "root").distinct())


def groups(prints: DataFrame, radius: int = 2, segments: int = 2, id_column: str = "doc_id") -> DataFrame:
    """The rows of `prints` (fingerprints(), kept by cut()) with component_id, the least id of their component."""
    distinct = cut(prints.groupBy("fp").agg(F.min(id_column).alias("least")))
    roots = components(links(distinct, radius, segments))
    rooted = cut(distinct.join(roots, distinct.fp == roots.node, "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")))
    # Kept, so that a component of many fingerprints meets it over a plain exchange, whose large partitions Spark splits.
    first = cut(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    named = rooted.join(first, "root").select(F.col("fp").alias("named"), "component_id")
    return prints.join(named, F.col("fp") == F.col("named"), "left").drop("named")
