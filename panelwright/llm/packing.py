"""Best-two-fit packing of documents into sequences of a fixed number of tokens.

Tokens are counted where the texts are read. Only the number of pieces of each length, at most `capacity` rows, comes
to the driver, where bins are planned for lengths, all bins of one make at a time: filled greedily with the longest
length that fits, and then the shortest is replaced by two unpacked lengths while these fit the gap more tightly. The
plan has a few entries for each length. Pieces are numbered within their length and find their bin by that number, so
neither a common length nor a large corpus meets in one task.

Defined cases: null and empty texts are one piece, the end id alone; repeated rows are packed each; ids may be null;
an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwright.llm.common import cut, parts, text_of

CAPACITY = 1024
END_ID = 2
#: How byte-level vocabularies split a text before any merge (fixed).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_of() -> dict[str, int]:
    """Byte-level vocabularies write a byte as its own character where that prints, else as one from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in prints]
    return {chr(b): b for b in prints} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def byte_encoder(path: str):
    """A byte-level BPE file of the tokenizers library as a tiktoken encoding: ids in order of merges are its ranks. The
    ids are the same (tests compare them), special strings included, in about a third of the time."""
    import tiktoken

    file, byte = json.loads(Path(path).read_text(encoding="utf-8")), _byte_of()
    special = {t["content"]: t["id"] for t in file["added_tokens"]}
    ranks = {bytes(byte[c] for c in token): i for token, i in file["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding(Path(path).stem, pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special)


@lru_cache(maxsize=2)
def library_encoder(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def ids_of(text: str, path: str, end_id: int = END_ID) -> np.ndarray:
    """tiktoken gives up on a run of about a million white-space characters; the library then takes the text."""
    try:
        ids = byte_encoder(path).encode(text, allowed_special="all")
    except ValueError:
        ids = library_encoder(path).encode(text, add_special_tokens=False).ids
    ids.append(end_id)
    return np.asarray(ids, "<u4")


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_column: str = "doc_id") -> DataFrame:
    """doc_id, piece, start, length and ids (little-endian unsigned 32-bit) of each piece. Documents of more than
    `capacity` ids are cut so that all pieces but the first have that length."""
    source = docs.select(F.col(id_column).alias("doc_id"), text_of().alias("body"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            rows, piece, start, length, ids = [], [], [], [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                all_ids = ids_of(text, path, end_id)
                ends = range((len(all_ids) - 1) % capacity + 1, len(all_ids) + 1, capacity)
                for k, end in enumerate(ends):
                    begin = max(0, end - capacity)
                    rows.append(row), piece.append(k), start.append(begin)
                    length.append(end - begin), ids.append(all_ids[begin:end].tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(length, pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "piece", "start", "length", "ids"])

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids binary")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, Counter]]:
    """(bins, pieces by length in each of them); together all of `counts`."""
    left = {n: c for n, c in counts.items() if c}
    sizes = sorted(left)
    out = []
    while sizes:
        bin_, gap = _filled(sizes, left, capacity)
        while gap and sum(bin_.values()) > 1 and (two := _two(sizes, left, bin_, gap)):
            least = min(n for n, c in bin_.items() if c)
            bin_[least] -= 1
            bin_.update(two)
            gap -= sum(two) - least
        bin_ = +bin_
        bins = min(left[n] // c for n, c in bin_.items())
        out.append((bins, bin_))
        for n, c in bin_.items():
            left[n] -= bins * c
            if not left[n]:
                sizes.remove(n)
    return out


def _filled(sizes: list[int], left: dict[int, int], gap: int) -> tuple[Counter, int]:
    """A bin filled with the longest length that fits, again and again, and the gap that remains."""
    bin_, i = Counter(), len(sizes)
    while i := min(i, bisect_right(sizes, gap)):
        i -= 1
        bin_[sizes[i]] = take = min(left[sizes[i]], gap // sizes[i])
        gap -= take * sizes[i]
    return bin_, gap


def _two(sizes: list[int], left: dict[int, int], bin_: Counter, gap: int) -> tuple[int, int] | None:
    """Of the unpacked lengths, the two that fill the gap without the bin's shortest piece most, if more than it does."""
    least = min(n for n, c in bin_.items() if c)
    room, best, pair = gap + least, least, None
    free = [n for n in sizes if left[n] > bin_[n]]
    a, b = 0, len(free) - 1
    while a <= b:
        x, y = free[a], free[b]
        if x + y > room or (a == b and left[x] - bin_[x] < 2):
            b -= 1
            continue
        if x + y > best:
            best, pair = x + y, (x, y)
        a += 1
    return pair


def pack(df: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The rows of `df` (pieces kept by cut(), with a column length of 1 to `capacity`) with sequence_id and offset."""
    counts = {r["length"]: r["n"] for r in df.groupBy("length").agg(F.count("*").alias("n")).collect()}
    rows, first, used = [], 0, Counter()
    for bins, made in plan(counts, capacity):
        at = 0
        for n, c in sorted(made.items(), reverse=True):
            rows.append((n, used[n], used[n] + bins * c, c, first, at))
            used[n] += bins * c
            at += n * c
        first += bins
    spark = df.sparkSession
    # A few entries for each of at most `capacity` lengths, whatever the input.
    entries = spark.createDataFrame(rows, "p_length long, p_from long, p_to long, p_each long, p_first long, p_at long")
    own = df.withColumns({"p_part": F.spark_partition_id(), "p_row": F.monotonically_increasing_id()})
    sums = Window.partitionBy("length").orderBy("p_part").rowsBetween(Window.unboundedPreceding, -1)
    before = own.groupBy("length", "p_part").agg(F.count("*").alias("n")).select(
        "length", "p_part", F.coalesce(F.sum("n").over(sums), F.lit(0)).alias("p_before"))
    place = F.row_number().over(Window.partitionBy("length", "p_part").orderBy("p_row")) - 1
    ranked = own.withColumn("p_place", place).join(before, ["length", "p_part"]).withColumn(
        "p_rank", F.col("p_place") + F.col("p_before"))
    inside = F.col("p_rank") - F.col("p_from")
    return ranked.join(F.broadcast(entries), (F.col("length") == F.col("p_length")) & (F.col("p_rank") >= F.col("p_from"))
                       & (F.col("p_rank") < F.col("p_to"))).select(
        *df.columns, (F.col("p_first") + F.floor(inside / F.col("p_each"))).cast("bigint").alias("sequence_id"),
        (F.col("p_at") + inside % F.col("p_each") * F.col("length")).alias("offset"))


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and ids of every sequence, from packed pieces that keep their ids."""
    inside = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(inside.alias("inside")).select(
        "sequence_id", F.aggregate("inside", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
