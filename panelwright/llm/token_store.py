"""Token ids in binary files, each document compressed on its own with a dictionary that all share.

A file: magic, id width, the dictionary's SHA-256; one zstandard frame for each document, in order; an index (Arrow IPC:
doc_id, n_tokens, offset of its frame); the index's place, the number of documents and of ids, magic again. So a short
document is read with its frame and the index alone. The dictionary, trained on ids of at most SAMPLE_DOCS documents
(those with the least hash of their id, SAMPLE_IDS ids of each at most), lies beside the files under its hash.

Documents are dealt out by ranges of their id, so that files are in ascending order; rows with the same id are told
apart by their text and place, so that they may go to several files. A task writes one file as its rows come, and a new
attempt writes the same file. Nothing but a row for each file is gathered.

Defined cases: null and empty texts have the end id only; null ids come first; repeated rows keep a frame each; a corpus
too small to train on has an empty dictionary; an empty table gives no documents. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwright.llm.common import cut, kinds_of, portions, stored, text_of, written_once
from panelwright.llm.encoding import encoder

MAGIC = b"TOKIDS01"
HEAD = "<8sB32s"
TAIL = "<QQQQ8s"  # index: offset, bytes; documents; ids
END_ID = 2
SAMPLE_DOCS, SAMPLE_IDS, DICTIONARY_BYTES = 1000, 4096, 112_640
LEVEL = 3


def serialized(ids: np.ndarray, width: int) -> bytes:
    return ids.astype(f"<u{width}").tobytes()


def train(docs: DataFrame, folder: str, path: str, end_id: int = END_ID) -> str:
    """Writes the dictionary and returns its hash."""
    least = docs.select("doc_id", F.xxhash64("doc_id").alias("order")).distinct().orderBy("order", "doc_id").limit(SAMPLE_DOCS)
    some = docs.join(F.broadcast(least.select("doc_id")), "doc_id", "left_semi").select(text_of().alias("body"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, 0):
            width = encoder(path).width
            raw = [serialized(np.frombuffer(x, "<u4")[:SAMPLE_IDS], width) for x in encoder(path).encode(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(raw, pa.binary())], names=["ids"])

    samples = [bytes(r["ids"]) for r in some.mapInArrow(run, "ids binary").limit(SAMPLE_DOCS).collect()]
    try:
        trained = zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes() if len(samples) > 8 else b""
    except zstandard.ZstdError:
        trained = b""
    name = hashlib.sha256(trained).hexdigest()
    with written_once(f"{folder}/{name}.dictionary", 0) as out:
        out.write(trained)
    return name


def dictionary(folder: str, name: str) -> zstandard.ZstdCompressionDict | None:
    system, path = stored(f"{folder}/{name}.dictionary")
    with system.open_input_stream(path, compression=None) as file:
        data = file.read()
    if hashlib.sha256(data).hexdigest() != name:
        raise ValueError(f"{path} isn't the dictionary that it is named after")
    return zstandard.ZstdCompressionDict(data) if data else None


FILES = "file int, uri string, least long, docs long, ids long"


def write(docs: DataFrame, folder: str, path: str, end_id: int = END_ID) -> DataFrame:
    """Writes the files; a row for each (FILES), kept by cut()."""
    name = train(docs, folder, path, end_id)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("body"), F.xxhash64("text").alias("content"),
                         F.monotonically_increasing_id().alias("place"))
    order = ["doc_id", "content", "place"]
    dealt = source.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "body")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        uri = f"{folder}/{task.partitionId():08d}.ids"
        codes = encoder(path)
        shared = dictionary(folder, name)
        press = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_dict_id=False)
        ids, lengths, offsets, at, end = [], [], [], struct.calcsize(HEAD), np.array([end_id], "<u4")
        rows = portions(batches, 1)
        if (batch := next(rows, None)) is None:
            return
        with written_once(uri, task.taskAttemptId()) as out:
            out.write(struct.pack(HEAD, MAGIC, codes.width, bytes.fromhex(name)))
            while batch is not None:
                ids.append(batch.column(0))
                for raw in codes.encode(batch.column(1)):
                    whole = np.concatenate((np.frombuffer(raw, "<u4"), end))
                    frame = press.compress(serialized(whole, codes.width))
                    out.write(frame)
                    lengths.append(len(whole)), offsets.append(at)
                    at += len(frame)
                batch = next(rows, None)
            index = pa.RecordBatch.from_arrays([pa.concat_arrays(ids), pa.array(lengths, pa.int64()), pa.array(offsets, pa.int64())],
                                               names=["doc_id", "n_tokens", "offset"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, index.schema) as stream:
                stream.write_batch(index)
            index_bytes = sink.getvalue().to_pybytes()
            out.write(index_bytes)
            out.write(struct.pack(TAIL, at, len(index_bytes), len(lengths), sum(lengths), MAGIC))
        yield pa.RecordBatch.from_pydict({"file": pa.array([task.partitionId()], pa.int32()), "uri": [uri], "least": ids[0][:1],
                                          "docs": [len(lengths)], "ids": [sum(lengths)]})

    return cut(dealt.mapInArrow(run, FILES))


class Reader:
    """One file: its index, and the ids of its documents one at a time."""

    def __init__(self, uri: str):
        system, path = stored(uri)
        self.file = system.open_input_file(path)
        size = self.file.size()
        magic, self.width, name = struct.unpack(HEAD, self.file.read_at(struct.calcsize(HEAD), 0))
        start, length, self.docs, self.ids, tail = struct.unpack(TAIL, self.file.read_at(struct.calcsize(TAIL), size - struct.calcsize(TAIL)))
        if magic != MAGIC or tail != MAGIC:
            raise ValueError(f"{uri} isn't a whole file of token ids")
        self.index = pa.ipc.open_stream(self.file.read_at(length, start)).read_next_batch()
        self.ends = [*self.index.column(2).to_pylist()[1:], start]
        self.press = zstandard.ZstdDecompressor(dict_data=dictionary(uri.rpartition("/")[0], name.hex()))

    def at(self, row: int) -> np.ndarray:
        """Ids of a document; reads its frame alone."""
        offset, n = self.index.column(2)[row].as_py(), self.index.column(1)[row].as_py()
        return self._ids(self.file.read_at(self.ends[row] - offset, offset), n)

    def _ids(self, frame: bytes, n: int) -> np.ndarray:
        ids = np.frombuffer(self.press.decompress(frame), f"<u{self.width}").astype("<u4")
        if len(ids) != n:
            raise ValueError("a document's frame and the index disagree")
        return ids

    def rows(self, block: int = 8 << 20) -> Iterator[tuple[int, np.ndarray]]:
        """Row and ids of each document in order, read in blocks of frames."""
        offsets, lengths, row = self.index.column(2).to_pylist(), self.index.column(1).to_pylist(), 0
        while row < self.docs:
            last = row
            while last + 1 < self.docs and self.ends[last + 1] - offsets[row] <= block:
                last += 1
            data = memoryview(self.file.read_at(self.ends[last] - offsets[row], offsets[row]))
            for i in range(row, last + 1):
                yield i, self._ids(data[offsets[i] - offsets[row]:self.ends[i] - offsets[row]], lengths[i])
            row = last + 1


def read(files: DataFrame, with_ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of every document in the files, and ids."""
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    starts = files.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0))).select("uri", "start")
    shape = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                reader = Reader(uri)
                lengths = reader.index.column(1).to_numpy()
                begins = start + np.cumsum(lengths) - lengths
                crcs, raws, first = [], [], 0
                for row, ids in reader.rows():
                    raw = ids.tobytes()
                    crcs.append(zlib.crc32(raw))
                    raws += [raw] * with_ids
                    if row + 1 == reader.docs or len(crcs) == 1024:
                        own = slice(first, row + 1)
                        yield pa.RecordBatch.from_arrays(
                            [reader.index.column(0)[own], pa.array(begins[own]), pa.array(lengths[own]), pa.array(crcs, pa.int64()),
                             *([pa.array(raws, pa.binary())] if with_ids else [])],
                            names=["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)
                        crcs, raws, first = [], [], row + 1

    return starts.repartition(max(1, files.count())).mapInArrow(run, shape)
