"""WARC archives: records of pages are written in segments, and put together again when read.

Writing: a page is one response record, its block an HTTP message in chunked transfer framing, or a revisit record that
refers to the response with the same payload. A block longer than a segment goes into a first record with
WARC-Segment-Number 1 and continuation records with WARC-Segment-Origin-ID; the last one has the total length. A task
writes gzip members, one a record, into files of bounded size; a new attempt writes the same files.

Reading: files are parsed record by record. Whole records go on at once; segments alone are shuffled, grouped by the id
of their origin, put in order, and their number and total length verified. Then chunks are decoded and the payload's
digest is verified. A group is as large as one record.

Defined cases: a null payload is empty; payloads of fewer than 100 bytes are all responses; rows that repeat
the response's id are responses too, and rows without an id refer to it; an empty table gives no files and no rows; a
missing or misplaced segment, a wrong total length, wrong framing or a wrong digest raises. Other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import cut, portions, stored, utf8_of, written_once

LEAST_BYTES = 100
SEGMENT_BYTES = 1 << 16
FILE_BYTES = 64 << 20
CHUNK_BYTES = 4096
END = b"\r\n"
#: Fixed by the format.
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """Chunked transfer framing."""
    out = []
    for at in range(0, len(payload), size):
        part = payload[at:at + size]
        out += [b"%x" % len(part), END, part, END]
    return b"".join([*out, b"0", END, END])


def unchunked(body: bytes) -> bytes:
    """The payload of chunked framing; chunk extensions and trailers are passed over."""
    out, at = [], 0
    while True:
        end = body.find(END, at)
        size = body[at:end].partition(b";")[0].strip() if end >= 0 else b""
        if not re.fullmatch(rb"[0-9A-Fa-f]+", size):
            raise ValueError("a chunk has no size")
        n, at = int(size, 16), end + 2
        if not n:
            break
        if body[at + n:at + n + 2] != END:
            raise ValueError("a chunk doesn't end where its size says")
        out.append(body[at:at + n])
        at += n + 2
    while True:  # trailers, up to an empty line
        end = body.find(END, at)
        if end < 0:
            raise ValueError("the last chunk isn't ended")
        if end == at:
            return b"".join(out)
        at = end + 2


def record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", len(block))])
    return b"WARC/1.1\r\n" + lines.encode() + END + block + END + END


def records(page: str, url: str, kind: str, digest: str, refers_to: str | None, payload: bytes, name: str,
            segment: int = SEGMENT_BYTES) -> Iterator[bytes]:
    """The page's record, in segments. `name` makes its ids: the same in every attempt, different for every row."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    block = (http + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload) if kind == "response"
             else http + b"Content-Length: %d\r\n\r\n" % len(payload))
    own = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{name}:1>"), ("WARC-Date", DATE), ("WARC-Target-URI", url),
           ("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Page-ID", page), ("Content-Type", "application/http; msgtype=response")]
    if kind == "revisit":
        own += [("WARC-Profile", IDENTICAL), ("WARC-Refers-To-Page-ID", refers_to)]
    if len(block) <= segment:
        yield record(own, block)
        return
    last = -(-len(block) // segment)
    yield record([*own, ("WARC-Segment-Number", 1)], block[:segment])
    for n in range(2, last + 1):
        yield record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:page:{name}:{n}>"), ("WARC-Date", DATE),
                      ("WARC-Target-URI", url), ("WARC-Segment-Origin-ID", f"<urn:page:{name}:1>"), ("WARC-Segment-Number", n),
                      *([("WARC-Segment-Total-Length", len(block))] if n == last else [])], block[(n - 1) * segment:n * segment])


def planned(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest, kind and refers_to of each page. Only digests that occur more than once are joined,
    and a common one is a row of that side."""
    own = pages.select("page_id", F.col("url").cast("string").alias("url"), utf8_of("html").alias("payload")).withColumn(
        "digest", F.sha2("payload", 256))
    copied = own.where(F.octet_length("payload") >= LEAST_BYTES).groupBy("digest").agg(
        F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("of"), "first")
    revisit = F.col("page_id").isNull() & F.col("first").isNotNull() | (F.col("page_id") != F.col("first"))
    return own.join(copied, F.col("digest") == F.col("of"), "left").select(
        "page_id", "url", "payload", "digest", F.when(revisit, "revisit").otherwise("response").alias("kind"),
        F.when(revisit, F.col("first")).alias("refers_to"))


def _target(url: str | None) -> str:
    """A header holds one line of visible characters."""
    return re.sub(r"\s", "%20", url or "about:blank")


def write(pages: DataFrame, folder: str, segment: int = SEGMENT_BYTES) -> DataFrame:
    """Writes the archives; uri and records of each file, kept by cut()."""
    source = planned(pages).select(F.col("page_id").cast("string").alias("page"), "url", "kind", "digest",
                                   F.col("refers_to").cast("string").alias("refers_to"), "payload")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        rows = (r for batch in portions(batches, 5) for r in batch.to_pylist())
        row, file, at = next(rows, None), 0, 0
        while row is not None:
            uri, n, size = f"{folder}/{task.partitionId():08d}-{file:06d}.warc.gz", 0, 0
            with written_once(uri, task.taskAttemptId()) as out:
                while row is not None and size < FILE_BYTES:
                    for raw in records(row["page"] or "", _target(row["url"]), row["kind"], row["digest"], row["refers_to"],
                                       row["payload"], f"{task.partitionId()}:{at}", segment):
                        member = gzip.compress(raw, 1, mtime=0)
                        out.write(member)
                        n, size = n + 1, size + len(member)
                    row, at = next(rows, None), at + 1
            file += 1
            yield pa.RecordBatch.from_pydict({"uri": [uri], "records": pa.array([n], pa.int64())})

    return cut(source.mapInArrow(run, "uri string, records long"))


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes


def parsed(raw: bytes) -> Record:
    head, mark, rest = raw.partition(END + END)
    first, *lines = head.decode().split("\r\n")
    headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    length = int(headers.get("content-length", -1))
    if not first.startswith("WARC/") or not mark or rest[length:] != END + END:
        raise ValueError("a record isn't whole")
    return Record(headers, rest[:length])


def members(file: pa.NativeFile, step: int = 1 << 16) -> Iterator[bytes]:
    """The contents of a file's gzip members, one after the other."""
    data = b""
    while True:
        inflate, out = zlib.decompressobj(31), []
        while not inflate.eof:
            if not data and not (data := file.read(step)):
                if out:
                    raise ValueError("the file ends within a record")
                return
            out.append(inflate.decompress(data))
            data = inflate.unused_data
        yield b"".join(out)


def payload_of(block: bytes) -> tuple[bytes | None, int]:
    """The payload of an HTTP message and its length; a message without body has the length alone."""
    head, _, body = block.partition(END + END)
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in head.split(END)[1:])}
    if headers.get(b"transfer-encoding", b"").lower() == b"chunked":
        payload = unchunked(body)
        return payload, len(payload)
    return body or None, int(headers.get(b"content-length", len(body)))


def same_digest(stated: str, payload: bytes) -> bool:
    """`stated` names SHA-256 in hex or SHA-1 in base 32; other kinds aren't verified."""
    kind, _, value = stated.partition(":")
    if kind.lower() == "sha256":
        return hashlib.sha256(payload).hexdigest() == value
    return kind.lower() != "sha1" or base64.b32encode(hashlib.sha1(payload).digest()).decode() == value


ROW = "page string, kind string, digest string, bytes long, refers_to string, url string"
_SEGMENTS = ROW.replace("bytes long", "bytes long, payload binary") + ", origin string, number int, total long, block binary"
_NAMES = [f.split()[0] for f in _SEGMENTS.split(", ")]
_TYPES = dict(zip(_NAMES, [pa.string()] * 3 + [pa.int64(), pa.binary()] + [pa.string()] * 3 + [pa.int32(), pa.int64(), pa.binary()]))


def row_of(headers: dict[str, str], block: bytes, with_payload: bool) -> dict[str, object]:
    payload, n = payload_of(block)
    stated = headers.get("warc-payload-digest", "")
    if payload is not None and not same_digest(stated, payload):
        raise ValueError(f"the payload of {headers.get('warc-record-id')} isn't the one that was written")
    return {"page": headers.get("warc-page-id"), "kind": headers["warc-type"], "digest": stated.partition(":")[2], "bytes": n,
            "payload": payload if with_payload else None, "refers_to": headers.get("warc-refers-to-page-id"),
            "url": headers.get("warc-target-uri")}


def segment_of(found: Record) -> dict[str, object]:
    """A segment waits, with its headers in front, for the others of its origin."""
    h = found.headers
    head = "".join(f"{k}: {v}\r\n" for k, v in h.items()).encode() if h["warc-type"] != "continuation" else b""
    return {"origin": h.get("warc-segment-origin-id") or h["warc-record-id"], "number": int(h["warc-segment-number"]),
            "total": int(h["warc-segment-total-length"]) if "warc-segment-total-length" in h else None,
            "block": len(head).to_bytes(4, "big") + head + found.block}


def joined(segments: list[dict[str, object]]) -> tuple[dict[str, str], bytes]:
    """Headers and block of the record whose segments these are."""
    segments = sorted(segments, key=lambda s: s["number"])
    if [s["number"] for s in segments] != list(range(1, len(segments) + 1)):
        raise ValueError(f"segments of {segments[0]['origin']} are missing or double")
    headers, blocks = {}, []
    for s in segments:
        n = 4 + int.from_bytes(s["block"][:4], "big")
        headers |= {k: v.strip() for k, _, v in (x.partition(":") for x in s["block"][4:n].decode().splitlines())}
        blocks.append(s["block"][n:])
    block = b"".join(blocks)
    if segments[-1]["total"] != len(block):
        raise ValueError(f"segments of {segments[0]['origin']} have {len(block)} bytes, not {segments[-1]['total']}")
    return headers, block


def _batch(rows: list[dict[str, object]], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], _TYPES[n]) for n in names], names=names)


def read(files: DataFrame, with_payload: bool = False) -> DataFrame:
    """page, kind, digest, bytes, refers_to and url of every record in the files (column uri), and payload if asked for."""
    names = [n for n in _NAMES[:_NAMES.index("origin")] if with_payload or n != "payload"]
    shape = ", ".join(f for f in _SEGMENTS.split(", ") if f.split()[0] in names)

    def parse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                system, path = stored(uri)
                rows, size = [], 0
                with system.open_input_stream(path, compression=None) as file:
                    for raw in members(file):
                        found = parsed(raw)
                        segmented = "warc-segment-number" in found.headers
                        rows.append(segment_of(found) if segmented else row_of(found.headers, found.block, with_payload))
                        size += len(raw) if segmented or with_payload else 200
                        if size > 4 << 20:
                            yield _batch(rows, _NAMES)
                            rows, size = [], 0
                if rows:
                    yield _batch(rows, _NAMES)

    def assemble(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                headers, block = joined(batch.column(0)[i].as_py())
                yield _batch([row_of(headers, block, with_payload)], names)

    # Either reading of the archives takes what the other leaves; segments are few where records are short.
    found = files.select("uri").repartition(max(1, files.count())).mapInArrow(parse, _SEGMENTS)
    found = cut(found) if not with_payload else found
    groups = found.where("origin is not null").groupBy("origin").agg(
        F.collect_list(F.struct("origin", "number", "total", "block")).alias("segments")).select("segments")
    return found.where("origin is null").select(*names).unionByName(groups.mapInArrow(assemble, shape))
