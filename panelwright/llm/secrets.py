"""Secret scans: base patterns, and a sliding-window entropy over candidate strings for each character class.

A window moves over each candidate; the counts of its characters, and with them its Shannon entropy, change by one
character in and one out. Windows above their class's threshold join into a span. Windows that overlap a match of an
allow-list pattern don't count, and spans that show too few kinds of characters, that read as joined words, or that a base
span overlaps, aren't added.

Defined cases: null texts count as empty and have no spans; a text of any length is scanned whole, with memory in
proportion to its candidates; repeated rows keep a row each; an empty table gives an empty result. Positions are code
points. Other columns are ignored, or kept as they are by `mask`.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from math import log2

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import parts, text_of

BASE = ("assign", "access", "hex")
#: Fixed by the contract of the base kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
_KEYS = ("passw", "secret", "token", "api")

WINDOW = 20
#: Class: its strings, and the bits a character that a window needs. Its strings also have to mix the kinds in MIXED.
CLASSES = {"entropy_hex": (re.compile(r"(?<![A-Za-z0-9])[0-9a-fA-F]{20,}(?![A-Za-z0-9])"), 3.0),
           "entropy_base64": (re.compile(r"[A-Za-z0-9+/_=-]{20,}"), 3.7),
           "entropy_lower": (re.compile(r"(?<![A-Za-z0-9])[a-z0-9]{20,}(?![A-Za-z0-9])"), 3.5)}
MIXED = {"entropy_hex": ("[0-9]", "[a-fA-F]"), "entropy_base64": ("[0-9]", "[a-z]", "[A-Z]"), "entropy_lower": ("[0-9]", "[g-z]")}
KINDS = (*BASE, *CLASSES)
#: Harmless strings: ids in UUID form, alphabets and counting, placeholders, paths of words.
ALLOWED = (r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", r"(?i)0123456789|abcdefgh|qwertyuiop",
           r"(?i)example|placeholder|changeme|your[_-]|xxxx", r"^/?([a-z_-]{3,}|[0-9]{1,4})(/([a-z_-]{3,}|[0-9]{1,4}))+/?$")
_BITS = [0.0, *(n * log2(n) for n in range(1, WINDOW + 1))]


def dense(text: str, least: float, window: int = WINDOW) -> list[tuple[int, int]]:
    """Stretches of `text` under windows with an entropy of `least` bits a character or more."""
    counts: dict[str, int] = {}
    total, out = 0.0, []  # total: sum of n log n over the window's characters
    most = window * (log2(window) - least)
    bits = _BITS if window == WINDOW else [0.0, *(n * log2(n) for n in range(1, window + 1))]
    for i, new in enumerate(text):
        begin = i + 1 - window
        if begin > 0:
            old = text[begin - 1]
            n = counts[old]
            counts[old] = n - 1
            total += bits[n - 1] - bits[n]
        n = counts.get(new, 0)
        counts[new] = n + 1
        total += bits[n + 1] - bits[n]
        if begin >= 0 and total <= most + 1e-9:
            if out and begin <= out[-1][1]:
                out[-1] = (out[-1][0], i + 1)
            else:
                out.append((begin, i + 1))
    return out


_ALLOWED = [re.compile(p) for p in ALLOWED]


def _open(string: str) -> Iterator[tuple[int, str]]:
    """Places and stretches of `string` that no allow-list match overlaps and that hold a window."""
    at = 0
    for a, b in [*sorted(m.span() for p in _ALLOWED for m in p.finditer(string)), (len(string), len(string))]:
        if a - at >= WINDOW:
            yield at, string[at:a]
        at = max(at, b)


#: Mean length of the runs of lower-case letters from which a string of class entropy_base64 is words that are joined by
#: capitals, digits or marks. Of random strings of that class it's 1.7, of identifiers and file names 4 or more.
WORDY = 3.0
_LOWER = re.compile("[a-z]+")


def wordy(kind: str, string: str) -> bool:
    """Whether a dense string reads as joined words: camel case, dated file names, paths."""
    runs = _LOWER.findall(string) if kind == "entropy_base64" else ()
    return sum(map(len, runs)) >= WORDY * len(runs) > 0


_MIXED = {k: [re.compile(p) for p in v] for k, v in MIXED.items()}


def base_spans(text: str) -> list[tuple[int, int, str]]:
    low = text.lower() if text.isascii() else text.casefold()
    out = []
    if any(k in low for k in _KEYS):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return out


class Taken:
    """Places of a text that spans cover: starts and ends of disjoint stretches in order, so a look-up is a bisection."""

    def __init__(self, spans: Iterable[tuple[int, int]]):
        self.starts, self.ends = [], []
        for a, b in sorted(spans):
            if self.ends and a <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def add(self, a: int, b: int) -> bool:
        """Covers a stretch and says so, unless some of it is covered already."""
        at = bisect_left(self.starts, b)
        if at and self.ends[at - 1] > a:
            return False
        self.starts.insert(at, a)
        self.ends.insert(at, b)
        return True


def spans_of(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind), by start and then kind as in KINDS."""
    found = base_spans(text)
    taken = Taken((a, b) for a, b, _ in found)
    for kind, (pattern, least) in CLASSES.items():
        for m in pattern.finditer(text):
            if not _MIXED[kind][0].search(m[0]):
                continue
            for at, string in _open(m[0]):
                for a, b in dense(string, least):
                    a, b = m.start() + at + a, m.start() + at + b
                    if all(p.search(text, a, b) for p in _MIXED[kind]) and not wordy(kind, text[a:b]) and taken.add(a, b):
                        found.append((a, b, kind))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


SPANS = "array<struct<kind: string, start: bigint, end: bigint>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def scan(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The `keep` columns and spans of every document."""
    n = len(keep)
    source = docs.select(*(F.col(c).alias(f"keep{i}") for i, c in enumerate(keep)), text_of(text).alias("body"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            found = [[{"kind": k, "start": a, "end": b} for a, b, k in spans_of(t)] for t in batch.column(n).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(found, _SPANS)],
                                             names=[*batch.schema.names[:n], "spans"])

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in source.schema.fields[:n])
    return source.mapInArrow(run, f"{kinds}spans {SPANS}").select(
        *(F.col(f"keep{i}").alias(c) for i, c in enumerate(keep)), "spans")


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(text: str, mark: str = "[secret]") -> str:
    out, at = [], 0
    for a, b, _ in spans_of(text):
        if b > at:
            out += [text[at:a], mark] if a >= at else []
            at = b
    return "".join([*out, text[at:]])


def mask(docs: DataFrame) -> DataFrame:
    """All rows of `docs`, with a mark in place of each span of `text`; a column n_chars follows. Null stays null."""
    at = docs.columns.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            texts = pa.array([t if t is None else masked(t) for t in batch.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([texts if i == at else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
