"""Benchmark decontamination: Wu-Manber multi-pattern search over words.

Patterns are windows of consecutive benchmark words. For each window length there is a shift table over blocks of two
words: a block that no window holds lets the search skip a whole window, and one that ends a window leads to a bucket
of windows with that ending, whose first word is tested before all words are compared.

The benchmark is taken in blocks of bounded size; the documents are searched once for each, and their hits add up.
What a block has found is written to the shared folder before the next block is read, so that any benchmark can be
searched for, a task never holds more than one block's tables, and no plan more than one block. This takes disk space of
the texts for each block but the last.

Defined cases: null texts and texts without words hit nothing; benchmark items without words are never found; items
with the same id count once, whichever row was found; null item ids are searched for but not listed; repeated documents
keep a row each; empty tables give no hits or no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import cut, numbered, parts, utf8_of

#: Digits and small letters stay, capitals become small, all other ASCII ends a word; other UTF-8 bytes stay.
_WORD = bytes(b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
BLOCK_BYTES = 32 << 20


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORD).split()


@dataclass
class Table:
    """Windows of one length, by the words that end them. `shift`: words that may be skipped at a block of two words
    (of one, for windows of one word); `ends`: at a block with shift 0, the windows that end there."""

    length: int
    shift: dict = field(default_factory=dict)
    ends: dict = field(default_factory=dict)
    windows: dict = field(default_factory=dict)

    @property
    def skip(self) -> int:
        return max(1, self.length - 1)

    def add(self, window: tuple[bytes, ...], item: int) -> None:
        if window in self.windows:
            self.windows[window].add(item)
            return
        self.windows[window] = {item}
        if self.length == 1:
            self.ends.setdefault(window, []).append(window)
            self.shift[window] = 0
            return
        for k in range(1, self.length):
            block = window[k - 1:k + 1]
            self.shift[block] = min(self.shift.get(block, self.skip), self.length - 1 - k)
        self.ends.setdefault(window[-2:], []).append(window)

    def search(self, words: list[bytes]) -> Iterator[tuple[int, set[int]]]:
        """Where a window begins, and the items that hold it."""
        at, wide, length, skip, shift, ends = self.length - 1, min(self.length, 2), self.length, self.skip, self.shift, self.ends
        while at < len(words):
            block = (words[at - 1], words[at]) if wide == 2 else (words[at],)
            jump = shift.get(block, skip)
            if jump:
                at += jump
                continue
            begin = at - length + 1
            for window in ends[block]:
                if window[0] == words[begin] and list(window) == words[begin:at + 1]:
                    yield begin, self.windows[window]
            at += 1


def tables(items: list[tuple[object, bytes]], window: int = 10) -> list[Table]:
    """One table for each length of window; an item of fewer words is one window."""
    found: dict[int, Table] = {}
    for n, (_, text) in enumerate(items):
        words = words_of(text)
        length = min(window, len(words))
        if length:
            table = found.setdefault(length, Table(length))
            for at in range(len(words) - length + 1):
                table.add(tuple(words[at:at + length]), n)
    return list(found.values())


def hits_of(words: list[bytes], found: list[Table]) -> tuple[list[list[int]], set[int]]:
    """Stretches [begin, end) of hit words, apart and in order, and the places of the items."""
    spans, items = [], set()
    for table in found:
        for begin, which in table.search(words):
            spans.append([begin, begin + table.length])
            items |= which
    return merged(spans), items


def merged(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for begin, end in sorted(spans):
        if out and begin <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([begin, end])
    return out


_FOUND = [("n_words", pa.int64()), ("hits", pa.list_(pa.list_(pa.int64()))), ("items", pa.list_(pa.string()))]


def _searched(docs: DataFrame, items: list[tuple[str | None, bytes]], window: int, first: bool) -> DataFrame:
    """`docs` ends with utf8, and, after the first block, with what the blocks before have found."""
    kept = docs.columns[:docs.columns.index("utf8") + 1]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        built = tables(items, window)
        for batch in parts(batches):
            n, hits, named = [], [], []
            earlier = [([], [])] * batch.num_rows if first else list(zip(
                batch.column(len(kept) + 1).to_pylist(), batch.column(len(kept) + 2).to_pylist()))
            for text, (spans, ids) in zip(batch.column(len(kept) - 1).to_pylist(), earlier, strict=True):
                words = words_of(text)
                found, which = hits_of(words, built)
                n.append(len(words))
                hits.append(merged(spans + found) if spans else found)
                named.append(sorted({*ids, *(items[i][0] for i in which if items[i][0] is not None)}))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(kept)], *(pa.array(x, t) for x, (_, t) in zip((n, hits, named), _FOUND))],
                names=[*kept, *(x for x, _ in _FOUND)])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields[:len(kept)])
    return docs.mapInArrow(run, f"{kinds}, n_words long, hits array<array<long>>, items array<string>")


def search(docs: DataFrame, benchmark: DataFrame, window: int = 10, keep: tuple[str, ...] = ("doc_id",),
           block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The `keep` columns, n_words, hits (stretches of hit words) and items (sorted ids as strings) of each document.

    Items go to blocks by running size within buckets by id; a block comes to the driver, which never holds two.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), utf8_of().alias("utf8"))
    size = items.agg(F.sum(F.octet_length("utf8"))).first()[0] or 0
    blocks = -(-size // block_bytes) or 1
    taken = [F.col(c).alias(f"keep{i}") for i, c in enumerate(keep)]
    out = docs.select(*taken, utf8_of().alias("utf8"))
    bucket = F.pmod(F.xxhash64("item", "utf8"), F.lit(blocks))
    for b in range(blocks):
        if b:
            rows, out = None, cut(out)
        rows = [(r["item"], bytes(r["utf8"])) for r in items.where(bucket == b).collect()]
        out = _searched(out, rows, window, first=b == 0)
    return out.select(*(F.col(f"keep{i}").alias(c) for i, c in enumerate(keep)), "n_words", "hits", "items")


def clean(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The rows of `docs` without a hit, columns unchanged."""
    own, names, old = numbered(docs)
    return search(own, benchmark, window, keep=names).where(F.size("hits") == 0).select(*old)
