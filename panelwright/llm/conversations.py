"""Conversation structure repair by Wagner-Fischer alignment with the grammar (s?(ua)+)?.

A conversation's turns are aligned with every feasible length of the grammar's alternating string: keep a turn whose role
has the initial that stands there (0), rerole it to user or assistant (2), delete it (3), insert an empty turn (2). All
lengths end alike, so that one table of suffixes serves them: cell (r, j) holds the cost of the last r turns against the
last j characters. Ukkonen's bands keep the cells that an alignment no dearer than a known one (the incumbent, from one
greedy pass) can touch: r - j turns more need as many deletions, j - r characters more as many insertions. The cheapest
lengths are traced back, at each step by the least letter of an optimal move, and their audits compared.

Turns are collapsed to (turn, role, digest of the text) with a count before they move, so that only digests, flags and
counts are sorted. They are dealt by ranges of (conversation, turn, role, digest), so a conversation of any size is spread
over as many tasks as its share of the rows asks for. A task cuts what it has of a conversation into blocks of at most BLOCK
turns and aligns each from every state of the grammar to every other; the blocks' costs and audits are then added up per
conversation, which holds ten times the audit at most, and the audit is a value of the result. The texts move once, to
the digest of the repaired conversation, which SHA-256 can only take in order: they are streamed there, never gathered.

Defined cases: null conversations are one conversation; null turns come first; a null role or text is one space, and an empty
role counts as a space; turns with equal numbers are ordered by role, then by the SHA-256 of the text; repeated rows are
duplicates of each other; an empty table gives an empty result. Only conv_id, turn, role and text are read, other columns
are ignored. Very long texts move once, whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import cut

KEEP_TRUNCATED, REROLE, DELETE, INSERT = 1, 2, 3, 2
#: Turns of a block at most.
BLOCK = 1024
WHITE = " \t\n\x0b\x0c\r"
ROLES = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}
FAR = 1 << 40
#: States of the grammar: nothing yet, after s, after u, after a. A conversation may end in the first and in the last.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
ENDS = (START, AFTER_A)
WHOLE = ((START, START), (START, AFTER_A))
ALL = ((START, START), (START, AFTER_S), (START, AFTER_U), (START, AFTER_A), (AFTER_S, AFTER_S), (AFTER_S, AFTER_U),
       (AFTER_S, AFTER_A), (AFTER_U, AFTER_U), (AFTER_U, AFTER_A), (AFTER_A, AFTER_U), (AFTER_A, AFTER_A))


def damaged(table: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and copies (how often the row stands there) after a damage that depends on conv_id:turn."""
    own = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat_ws(":", *own).cast("binary")) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    return table.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"))


# ------------------------------------------------------------------ alignment of a block
@dataclass
class Turns:
    """Turns in order: the live ones (initial of the role, truncated) and how many dead ones, which must be deleted, stand
    before each of them and at the end."""

    live: list[tuple[str, bool]] = field(default_factory=list)
    dead: list[int] = field(default_factory=lambda: [0])
    count: int = 0

    def add(self, initial: str, code: str) -> None:
        self.count += 1
        if code in "bd":
            self.dead[-1] += 1
        else:
            self.live.append((initial, code == "t"))
            self.dead.append(0)


def expected(state: int) -> str:
    return "a" if state == AFTER_U else "u"


def incumbent(turns: Turns, state: int) -> int:
    """Cost of the live turns from `state` on by one greedy pass: what is missing before a turn is inserted."""
    cost = 0
    for initial, truncated in turns.live:
        cost += truncated * KEEP_TRUNCATED
        if initial == "s" and state == START:
            state = AFTER_S
        elif initial in ROLES:
            cost += 0 if initial == expected(state) else INSERT
            state = AFTER_U if initial == "u" else AFTER_A
        else:
            cost += REROLE
            state = AFTER_A if state == AFTER_U else AFTER_U
    return cost + {START: 0, AFTER_S: 2 * INSERT, AFTER_U: INSERT, AFTER_A: 0}[state]


@lru_cache(512)
def _by_parity(odd: int, even: int, first: int, width: int) -> np.ndarray:
    return np.where((np.arange(width) + first) & 1, odd, even)


class Suffixes:
    """Costs of the last r live turns against the last j characters of the alternating string that ends in `end`.

    Row r holds j from r - low to r + high: the band of alignments that cost `bound` or less.
    """

    def __init__(self, turns: Turns, end: str, bound: int) -> None:
        self.turns, self.end, self.other = turns, end, "a" if end == "u" else "u"
        self.low, self.high = bound // DELETE, bound // INSERT
        steps = np.arange(-self.low, self.high + 1)
        inserted, width = INSERT * steps, len(steps)
        row = np.where(steps >= 0, inserted, FAR)
        self.rows, last = [row], np.array([FAR])
        for r, (initial, truncated) in enumerate(reversed(turns.live), 1):
            extra = truncated * KEEP_TRUNCATED
            match = _by_parity(extra + REROLE * (initial != end), extra + REROLE * (initial != self.other), (r - self.low) & 1, width)
            row = np.minimum(np.concatenate((row[1:], last)) + DELETE, row + match) - inserted
            row = np.minimum.accumulate(row) + inserted
            self.rows.append(row)

    def cost(self, r: int, j: int) -> int:
        at = j - r + self.low
        return int(self.rows[r][at]) if 0 <= at <= self.low + self.high else FAR

    def lengths(self, r: int, parity: int, least: int) -> Iterator[tuple[int, int]]:
        """(cost, j) of each feasible length."""
        for j in range(max(least, r - self.low), r + self.high + 1):
            if j & 1 == parity:
                yield self.cost(r, j), j

    def audit(self, r: int, j: int) -> str:
        live, dead = self.turns.live, self.turns.dead
        out = ["D" * dead[len(live) - r]]
        while r or j:
            cost, step = self.cost(r, j), "D"
            if r and self.cost(r - 1, j) + DELETE == cost:
                r -= 1
            elif j and self.cost(r, j - 1) + INSERT == cost:
                step, j = "I", j - 1
            else:
                step = "K" if live[len(live) - r][0] == (self.end if j & 1 else self.other) else "R"
                r, j = r - 1, j - 1
            out.append(step if step == "I" else step + "D" * dead[len(live) - r])
        return "".join(out)


def alignments(turns: Turns, pairs: Iterable[tuple[int, int]]) -> dict[tuple[int, int], tuple[int, str]]:
    """Cheapest cost and ASCII-least audit of the turns from one state of the grammar to another, where there is one."""
    live, dead, n = turns.live, turns.dead, len(turns.live)
    must, none = DELETE * sum(dead), "D" * turns.count
    starts = {p for p, _ in pairs}
    bound = min(incumbent(turns, START), DELETE * n) if starts == {START} and (START, AFTER_U) not in pairs else max(
        incumbent(turns, p) for p in starts) + 2 * INSERT
    ends = {q for _, q in pairs if q in (AFTER_U, AFTER_A)}
    tables = {q: Suffixes(turns, "u" if q == AFTER_U else "a", bound) for q in ends}
    kept_s = [i for i, (initial, _) in enumerate(live) if initial == "s"]
    before = [0, *accumulate(dead)]

    def lead(i: int) -> str:
        """Everything before live turn i goes, and it stays."""
        return "D" * (before[i + 1] + i) + "K"

    found = {}
    for p, q in pairs:
        options: list[tuple[int, object]] = []
        if p == q and p in (START, AFTER_S):
            options = [(DELETE * n, lambda: none)]
        elif q == AFTER_S:
            options = [(DELETE * (n - 1) + live[i][1] * KEEP_TRUNCATED, lambda i=i: lead(i) + "D" * (turns.count - len(lead(i))))
                       for i in kept_s]
        else:
            table = tables[q]
            parity = int(expected(p) == table.end)
            options = [(c, lambda j=j: table.audit(n, j)) for c, j in table.lengths(n, parity, 2 if p < AFTER_U and not parity else 0)]
            if p == START:
                for i in kept_s:
                    spent = DELETE * i + live[i][1] * KEEP_TRUNCATED
                    if spent <= bound:
                        options += [(spent + c, lambda i=i, j=j: lead(i) + table.audit(n - i - 1, j))
                                    for c, j in table.lengths(n - i - 1, parity, 0 if parity else 2)]
        least = min((c for c, _ in options), default=FAR)
        if least < FAR:
            found[p, q] = (least + must, min(trace() for c, trace in options if c == least))
    return found


def joined(blocks: list[dict[tuple[int, int], tuple[int, str]]]) -> tuple[int, str]:
    """Cost and audit of a conversation from those of its blocks, in order."""
    best = {q: (0, "") for q in ENDS}
    for block in reversed(blocks):
        ahead: dict[int, tuple[int, str]] = {}
        for (p, q), (cost, audit) in block.items():
            if q in best:
                own = (cost + best[q][0], audit + best[q][1])
                ahead[p] = min(ahead.get(p, own), own)
        best = ahead
    return best[START]


# ------------------------------------------------------------------ blocks of sorted turns
_BLOCK = ("conv_id {kind}, part int, seq int, first string, last string, illegal long, blank long, duplicate long, truncated long, "
          "low long, high long, turns long, paths array<struct<p:int,q:int,cost:long,audit:string>>")


class _Block:
    """What a stretch of a conversation's sorted turns adds to the conversation's row."""

    def __init__(self, conv) -> None:
        self.conv, self.turns = conv, Turns()
        self.first = self.last = self.low = self.high = None
        self.illegal = self.numbers = 0
        self.faults = {"b": 0, "d": 0, "t": 0, "g": 0}

    def add(self, number: int | None, initial: str, code: str) -> None:
        if self.last is None:
            self.first = initial
        elif self.last + initial not in LEGAL:
            self.illegal += 1
        self.last = initial
        if number is not None:
            if number != self.high:
                self.numbers += 1
            self.low, self.high = number if self.low is None else self.low, number
        self.faults[code] += 1
        self.turns.add(initial, code)

    def row(self, part: int, seq: int, whole: bool) -> dict:
        paths = alignments(self.turns, WHOLE if whole else ALL)
        return dict(conv_id=self.conv, part=part, seq=seq, first=self.first, last=self.last, illegal=self.illegal, blank=self.faults["b"],
                    duplicate=self.faults["d"], truncated=self.faults["t"], low=self.low, high=self.high, turns=self.numbers,
                    paths=[dict(p=p, q=q, cost=c, audit=a) for (p, q), (c, a) in paths.items()])


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    """Rows of the blocks. Only a conversation at an end of the task's stretch can go on in another task."""
    part, seq, inner = TaskContext.get().partitionId(), 0, False
    block, split = None, False
    for batch in batches:
        for conv, number, initial, code, n in zip(*(c.to_pylist() for c in batch.columns)):
            if block is None or conv != block.conv:
                if block is not None:
                    yield block.row(part, seq, inner and not split)
                    inner, seq = True, seq + 1
                block, split = _Block(conv), False
            for copy in range(n):
                if block.turns.count == BLOCK:
                    yield block.row(part, seq, False)
                    block, seq, split = _Block(conv), seq + 1, True
                block.add(number, initial, code if not copy else "b" if code == "b" else "d")
    if block is not None:
        yield block.row(part, seq, False)


def _batched(rows: Iterator[dict], schema: pa.Schema, size: int = 1024) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _arrow(spark, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def _totals(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for row in batch.to_pylist():
            blocks = row["blocks"]
            cost, audit = joined([{(x["p"], x["q"]): (x["cost"], x["audit"]) for x in b["paths"]} for b in blocks])
            out = {k: sum(b[k] for b in blocks) for k in ("illegal", "blank", "duplicate", "truncated")}
            held = [b for b in blocks if b["first"] is not None]
            out["illegal"] += sum(a["last"] + b["first"] not in LEGAL for a, b in zip(held, held[1:]))
            numbered = [b for b in blocks if b["low"] is not None]
            distinct = sum(b["turns"] for b in numbered) - sum(a["high"] == b["low"] for a, b in zip(numbered, numbered[1:]))
            out["gaps"] = numbered[-1]["high"] - numbered[0]["low"] + 1 - distinct if numbered else 0
            yield out | {"conv_id": row["conv_id"], "cost": cost, "audit": audit}


def _told(turns: DataFrame) -> DataFrame:
    """The turns with roles and texts that aren't null, and the digest of the text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    return turns.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"),
                        F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), F.col("copies").cast("long").alias("copies"))


def _order() -> list[Column]:
    return [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("digest").asc()]


def audits(turns: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost and audit of every conversation of `turns` (conv_id, turn, role,
    text and copies, how often a row stands there: 0 for a conversation that may have no turns left)."""
    end = F.rtrim(F.col("text"), F.lit(WHITE))
    code = F.when(end == "", "b").when(F.substring(end, -1, 1).isin(*".!?"), "g").otherwise("t")
    initial = F.when(F.col("role") == "", " ").otherwise(F.substring("role", 1, 1))
    rows = _told(turns).groupBy("conv_id", "turn", "role", "digest", initial.alias("initial"), code.alias("code")).agg(
        F.sum("copies").alias("n"))
    rows = cut(rows)
    seen = rows.where("n > 0").groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d")).agg(
        F.min(F.struct(F.col("turn").isNotNull().alias("has"), "turn")).alias("seen"), F.count("*").alias("times")).where("times > 1")
    again = F.col("times").isNotNull() & ~F.col("turn").eqNullSafe(F.col("seen.turn"))
    rows = rows.join(seen, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")), "left")
    rows = rows.withColumn("code", F.when(again & (F.col("code") != "b"), "d").otherwise(F.col("code")))
    ordered = rows.select("conv_id", "turn", "role", "digest", "initial", "code", "n").repartitionByRange(*_order()).sortWithinPartitions(*_order())
    kind = turns.schema["conv_id"].dataType.simpleString()
    ddl = _BLOCK.format(kind=kind)
    schema = _arrow(turns.sparkSession, ddl)
    blocks = ordered.select("conv_id", "turn", "initial", "code", "n").mapInArrow(lambda batches: _batched(_blocks(batches), schema), ddl)
    # A block's row may come from a task that is run again, over the same range: kept, so that all come from one run.
    blocks = cut(blocks)
    names = [c for c in blocks.columns if c != "conv_id"]
    one = blocks.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(*names))).alias("blocks"))
    ddl = f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
    totals = _arrow(turns.sparkSession, ddl)
    return one.mapInArrow(lambda batches: _batched(_totals(batches), totals), ddl)


# ------------------------------------------------------------------ the repaired turns
class _Repair:
    """Follows a conversation's audit while its turns pass by, in order."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.state = audit, 0, START

    def _said(self) -> str:
        role = expected(self.state)
        self.state = AFTER_U if role == "u" else AFTER_A
        return ROLES[role]

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            yield self._said(), "", "insert"

    def turn(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        yield from self.inserted()
        step, self.at = self.audit[self.at], self.at + 1
        if step == "K":
            self.state = {"s": AFTER_S, "u": AFTER_U, "a": AFTER_A}[role[0]]
            yield role, text, "keep"
        elif step == "R":
            yield self._said(), text, "rerole"


def _repaired(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[dict, Iterator[tuple[str, str, str]]]]:
    """For each conversation its row and its repaired turns, which must be read before the next conversation."""
    rows = ((r["head"], r["role"], r["text"], r["copies"]) for b in batches for at in range(0, b.num_rows, 256) for r in b.slice(at, 256).to_pylist())
    ahead = next(rows, None)

    def turns(own: _Repair) -> Iterator[tuple[str, str, str]]:
        nonlocal ahead
        ahead = next(rows, None)
        while ahead is not None and ahead[0] is None:
            for _ in range(ahead[3]):
                yield from own.turn(ahead[1], ahead[2])
            ahead = next(rows, None)
        yield from own.inserted()

    while ahead is not None:
        head = ahead[0]
        yield head, turns(_Repair(head["audit"]))


def _stream(turns: DataFrame, found: DataFrame) -> DataFrame:
    """Each conversation's row before its turns, in order: (head, role, text, copies)."""
    nothing = {"turn": "long", "role": "string", "text": "string", "digest": "binary", "copies": "long"}
    heads = found.select("conv_id", F.struct(*found.columns).alias("head"), *(F.lit(None).cast(t).alias(c) for c, t in nothing.items()))
    rows = _told(turns).where("copies > 0")
    rows = rows.select("conv_id", F.lit(None).cast(heads.schema["head"].dataType).alias("head"), *nothing)
    both = heads.unionByName(rows).withColumn("body", F.col("head").isNull())
    return both.repartition("conv_id").sortWithinPartitions(
        F.col("conv_id").asc_nulls_first(), "body", *_order()[1:]).select("head", "role", "text", "copies")


def repaired(turns: DataFrame, found: DataFrame) -> DataFrame:
    """conv_id, place (from 0), role, text and edit of every turn of the repaired conversations; `found`: audits(turns)."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        for head, own in _repaired(batches):
            for place, (role, text, edit) in enumerate(own):
                yield dict(conv_id=head["conv_id"], place=place, role=role, text=text, edit=edit)

    ddl = f"conv_id {found.schema['conv_id'].dataType.simpleString()}, place long, role string, text string, edit string"
    schema = _arrow(turns.sparkSession, ddl)
    return _stream(turns, found).mapInArrow(lambda batches: _batched(run(batches), schema, 256), ddl)


def digests(turns: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of `found` with repaired_sha256, the SHA-256 of the repaired role:text lines."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        for head, own in _repaired(batches):
            digest = hashlib.sha256()
            for place, (role, text, _) in enumerate(own):
                digest.update(f"{chr(10) if place else ''}{role}:{text}".encode())
            yield head | {"repaired_sha256": digest.hexdigest()}

    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema.fields), "repaired_sha256 string"])
    schema = _arrow(turns.sparkSession, ddl)
    return _stream(turns, found).mapInArrow(lambda batches: _batched(run(batches), schema), ddl)
