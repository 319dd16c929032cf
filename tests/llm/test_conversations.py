"""Conversation repair against a search over all edits."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest

from panelwright.llm import conversations as cv
from panelwright.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SHAPE = "conv_id long, turn long, role string, text string, copies string, digest int, head string"


def harm(conv, turn, role, text):
    role, text = (" " if x is None else x for x in (role, text))
    kind = zlib.crc32(":".join(" " if x is None else str(x) for x in (conv, turn)).encode()) % 20
    if kind == 0:
        return []
    text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
    return [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)


def cheapest(turns):
    """(cost, audit) by recursion over turns and states; after each turn at most three inserts make sense."""
    @lru_cache(None)
    def best(i, state, inserts):
        options = [(0, "")] if i == len(turns) and state in ("", "a") else []
        said = "a" if state == "u" else "u"
        if inserts:
            c, a = best(i, said, inserts - 1)
            options.append((c + 2, "I" + a))
        if i < len(turns):
            initial, code = turns[i]
            c, a = best(i + 1, state, 3)
            options.append((c + 3, "D" + a))
            if code not in "bd":
                extra = code == "t"
                if initial == said or (initial == "s" and state == ""):
                    c, a = best(i + 1, initial, 3)
                    options.append((c + extra, "K" + a))
                c, a = best(i + 1, said, 3)
                options.append((c + extra + 2, "R" + a))
        return min(options, default=(10 ** 9, ""))

    for i in range(len(turns), 0, -1):  # from the end on, so that no recursion is deep
        for state in ("", "s", "u", "a"):
            best(i, state, 3)
    return best(0, "", 3)


def expected(rows):
    """The contract's row of each conversation, and its repaired turns."""
    convs = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, []).extend(harm(conv, turn, role, text))
    out = {}
    for conv, turns in convs.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], hashlib.sha256(t[2].encode()).digest()))
        seen, codes = set(), []
        for _, role, text in turns:
            body = re.findall(r"[^\x20\x09-\x0D]", text)
            codes.append("b" if not body else "d" if (role, text) in seen else "g" if body[-1] in ".!?" else "t")
            seen.add((role, text))
        initials = [(r or " ")[0] for _, r, _ in turns]
        cost, audit = cheapest(tuple(zip(initials, codes)))
        state, fixed, at = "", [], iter(turns)
        for step in audit:
            said = "a" if state == "u" else "u"
            _, role, text = next(at) if step != "I" else (0, "", "")
            if step == "D":
                continue
            role = role if step == "K" else {"u": "user", "a": "assistant"}[said]
            state = role[0]
            fixed.append((role, text))
        assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in fixed))
        numbers = [t for t, _, _ in turns if t is not None]
        out[conv] = (max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0, codes.count("b"), codes.count("d"),
                     codes.count("t"), sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
                     hashlib.sha256("\n".join(f"{r}:{t}" for r, t in fixed).encode()).hexdigest()), fixed
    return out


def of(row):
    return (row["gaps"], row["blank"], row["duplicate"], row["truncated"], row["illegal"], row["cost"], row["audit"], row["repaired_sha256"])


@pytest.fixture(scope="module")
def made():
    rng, rows = random.Random(3), []
    said = ["Fine.", "Why?", "cut off", " \n", "", None, "x" * 50_000 + "!", "Fine. \x0b", "ünï."]
    for conv in [*range(250), None]:
        for turn in range(rng.randrange(1, 12)):
            turn = rng.choice([turn] * 8 + [turn - 1, None])
            rows.append((conv, turn, rng.choice(["user", "assistant"] * 4 + ["system", "tool", "", None, "User"]), rng.choice(said)))
            if rng.random() < 0.1:
                rows.append(rows[-1])
    return rows


@pytest.mark.parametrize("block", [3, 1024])
def test_repairs_are_the_cheapest(spark, made, block, monkeypatch):
    monkeypatch.setattr(cv, "BLOCK", block)
    table = spark.createDataFrame([(*r, "c", 1, "h") for r in made], SHAPE).repartition(3)
    turns = cv.damaged(table)
    audits = cv.cut(cv.audits(turns))
    found, want = {r["conv_id"]: of(r) for r in cv.digests(turns, audits).collect()}, expected(made)
    assert found == {k: v for k, (v, _) in want.items()}
    own = {}
    for r in cv.repaired(turns, audits).orderBy("place").collect():
        own.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    assert own == {k: v for k, (_, v) in want.items() if v}
    assert cv.digests(cv.damaged(table.limit(0)), cv.audits(cv.damaged(table.limit(0)))).count() == 0


def test_one_conversation_over_many_tasks_and_blocks(spark, monkeypatch):
    """One conversation holds nearly all rows; it is dealt over several tasks and cut into blocks in them."""
    monkeypatch.setattr(cv, "BLOCK", 16)
    rng = random.Random(9)
    rows = [(7, k, rng.choice(["user", "assistant", "assistant", "system"]), f"turn {k % 90}" + rng.choice([".", "?", ""])) for k in range(400)]
    rows += [(8, 0, "user", "Yes."), (9, 0, "assistant", "No.")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        turns = cv.damaged(table)
        found = {r["conv_id"]: of(r) for r in cv.digests(turns, cv.cut(cv.audits(turns))).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert found == {k: v for k, (v, _) in expected(rows).items()}


def test_bands_and_blocks_agree():
    rng = random.Random(1)
    for _ in range(300):
        turns, blocks = cv.Turns(), []
        size = rng.randrange(1, 6)
        own = [(rng.choice("uuaas t"), rng.choice("gggtbd")) for _ in range(rng.randrange(0, 14))]
        for k, (initial, code) in enumerate(own):
            turns.add(initial, code)
            if k % size == 0:
                blocks.append(cv.Turns())
            blocks[-1].add(initial, code)
        whole = cv.joined([cv.alignments(turns, cv.WHOLE)])
        assert whole == cheapest(tuple(own)) == cv.joined([cv.alignments(b, cv.ALL) for b in blocks])


def test_the_query_gives_the_contract(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = {r["conv_id"]: of(r) for r in QUERIES["op13_conversation_repair"](spark, SF).collect()}
    assert found == {k: v for k, (v, _) in expected(rows).items()}
