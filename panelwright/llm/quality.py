"""Quality by weak supervision: rules vote or abstain, EM estimates their accuracies, a posterior decides.

DataFrame functions only. `statistics` counts per text, `vote` turns counts into votes, `fit` estimates from the
number of documents per pattern of votes (at most 3 ** len(RULES) rows, whatever the input), `judge` gives each
document its posterior probability of being good. No step shuffles more than those patterns.

Defined cases: a null text counts as empty; an empty table gives an empty result and the starting accuracies;
repeated rows are judged each on its own; columns of other names are ignored, and a clashing name of an output column
is never read from the input. Words are compared in 5-word windows by a 64-bit hash packed with the place; candidates
that are neighbours in hash order are confirmed by comparing the words.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import product
from math import exp, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import numbered, text_of

SYMBOLS = "#*$%&|<>"
WINDOW = 5
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_shouts")


def _repeats(t: str) -> list[tuple[str, Column]]:
    """Steps from words (`t`_words) to the number of words in windows that occur twice or more."""
    hashes, packed, places = F.col(f"{t}_hashes"), F.col(f"{t}_packed"), F.col(f"{t}_places")
    windows = F.col(f"{t}_windows")
    words, n, bits = F.col(f"{t}_words"), F.col(f"{t}_n"), F.col(f"{t}_bits")
    low = F.expr(f"shiftleft(1L, {t}_bits) - 1L")

    def window(i: Column) -> Column:
        return F.xxhash64(*(F.get(hashes, i + k) for k in range(WINDOW)))

    def same(x: Column, y: Column) -> Column:
        """Equal hashes first: only then are the words of both windows compared."""
        place = [F.slice(words, z.bitwiseAND(low).cast("int") + 1, WINDOW) for z in (x, y)]
        alike = F.call_function("shiftrightunsigned", x, bits) == F.call_function("shiftrightunsigned", y, bits)
        return F.coalesce(F.when(alike, place[0] == place[1]), F.lit(False))

    empty = F.array().cast("array<bigint>")
    return [
        (f"{t}_bits", F.length(F.bin(n))),
        (f"{t}_hashes", F.transform(words, lambda w: F.xxhash64(w))),
        (f"{t}_windows", F.when(n < WINDOW, empty).otherwise(F.transform(
            F.sequence(F.lit(0), F.greatest(n - WINDOW, F.lit(0))), window))),
        # Most texts have no equal windows; only the others are sorted.
        (f"{t}_packed", F.when(F.size(F.array_distinct(windows)) == F.size(windows), empty).otherwise(F.sort_array(
            F.transform(windows, lambda x, i: x.bitwiseAND(F.bitwise_not(low)).bitwiseOR(i.cast("bigint")))))),
        (f"{t}_places", F.sort_array(F.transform(
            F.filter(packed, lambda x, i: same(x, F.get(packed, i - 1)) | same(x, F.get(packed, i + 1))),
            lambda x: x.bitwiseAND(low)))),
        ("n_repeat_words", F.aggregate(
            F.transform(places, lambda p, i: F.least(F.lit(WINDOW).cast("bigint"),
                                                    F.coalesce(F.get(places, i + 1) - p, F.lit(WINDOW).cast("bigint")))),
            F.lit(0).cast("bigint"), lambda a, b: a + b)),
    ]


def statistics(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The `keep` columns and COUNTS (long) of every whole text."""
    t = "_q"
    while any(c.lower().startswith(t) for c in docs.columns):
        t += "q"
    own = [F.col(c).alias(f"{t}keep{i}") for i, c in enumerate(keep)]
    kept = [f"{t}keep{i}" for i in range(len(keep))]
    body, lines = F.col(f"{t}_text"), F.col(f"{t}_lines")
    df = docs.select(*own, text_of(text).alias(f"{t}_text"))
    df = df.select(*kept, f"{t}_text",
                   F.filter(F.split(body, "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != "").alias(f"{t}_words"),
                   F.filter(F.split(body, "\n"), lambda x: x.rlike("[^ \\t\\n\\x0B\\f\\r]")).alias(f"{t}_lines"))
    df = df.select(
        *kept, f"{t}_words", F.size(f"{t}_words").alias(f"{t}_n"), F.size(f"{t}_words").cast("bigint").alias("n_words"),
        F.length(F.array_join(f"{t}_words", "")).cast("bigint").alias("word_chars"),
        F.regexp_count(body, F.lit(f"[{SYMBOLS}]")).cast("bigint").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint").alias("n_dup_lines"),
        F.size(lines).cast("bigint").alias("n_lines"),
        F.regexp_count(body, F.lit("[A-Z]")).cast("bigint").alias("n_upper"),
        (F.length(body) - F.length(F.replace(body, F.lit("!"), F.lit("")))).cast("bigint").alias("n_shouts"))
    for name, column in _repeats(t):
        df = df.select("*", column.alias(name))
    # A row's number keeps a later filter above these steps; moved below, it would take them anew for each word.
    above = F.least(F.monotonically_increasing_id(), F.lit(0).cast("bigint"))  # zero
    return df.select(*(F.col(k).alias(c) for k, c in zip(kept, keep, strict=True)),
                     *((F.col(c) + above).alias(c) if c == "n_repeat_words" else F.col(c) for c in COUNTS))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _three(bad: Column, good: Column) -> Column:
    """1: good, -1: bad, 0: abstains."""
    return F.when(bad, -1).when(good, 1).otherwise(0)


def rules() -> dict[str, Column]:
    """Votes by name, from COUNTS."""
    n, chars, lines = F.col("n_words"), F.col("word_chars"), F.col("n_lines")
    return {
        "length": _three(n < 10, n >= 50),
        "word_length": _three((chars < 3 * n) | (chars > 12 * n), (10 * chars >= 42 * n) & (chars <= 10 * n)),
        "symbols": _three(10 * F.col("n_symbols") > n, 100 * F.col("n_symbols") <= n),
        "lines": _three(10 * F.col("n_dup_lines") > 3 * lines, (F.col("n_dup_lines") == 0) & (lines >= 2)),
        "repeats": _three(100 * F.col("n_repeat_words") > 20 * n, 100 * F.col("n_repeat_words") <= 5 * n),
        "capitals": _three(10 * F.col("n_upper") > 3 * chars, 10 * F.col("n_upper") <= chars),
        "shouting": _three(10 * F.col("n_shouts") > n, 100 * F.col("n_shouts") <= n),
    }


#: As in rules(), in that order; named apart, as columns need a session.
RULES = ("length", "word_length", "symbols", "lines", "repeats", "capitals", "shouting")


GOOD = "good"


@dataclass(frozen=True)
class Model:
    """share: of each class among documents; bad: for each class and rule the chance that a vote is a bad one.

    Classes are good and one fault for each rule, as a bad document mostly shows one fault of many.
    """

    share: dict[str, float]
    bad: dict[str, dict[str, float]]

    def chances(self, pattern: tuple[int, ...]) -> dict[str, float]:
        """Probability of each class, given the votes. Abstaining rules say nothing."""
        logs = {c: log(share) + sum(log(self.bad[c][r] if v == -1 else 1 - self.bad[c][r])
                                    for r, v in zip(RULES, pattern, strict=True) if v) for c, share in self.share.items()}
        top = max(logs.values())
        each = {c: exp(x - top) for c, x in logs.items()}
        return {c: x / sum(each.values()) for c, x in each.items()}

    def posterior(self) -> Column:
        """Probability that a document with these COUNTS is good: looked up by its votes, read as digits of base 3."""
        good = ",".join(f"{self.chances(p)[GOOD]!r}D" for p in product((-1, 0, 1), repeat=len(RULES)))
        code = reduce(lambda a, b: 3 * a + b, (v + 1 for v in rules().values()))
        return F.element_at(F.expr(f"array({good})"), code + 1)


def _start() -> Model:
    """Rules are taken to be right on 199 of 200 good documents, and on 9 of 10 with their own fault."""
    share = {GOOD: 1 - 0.03 * len(RULES)} | dict.fromkeys(RULES, 0.03)
    return Model(share, {c: {r: 0.005 if c == GOOD else 0.9 if c == r else 0.1 for r in RULES} for c in share})


def _held(c: str, r: str, p: float) -> float:
    """A rule is right on 99 of 100 good documents at least, and on half of those with its fault; this keeps the classes
    what they are called."""
    low, high = (0.0005, 0.01) if c == GOOD else (0.5, 0.999) if c == r else (0.001, 0.99)
    return min(high, max(low, p))


def fit(counts: DataFrame, rounds: int = 40) -> Model:
    """EM over the patterns of votes of all rows of `counts`; only their numbers come to the driver. Each chance is
    smoothed by ten votes as at the start."""
    votes, model = rules(), _start()
    patterns = [(tuple(row[r] for r in RULES), row["n"]) for row in
                counts.select(*(v.alias(r) for r, v in votes.items())).groupBy(*RULES).agg(F.count("*").alias("n")).collect()]
    total, first = sum(n for _, n in patterns), model
    for _ in range(rounds if total else 0):
        weight = dict.fromkeys(model.share, 0.0)
        voted = {c: dict.fromkeys(RULES, 10.0) for c in weight}
        bad = {c: {r: 10 * first.bad[c][r] for r in RULES} for c in weight}
        for pattern, n in patterns:
            for c, x in model.chances(pattern).items():
                weight[c] += n * x
                for r, v in zip(RULES, pattern, strict=True):
                    if v:
                        voted[c][r] += n * x
                        bad[c][r] += n * x * (v == -1)
        model = Model({c: max(1e-6, w / total) for c, w in weight.items()},
                      {c: {r: _held(c, r, bad[c][r] / voted[c][r]) for r in RULES} for c in weight})
    return model


def judge(counts: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """`counts` with posterior, base_failed and kept: not failed, and good with a probability of `least` or more."""
    return counts.withColumns({"posterior": model.posterior(), "base_failed": base_failed()}).withColumn(
        "kept", ~F.col("base_failed") & (F.col("posterior") >= least))


def keep(docs: DataFrame, counts: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of `docs` that `judge` keeps, columns unchanged. The model comes from `counts` of the same documents;
    the counts of a row are made again beside its text, which costs a second reading and no shuffle."""
    own, names, old = numbered(docs)
    return judge(statistics(own, keep=names), fit(counts), least).where("kept").select(*old)
