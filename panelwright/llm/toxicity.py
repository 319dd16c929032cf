"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Labels are of documents, so tokens are labelled first: in documents that are labelled toxic, the tokens with a word or
prefix that sets such documents apart. The field has two states, weights for words and prefixes, and transitions; it is
fitted by gradient ascent on segments of tokens. Forward-backward marginals of a text's tokens give its offending spans,
and, by their maximum and sum, the document's score for its length, calibrated on the document labels.

Fitting takes a bounded sample: MAX_DOCS labelled documents (least hash of the id), MAX_FEATURES features, MAX_SEGMENTS
segments of SEGMENT tokens. Counting features of the sample is a Spark job; only what these bounds hold comes to the
driver. Scoring is a map over all documents, whole texts, whose memory follows the longest text.

Defined cases: null and empty texts have no tokens and the score of a text without evidence; labels that are null, or of
no document, are ignored; a document with several labels is toxic if one says so; without toxic labels all scores are the
smoothed share of toxic ones; repeated rows are scored each; an empty table gives an empty result. Other columns are
never read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from math import exp, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import cut, parts, text_of

MAX_DOCS, MAX_FEATURES, MAX_SEGMENTS, SEGMENT = 20_000, 4000, 8000, 64
PREFIXES = (3, 4, 5, 6)
#: Least evidence of a feature (twice the log-likelihood ratio), its least toxic documents, and their least share.
EVIDENCE, SUPPORT, PURITY = 40.0, 4, 0.8
WORD = r"[^\W\d_]+"


def features_of(word: str) -> list[str]:
    """The word, and its prefixes, marked by their length."""
    return [f"w{word}", *(f"{n}{word[:n]}" for n in PREFIXES if len(word) > n)]


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


@dataclass(frozen=True)
class Field:
    """Log weights: of features, of the toxic state itself, from state to state (turn[a][b]), and of a toxic start.
    `line`: base, and weights of the largest marginal's log odds, of the log of the marginals' sum, and of the log of the
    number of tokens."""

    weights: dict[str, float]
    bias: float
    turn: tuple[tuple[float, float], tuple[float, float]]
    start: float
    line: tuple[float, float, float, float]


def words_of(text: str) -> list[str]:
    """The text's own words, each in lower case: as many as their places, also where lower case changes a length."""
    low = text.lower()
    return re.findall(WORD, low) if len(low) == len(text) else [w.lower() for w in re.findall(WORD, text)]


class Tagger:
    def __init__(self, field: Field):
        self.field, self.word, self.plain = field, re.compile(WORD), {}
        self.heads = {f[1:][:min(PREFIXES)] for f in field.weights}
        self.boost = exp(field.bias)
        self.turn = [[exp(x) for x in row] for row in field.turn]

    def _weight(self, word: str) -> float:
        """exp of what the word's features say; 1 for none."""
        if word[:min(PREFIXES)] not in self.heads:
            return 1.0
        return exp(min(60.0, sum(self.field.weights.get(f, 0.0) for f in features_of(word))))

    def _marginals(self, said: list[float]) -> list[float]:
        """Of the toxic state, for each token; as odds of the two states, forward and back."""
        (oo, ot), (to, tt) = self.turn
        odds = [0.0] * len(said)
        r = exp(self.field.start) * said[0] * self.boost
        odds[0] = r
        for i in range(1, len(said)):
            odds[i] = r = said[i] * self.boost * (ot + r * tt) / (oo + r * to)
        b = 1.0
        for i in range(len(said) - 2, -1, -1):
            x = said[i + 1] * self.boost * b
            b = (to + tt * x) / (oo + ot * x)
            odds[i] *= b
        return [x / (1 + x) if x < 1e300 else 1.0 for x in odds]

    def evidence(self, text: str) -> tuple[float, float, int, list[dict[str, int]]]:
        """The largest marginal, their sum, their number, and the spans of tokens more likely toxic than not."""
        words = words_of(text)
        if not words:
            return 0.0, 0.0, 0, []
        said = [self._weight(w) if w[:3] in self.heads else 1.0 for w in words]
        if max(said) == min(said) == 1.0:  # the same for all texts of this length
            if len(words) not in self.plain:
                marginals = self._marginals(said)
                self.plain[len(words)] = (max(marginals), sum(marginals))
            return *self.plain[len(words)], len(words), []
        marginals = self._marginals(said)
        spans: list[dict[str, int]] = []
        if max(marginals) >= 0.5:
            for i, (m, p) in enumerate(zip(self.word.finditer(text), marginals, strict=True)):
                if p >= 0.5:
                    if spans and spans[-1]["last"] == i - 1:
                        spans[-1] |= {"end": m.end(), "last": i}
                    else:
                        spans.append({"start": m.start(), "end": m.end(), "last": i})
        return max(marginals), sum(marginals), len(words), spans

    def score(self, most: float, total: float, tokens: int) -> float:
        return _logistic(sum(a * b for a, b in zip(self.field.line, _line(most, total, tokens), strict=True)))


def _logistic(x: float) -> float:
    return 1 / (1 + exp(-max(-500.0, min(500.0, x))))


def _line(most: float, total: float, tokens: int) -> tuple[float, float, float, float]:
    held = min(1 - 1e-6, max(1e-6, most))
    return 1.0, log(held / (1 - held)), log(total + 1e-3), log(tokens + 10)


def labelled(docs: DataFrame, labels: DataFrame, limit: int = MAX_DOCS) -> DataFrame:
    """text and toxic (0 or 1) of at most `limit` labelled documents that aren't held out."""
    own = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(
        F.max(F.col("toxic").cast("int")).alias("toxic"))
    some = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)  # at most `limit` narrow rows, so broadcast
    return docs.select("doc_id", text_of().alias("body")).join(F.broadcast(some), "doc_id").select("body", "toxic")


def evidence(sample: DataFrame, limit: int = MAX_FEATURES) -> dict[str, float]:
    """Features that set toxic documents apart, strongest first, with their evidence."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 64):
            words, toxic = [], []
            for text, says in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = set(words_of(text))
                words += own
                toxic += [says] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(toxic, pa.int32())], names=["word", "toxic"])

    words = sample.mapInArrow(run, "word string, toxic int").groupBy("word").agg(
        F.sum("toxic").alias("t"), F.count("*").alias("n"))
    size = F.length("word")
    each = F.array(F.concat(F.lit("w"), "word"), *(
        F.when(size > n, F.concat(F.lit(str(n)), F.substring("word", 1, n))) for n in PREFIXES))
    found = words.select(F.explode(each).alias("feature"), "t", "n").where("feature is not null").groupBy("feature").agg(
        F.sum("t").alias("t"), F.sum("n").alias("n"))
    all_toxic, all_ = sample.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count("*")).first()
    if not 0 < all_toxic < all_:
        return {}
    share = all_toxic / all_
    own = F.col("t") / F.col("n")
    ratio = 2 * (F.col("t") * F.log(own / share) + F.when(F.col("t") < F.col("n"), (F.col("n") - F.col("t")) * F.log((1 - own) / (1 - share))).otherwise(0.0))
    strong = found.where((F.col("t") >= SUPPORT) & (own > PURITY)).withColumn("evidence", ratio).where(F.col("evidence") >= EVIDENCE)
    return {r["feature"]: r["evidence"] for r in strong.orderBy(F.desc("evidence"), "feature").limit(limit).collect()}


def segments(sample: DataFrame, features: dict[str, float], limit: int = MAX_SEGMENTS) -> list[tuple[list[str], list[int]]]:
    """Tokens and token labels of segments: half of those with a toxic token, half of the others, at most."""
    known = frozenset(features)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 64):
            tokens, marks, some = [], [], []
            for text, says in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(text)
                for at in range(0, len(words), SEGMENT):
                    own = words[at:at + SEGMENT]
                    tokens.append(own)
                    marks.append([int(bool(says) and not known.isdisjoint(features_of(w))) for w in own])
                    some.append(max(marks[-1]))
            yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.list_(pa.string())), pa.array(marks, pa.list_(pa.int32())),
                                              pa.array(some, pa.int32())], names=["tokens", "marks", "some"])

    found = cut(sample.mapInArrow(run, "tokens array<string>, marks array<int>, some int").withColumn("order", F.xxhash64("tokens")))
    out, many = [], {r["some"]: r["n"] for r in found.groupBy("some").agg(F.count("*").alias("n")).collect()}
    for some in (1, 0):
        # About half more than are taken come to the driver, not the limit from each task.
        share = 1.5 * (limit // 2) / max(1, many.get(some, 0)) + 0.001
        near = found.where((F.col("some") == some) & (F.pmod("order", F.lit(1_000_000)) < 1_000_000 * share))
        rows = near.orderBy(F.pmod("order", F.lit(1_000_000)), "order").limit(limit // 2).select("tokens", "marks").collect()
        out += [(r["tokens"], r["marks"]) for r in rows]
    return out


def fitted(data: list[tuple[list[str], list[int]]], features: dict[str, float], rounds: int = 120) -> Field:
    """Gradient ascent on the log-likelihood of the token labels, with a small penalty on weights."""
    place = {f: i for i, f in enumerate(features)}
    n, long = len(data), max((len(t) for t, _ in data), default=0)
    active, marks, at_token, at_feature = np.zeros((n, long), bool), np.zeros((n, long)), [], []
    for s, (tokens, own) in enumerate(data):
        active[s, :len(tokens)], marks[s, :len(own)] = True, own
        for t, word in enumerate(tokens):
            for f in features_of(word):
                if f in place:
                    at_token.append(s * long + t), at_feature.append(place[f])
    at_token, at_feature = np.array(at_token, np.int64), np.array(at_feature, np.int64)
    states = np.stack((1 - marks, marks), 2) * active[..., None]
    weights, other = np.zeros(len(place)), np.zeros(6)  # bias, turns oo ot to tt, start
    other[0] = -4.0
    speed = [np.full(len(place), 1e-8), np.full(6, 1e-8)]
    pairs = active[:, 1:]
    seen = np.array([states[..., 1].sum(), *((states[:, :-1, a] * states[:, 1:, b] * pairs).sum() for a in (0, 1) for b in (0, 1)),
                     states[:, 0, 1].sum() if long else 0.0])
    seen_w = np.bincount(at_feature, states[..., 1].ravel()[at_token], len(place))
    for _ in range(rounds if n else 0):
        says = np.bincount(at_token, weights[at_feature], n * long).reshape(n, long) + other[0]
        push = np.stack((np.ones_like(says), np.exp(np.clip(says, -50, 50))), 2)
        turn = np.exp(other[1:5]).reshape(2, 2)
        ahead, back = np.zeros((n, long, 2)), np.ones((n, long, 2))
        ahead[:, 0] = push[:, 0] * np.array([1.0, np.exp(other[5])])
        ahead[:, 0] /= ahead[:, 0].sum(1, keepdims=True)
        for t in range(1, long):
            x = (ahead[:, t - 1] @ turn) * push[:, t]
            ahead[:, t] = np.where(active[:, t, None], x / x.sum(1, keepdims=True), ahead[:, t - 1])
        for t in range(long - 2, -1, -1):
            x = (push[:, t + 1] * back[:, t + 1]) @ turn.T
            back[:, t] = np.where(active[:, t + 1, None], x / x.sum(1, keepdims=True), 1.0)
        both = ahead * back
        both /= both.sum(2, keepdims=True)
        both *= active[..., None]
        moves = ahead[:, :-1, :, None] * turn * (push[:, 1:] * back[:, 1:])[:, :, None, :]
        moves = moves / moves.sum((2, 3), keepdims=True) * pairs[..., None, None]
        expected = np.array([both[..., 1].sum(), *moves.sum((0, 1)).ravel(), both[:, 0, 1].sum()])
        expected_w = np.bincount(at_feature, both[..., 1].ravel()[at_token], len(place))
        for x, up, s in ((weights, seen_w - expected_w - 0.5 * weights, speed[0]), (other, seen - expected - 0.1 * other, speed[1])):
            s += up * up
            x += 0.5 * up / np.sqrt(s)
    t = other[1:5].tolist()
    return Field({f: float(weights[i]) for f, i in place.items()}, float(other[0]), ((t[0], t[1]), (t[2], t[3])), float(other[5]),
                 (0.0, 1.0, 0.0, 0.0))


def calibrated(field: Field, sample: DataFrame, rounds: int = 30) -> Field:
    """The field with a line fitted to the sample's labels by Newton steps; the line's slopes aren't negative."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(field)
        for batch in parts(batches):
            most, total, tokens, _ = zip(*map(tagger.evidence, batch.column(0).to_pylist()))
            yield pa.RecordBatch.from_arrays([pa.array(most, pa.float64()), pa.array(total, pa.float64()), pa.array(tokens, pa.int64()),
                                              batch.column(1)], names=["most", "total", "tokens", "toxic"])

    # Four numbers for each of MAX_DOCS.
    rows = sample.mapInArrow(run, "most double, total double, tokens long, toxic int").collect()
    y = np.array([r["toxic"] for r in rows], float)
    share = (y.sum() + 0.5) / (len(y) + 1)
    base = (log(share / (1 - share)), 0.0, 0.0, 0.0)
    if not field.weights or not 0 < y.sum() < len(y):
        return Field(field.weights, field.bias, field.turn, field.start, base)
    x = np.array([_line(r["most"], r["total"], r["tokens"]) for r in rows])
    for columns in ((0, 1, 2, 3), (0, 2, 3), (0, 1, 2), (0, 2), (0,)):
        w, own = np.zeros(len(columns)), x[:, columns]
        w[0] = base[0]
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(own @ w, -30, 30)))
            slope = own.T @ (y - p) - 0.5 * w * (np.arange(len(w)) > 0)
            bend = (own * (p * (1 - p))[:, None]).T @ own + np.diag([1e-6, *[0.5] * (len(w) - 1)])
            step = np.linalg.solve(bend, slope)
            w += step * min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
        if all(a >= 0 for i, a in zip(columns, w) if i in (1, 2)):
            break
    line = dict(zip(columns, w.tolist()))
    return Field(field.weights, field.bias, field.turn, field.start, tuple(line.get(i, 0.0) for i in range(4)))


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS) -> Field:
    sample = cut(labelled(docs, labels, max_docs))
    features = evidence(sample)
    return calibrated(fitted(segments(sample, features) if features else [], features), sample)


def score(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, score and spans (start and end of each toxic stretch of tokens, code points) of every document."""
    source = docs.select("doc_id", text_of().alias("body"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(field)
        shape = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in parts(batches):
            found = [tagger.evidence(t) for t in batch.column(1).to_pylist()]
            spans = [[{"start": s["start"], "end": s["end"]} for s in f[-1]] for f in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([tagger.score(*f[:-1]) for f in found], pa.float64()),
                                              pa.array(spans, shape)], names=["doc_id", "score", "spans"])

    return source.mapInArrow(run, f"doc_id {kind}, score double, spans array<struct<start: bigint, end: bigint>>")
