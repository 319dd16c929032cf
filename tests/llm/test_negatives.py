"""Hard negatives against a count over all pairs."""

import math
import random

import numpy as np
import pytest

from panelwright.llm import negatives as ng
from panelwright.llm.queries import QUERIES

SHAPE = "vec_id long, embedding array<double>, label int, v string, score int, slot string"


def brute(rows, anchors, n_positives=5, n_negatives=5):
    """rows: (id, label, ints). All pairs, by the contract."""
    def dot(a, b):
        return sum(x * y for x, y in zip(a, b))

    out = []
    own = {}
    for r in sorted(r for r in rows if anchors(r[0])):
        own.setdefault(r[0], r)
    for i, label, v in own.values():
        scored = sorted((-dot(v, w), j, m) for j, m, w in rows if j != i)
        for p, j, _ in [s for s in scored if s[2] == label][:n_positives]:
            fit = [s for s in scored if s[2] != label and 80 * -p <= 100 * -s[0] <= 100 * -p][:n_negatives]
            out += [(i, j, k, n, -p, -s) for k, (s, n, _) in enumerate(fit, 1)]
    return sorted(out)


def of(found):
    return sorted((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in found.collect())


def ints(table):
    return [(r["vec_id"], r["label"], r["v"]) for r in ng.whole_numbers(table).collect()]


@pytest.mark.parametrize("n, dims, labels", [(700, 20, 3), (60, 5, 12), (300, 33, 1)])
def test_all_pairs_agree(spark, monkeypatch, n, dims, labels):
    monkeypatch.setattr(ng, "ROWS", 64)
    monkeypatch.setattr(ng, "BLOCK_BYTES", 8 * dims * 100)
    monkeypatch.setattr(ng, "ANCHORS", 7)
    rng = random.Random(n)
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(4)]
    rows = []
    for i in range(n):
        v = [x + rng.gauss(0, 0.7) for x in rng.choice(centres)]
        if rng.random() < 0.05:
            v = v[:dims // 2]
        rows.append((i, v if i % 41 else [0.5] * dims, rng.randrange(labels), "v", 1, "s"))
    rows += [(1001, None, 1, "", 1, ""), (1100, [], 1, "", 1, ""), (None, [1.0], 0, "", 1, ""), (1200, [1.0, None], 0, "", 1, ""), (1300, [math.nan], 0, "", 1, ""),
             (1400, [math.inf], 0, "", 1, ""), (1500, [1.0] * dims, None, "", 1, ""), rows[3], rows[0], rows[41], (0, [9.0] * dims, labels, "", 1, "")]
    table = spark.createDataFrame(rows, SHAPE).repartition(3)
    own = ng.whole_numbers(table)
    found = of(ng.mine(own, own.where("vec_id % 10 = 0")))
    assert found == brute(ints(table), lambda i: i % 10 == 0) and (found or labels == 1)
    assert ng.mine(own.limit(0), own.limit(0)).count() == 0


def test_bounds_lose_nothing_and_spare_work():
    rng = np.random.default_rng(2)
    x = np.floor(rng.normal(0, 40, (500, 40)) * np.linspace(2, 0.1, 40))
    q = x[:9]
    exact = q @ x.T
    for floor in (-np.inf, 0.0, 8e4, 1.2e5):
        floors = np.full(9, floor)
        rows, scores = ng.survivors(q, ng.remaining(q), floors, x, ng.remaining(x))
        assert (scores == exact[:, rows]).all()
        assert set(np.flatnonzero((exact >= floor).any(axis=0))) <= set(rows)
    assert len(rows) < 100


def test_the_query_gives_the_contract(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(i, (m + 1) % 10 if i % 7 == 0 else m, v) for i, m, v in ints(table)]
    assert of(QUERIES["op12_hard_negatives"](spark, sf)) == brute(rows, lambda i: i % 100 == 0)
