"""Near copies against a brute-force count of shared shingles."""

import collections
import random

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from panelwright.llm import near, simhash

SF = "/root/testdata/sf0.001"


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))}


def brute(texts):
    """Root of each text: the least number that links of 0.8 or more lead to."""
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    pairs = set()
    for i, a in enumerate(sets):
        for j in range(i):
            if 9 * len(a & sets[j]) >= 4 * (len(a) + len(sets[j])):
                pairs.add((j, i))
                root[max(top(i), top(j))] = min(top(i), top(j))
    return [top(i) for i in range(len(texts))], pairs


def made():
    """Texts with copies in which words were exchanged, near and beyond 0.8, and chains of such copies."""
    rng, out = random.Random(4), [None, "", " \n", "one two", "One  two", "one two three"]
    for n in (30, 100, 300, 900):
        for _ in range(6):
            base = [f"w{rng.randrange(5000)}" for _ in range(n)]
            out.append(" ".join(base))
            for share in (0.005, 0.01, 0.02, 0.022, 0.025, 0.03, 0.05):
                own = list(base)
                for k in rng.sample(range(n), max(1, round(share * n))):
                    own[k] = f"x{rng.randrange(5000)}"
                out.append(" ".join(own))
            for k in range(1, 4):  # a chain: each link is near, its ends aren't
                out.append(" ".join(base[k * n // 12:] + [f"y{i}" for i in range(k * n // 12)]))
    return out


@pytest.mark.parametrize("piece", [3, 256])
def test_near_copies_are_those_of_a_brute_force_count(spark, monkeypatch, piece):
    monkeypatch.setattr(near, "PIECE", piece)
    texts = made()
    roots, pairs = brute(texts)
    assert len(pairs) > 150
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = collections.defaultdict(set)
    for r in near.groups(docs).collect():
        found[r["root"]].add(r["doc_id"])
    expected = collections.defaultdict(set)
    for i, r in enumerate(roots):
        expected[r].add(i)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, expected.values()))
    assert near.groups(docs.limit(0)).count() == 0


def test_no_pair_of_a_large_group_is_lost(spark):
    """A chain of texts that share buckets in plenty, of which only neighbours are near."""
    rng = random.Random(6)
    base, texts = [f"w{rng.randrange(10 ** 6)}" for _ in range(200)], []
    for i in range(120):
        for k in rng.sample(range(200), 3):
            base[k] = f"x{rng.randrange(10 ** 6)}"
        texts.append(" ".join(base))
    roots, _ = brute(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = collections.defaultdict(set)
    for r in near.groups(docs).collect():
        found[r["root"]].add(r["doc_id"])
    expected = collections.defaultdict(set)
    for i, r in enumerate(roots):
        expected[r].add(i)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, expected.values()))


def test_a_piece_gives_out_fewer_rows_than_members():
    """All pairs of a piece are likely ones: what binds them is given out, not their number squared."""
    low = np.random.default_rng(1).integers(0, 256, near.FUNCTIONS, np.uint8).tobytes()
    sides = [[{"id": i, "root": i, "size": 50, "apart": True, "low": low} for i in range(a, b)] for a, b in ((0, 60), (0, 90))]
    kind = pa.list_(pa.struct([("id", pa.int64()), ("root", pa.int64()), ("size", pa.int64()), ("apart", pa.bool_()), ("low", pa.binary())]))
    batch = pa.RecordBatch.from_arrays([pa.array([x], kind) for x in sides], names=["out", "every"])
    bound = [(r["a"], r["b"]) for part in near._crossed([batch]) for r in part.to_pylist()]
    assert len(bound) == 89
    assert {x for pair in bound for x in pair} == set(range(90))


def test_pairs_of_a_group_that_is_not_similar_are_left_apart(spark):
    """Copies of one text at about 0.6 to one another, among them few that are near."""
    rng = random.Random(9)
    base, texts = [f"w{rng.randrange(10 ** 6)}" for _ in range(150)], []
    for _ in range(150):
        own = list(base)
        for k in rng.sample(range(150), 6):
            own[k] = f"x{rng.randrange(10 ** 6)}"
        texts.append(" ".join(own))
    roots, pairs = brute(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = collections.defaultdict(set)
    for r in near.groups(docs).collect():
        found[r["root"]].add(r["doc_id"])
    expected = collections.defaultdict(set)
    for i, r in enumerate(roots):
        expected[r].add(i)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, expected.values()))


def test_the_stage_keeps_one_of_each_group(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    roots, _ = brute([t for _, t in rows])
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()}
    assert kept == {rows[r][0] for r in roots}


def test_components_hold_few_edges_in_few_partitions(spark, monkeypatch):
    """Every task leaves files: rounds over a few edges don't go over all shuffle partitions."""
    held = []

    def cut(df, kept=simhash.cut):
        held.append(df.rdd.getNumPartitions())
        return kept(df)

    monkeypatch.setattr(simhash, "cut", cut)
    names = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        found = simhash.components(spark.createDataFrame([(i, i + 1) for i in range(40) if i % 8], "a long, b long"))
        assert {r["node"]: r["root"] for r in found.collect()} == {i: (i - 1) // 8 * 8 + 1 for i in range(1, 41)}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(held) > 2 and max(held[1:]) == 1
