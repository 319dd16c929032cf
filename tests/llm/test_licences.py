"""Licence scans against a search of every phrase at every place."""

import math
import random
import re

from panelwright.llm import licences as li
from panelwright.llm.queries import QUERIES

SHAPE = "doc_id long, text string, base string, matches int, n_words string, utf8 int"
TEXTS = [None, "", " \n", "Released under the MIT License.", "MIT-license mit License", "the mit", "Licensed under the Apache License, Version 2.0.",
         "Apache License v2", "This work is licensed under the GNU General Public License, version 3.", "gnu general public license, or any later version 3",
         "GNU Lesser General Public License", "Licensed under CC BY-NC 4.0. Licensed under CC BY-NC-SA 4.0",
         "cc by nc one two three four five six seven 4 0", "Permission is hereby granted, free of charge, to any person, to deal in the Software without restriction",
         li.TEMPLATES[1].text, "permission is hereby granted " + "word " * 60 + "to deal in the software without restriction",
         "no licence here, a general public", "public license general public license general public license", "ſ MIT\x00License", "É mit license é" + " mit license" * 500,
         "x " * 70_000 + "mit license"]


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(texts):
    split = [words(t) for t in texts]
    known = {w for t in li.TEMPLATES for w in words(t.text)} | {w for p in li.BASE for w in p.split()}
    weight = {w: 1 + math.log((1 + len(texts)) / (1 + sum(w in s for s in split))) for w in known}
    out = []
    for own in split:
        def at(phrase):
            phrase = phrase.split()
            return [i for i in range(len(own) - len(phrase) + 1) if own[i:i + len(phrase)] == phrase]
        base = [(p, label) for phrase, label in li.BASE.items() for p in at(phrase)]
        labels, score = {x for _, x in base}, 0.0
        for t in li.TEMPLATES:
            tw = words(t.text)
            offs = [next(i for i in range(len(tw)) if tw[i:i + len(k.split())] == k.split()) for k in t.keys]
            places = [at(k) for k in t.keys]
            for p in places[0]:
                a = p - offs[0]
                if all(any(abs(x - o - a) <= li.SLACK for x in ps) for o, ps in zip(offs, places)):
                    labels.add(t.label)
                    seen = sum(weight[w] for q, w in enumerate(tw) if w in own[max(0, a + q - li.SLACK):max(0, a + q + li.SLACK + 1)])
                    score = max(score, seen / sum(weight[w] for w in tw))
        starts = [p for p, _ in base]
        out.append((len(own), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in base})),
                    ",".join(sorted(labels)), round(score, 6)))
    return out


def test_every_place_is_found(spark):
    rng, texts = random.Random(2), list(TEXTS)
    pool = sorted({w for t in li.TEMPLATES for w in t.words}) + ["other"] * 10
    for _ in range(120):  # templates with words dropped, added and changed, and words of templates in any order
        t = rng.choice(li.TEMPLATES).text.split()
        for _ in range(rng.randrange(4)):
            t[rng.randrange(len(t)):rng.randrange(len(t)) + 1] = [rng.choice(pool)] * rng.randrange(3)
            t = t or ["mit"]
        texts.append(" ".join(rng.choices(pool, k=20) + t + rng.choices(pool, k=20)))
    rows = [(i if i != 3 else None, t, "b", 1, "n", 2) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, rows[6]], SHAPE).repartition(3)
    want = dict(zip([r[0] for r in rows], brute([*texts, texts[6]])))
    found = li.scan(docs, li.weights(docs)).collect()
    assert len(found) == len(rows) + 1
    for r in found:
        starts = [b["start"] for b in r["base"]]
        assert want[r["doc_id"]] == (
            r["n_words"], len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted({b["label"] for b in r["base"]})),
            ",".join(sorted({b["label"] for b in r["base"]} | {m["label"] for m in r["matches"]})),
            round(max((m["coverage"] for m in r["matches"]), default=0.0), 6))
    assert li.scan(docs.limit(0), li.weights(docs.limit(0))).count() == 0


def test_the_query_gives_the_contract(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = dict(zip([r["doc_id"] for r in rows], brute([r["text"] for r in rows])))
    for r in QUERIES["op11_license_scans"](spark, sf).collect():
        assert want[r["doc_id"]] == (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"], r["score"])
