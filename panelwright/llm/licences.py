"""Licence scans by a positional index of rare words.

A template is the wording of a licence notice with key phrases that must stand in it. Every phrase is indexed under its
rarest word, by the inverse document frequency over all documents, with that word's place in it. In a text the licence
words are looked up from the rarest down: a word's postings give candidate starts of phrases, which are intersected with
the places of the phrase's other words, next rarest first, shifted by their relative positions. What is left are the
phrase's occurrences. A template is found where its first key phrase stands and all its other key phrases stand where the
template has them, give or take SLACK words. Its coverage is the weight (inverse document frequency) of the template's
words that stand in their places, give or take SLACK, as a share of the weight of all of them.

The index and the frequencies have the size of the templates; texts are read twice, where they are, and nothing is
shuffled but a count for each word of the templates and task.

Defined cases: null, empty and blank texts have no words and no labels; a text may have any number of matches, and all are
counted, also in very long texts; repeated rows keep a row each, null ids are allowed; an empty table gives an empty
result. Other columns are ignored.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import parts, utf8_of
from panelwright.llm.decontaminate import words_of

#: Phrases that give a label wherever they stand.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Words by which a key phrase may stand off its place in the template.
SLACK = 4


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    keys: tuple[str, ...]

    @property
    def words(self) -> tuple[str, ...]:
        return tuple(w.decode() for w in words_of(self.text.encode()))

    def places(self) -> list[tuple[int, tuple[str, ...]]]:
        """Each key phrase with its place in the template."""
        words, out = self.words, []
        for key in self.keys:
            own = tuple(key.split())
            out.append((next(i for i in range(len(words)) if words[i:i + len(own)] == own), own))
        return out


# The usual wording of licence notices, and the phrases that must stand in them.
TEMPLATES = (
    Template("mit", "Released under the MIT License", ("mit license",)),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
             "files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, "
             "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
             ("permission is hereby granted", "to deal in the software without restriction")),
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache license version 2 0",)),
    Template("apache", "Licensed under the Apache License", ("apache license",)),
    Template("gpl", "This work is licensed under the GNU General Public License", ("general public license",)),
    Template("gpl-3.0", "This work is licensed under the GNU General Public License, version 3", ("gnu general public license", "version 3")),
    Template("gpl-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License "
             "as published by the Free Software Foundation; either version 2 of the License", ("gnu general public license", "version 2")),
    Template("lgpl", "under the terms of the GNU Lesser General Public License", ("gnu lesser general public license",)),
    Template("agpl", "under the terms of the GNU Affero General Public License", ("gnu affero general public license",)),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
             "conditions are met", ("redistribution and use in source and binary forms", "following conditions are met")),
    Template("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ("mozilla public license",)),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
             ("permission to use copy modify and", "with or without fee is hereby granted")),
    Template("unlicense", "This is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    Template("bsl-1.0", "Boost Software License, Version 1.0", ("boost software license",)),
    Template("epl-2.0", "under the terms of the Eclipse Public License, v. 2.0", ("eclipse public license",)),
    Template("cc0-1.0", "Creative Commons Zero, CC0 1.0 Universal", ("cc0 1 0",)),
    Template("cc-by-4.0", "Licensed under CC BY 4.0", ("cc by 4 0",)),
    Template("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0", ("cc by sa", "4 0")),
    Template("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", ("cc by nc", "4 0")),
    Template("cc-by-nd-4.0", "Licensed under CC BY-ND 4.0", ("cc by nd", "4 0")),
    Template("cc-by-nc-sa-4.0", "Licensed under CC BY-NC-SA 4.0", ("cc by nc sa", "4 0")),
    Template("cc-by", "licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution",)),
)


def vocabulary(templates: Iterable[Template] = TEMPLATES) -> set[bytes]:
    return {w.encode() for t in templates for w in t.words} | {w.encode() for p in BASE for w in p.split()}


def weights(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> dict[bytes, float]:
    """Inverse document frequency of the templates' words over all of `docs`: 1 + ln((1 + documents) / (1 + with the word))."""
    known = vocabulary(templates)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in parts(batches):
            for text in batch.column(0).to_pylist():
                counts.update(known.intersection(words_of(text)))
                counts[None] += 1
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() if w else None for w in counts], pa.string()), pa.array(counts.values(), pa.int64())],
                                         names=["word", "n"])

    found = docs.select(utf8_of().alias("utf8")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    n = {r["word"]: r["n"] for r in found.collect()}
    return {w: 1 + math.log((1 + n.get(None, 0)) / (1 + n.get(w.decode(), 0))) for w in known}


class Scanner:
    """Phrases under their rarest words, and the templates that need them."""

    def __init__(self, weight: dict[bytes, float], templates: tuple[Template, ...] = TEMPLATES) -> None:
        self.weight, self.templates = weight, []
        self.rarest: dict[bytes, list[int]] = {}
        #: Of each phrase, its words with their places, the rarest first.
        self.phrases: list[list[tuple[int, bytes]]] = []
        numbers: dict[tuple[str, ...], int] = {}

        def phrase(words: tuple[str, ...]) -> int:
            if words not in numbers:
                numbers[words] = len(self.phrases)
                own = sorted(enumerate(w.encode() for w in words), key=lambda p: (-weight[p[1]], p[0]))
                self.phrases.append(own)
                self.rarest.setdefault(own[0][1], []).append(numbers[words])
            return numbers[words]

        self.base = [(phrase(tuple(p.split())), label) for p, label in BASE.items()]
        for t in templates:
            words = [w.encode() for w in t.words]
            self.templates.append((t.label, words, [(at, phrase(key)) for at, key in t.places()], sum(weight[w] for w in words)))

    def occurrences(self, places: dict[bytes, list[int]]) -> dict[int, list[int]]:
        """Starts of every phrase that stands in a text with its licence words at `places`."""
        found = {}
        for word in sorted(places.keys() & self.rarest.keys(), key=lambda w: -self.weight[w]):
            for number in self.rarest[word]:
                (at, _), *others = self.phrases[number]
                starts = {p - at for p in places[word]}
                for at, other in others:
                    starts.intersection_update(p - at for p in places.get(other, ()))
                    if not starts:
                        break
                if starts:
                    found[number] = sorted(starts)
        return found

    def coverage(self, words: list[bytes], whole: float, places: dict[bytes, list[int]], anchor: int) -> float:
        seen = 0.0
        for q, word in enumerate(words):
            own = places.get(word)
            if own:
                k = bisect_left(own, anchor + q - SLACK)
                if k < len(own) and own[k] <= anchor + q + SLACK:
                    seen += self.weight[word]
        return seen / whole

    def scan(self, text: bytes) -> tuple[int, list[tuple[str, int]], list[tuple[str, int, float]]]:
        """Number of words; (label, first word) of each base phrase; (label, first word of its first key phrase, coverage) of each template."""
        words, places = words_of(text), {}
        for i, word in enumerate(words):
            if word in self.weight:
                places.setdefault(word, []).append(i)
        starts = self.occurrences(places)
        base = [(label, p) for number, label in self.base for p in starts.get(number, ())]
        matches = []
        for label, own, keys, whole in self.templates:
            (lead, first), *others = keys
            for p in starts.get(first, ()):
                anchor = p - lead
                for at, number in others:
                    near = starts.get(number, ())
                    k = bisect_left(near, anchor + at - SLACK)
                    if k == len(near) or near[k] > anchor + at + SLACK:
                        break
                else:
                    matches.append((label, p, self.coverage(own, whole, places, anchor)))
        return len(words), sorted(base, key=lambda b: b[1]), matches


def scan(docs: DataFrame, weight: dict[bytes, float], templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """doc_id, n_words, base (label, start) and matches (label, start, coverage) of every row; words are numbered from 0."""
    source, scanner = docs.select("doc_id", utf8_of().alias("utf8")), Scanner(weight, templates)
    base = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64())]))
    match = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("coverage", pa.float64())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            found = [scanner.scan(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([n for n, _, _ in found], pa.int64()),
                pa.array([[dict(label=x, start=p) for x, p in b] for _, b, _ in found], base),
                pa.array([[dict(label=x, start=p, coverage=c) for x, p, c in m] for _, _, m in found], match)],
                names=["doc_id", "n_words", "base", "matches"])

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, n_words long, base array<struct<label:string,start:long>>, "
                                  "matches array<struct<label:string,start:long,coverage:double>>")


def sql() -> str:
    """The columns of the query in DuckDB's SQL, without the index: every phrase is compared at every place of its first word."""
    templates = ", ".join(f"({t}, '{x.label}', {q}, '{w}')" for t, x in enumerate(TEMPLATES) for q, w in enumerate(x.words))
    keys = ", ".join(f"({t}, {k}, {at}, '{own[0]}', {len(own)}, '{' '.join(own)}')"
                     for t, x in enumerate(TEMPLATES) for k, (at, own) in enumerate(x.places()))
    base = ", ".join(f"('{label}', '{p.split()[0]}', {len(p.split())}, '{p}')" for p, label in BASE.items())
    return rf"""WITH dw AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        tmpl(t, label, q, word) AS (VALUES {templates}),
        keyed(t, k, off, head, n, body) AS (VALUES {keys}),
        based(label, head, n, body) AS (VALUES {base}),
        known AS (SELECT word FROM tmpl UNION SELECT unnest(string_split(body, ' ')) FROM based),
        pos AS MATERIALIZED (SELECT r, word, i - 1 AS p FROM (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM dw) SEMI JOIN known USING (word)),
        idf AS MATERIALIZED (SELECT word, 1 + ln((1 + (SELECT count(*) FROM dw)) / (1.0 + count(DISTINCT r))) AS weight FROM known LEFT JOIN pos USING (word) GROUP BY word),
        b AS (SELECT r, label, p FROM based JOIN pos ON pos.word = head JOIN dw USING (r) WHERE array_to_string(w[p + 1:p + n], ' ') = body),
        occ AS MATERIALIZED (SELECT r, t, k, off, p FROM keyed JOIN pos ON pos.word = head JOIN dw USING (r) WHERE array_to_string(w[p + 1:p + n], ' ') = body),
        lead AS (SELECT r, t, p - off AS a FROM occ WHERE k = 0),
        m AS MATERIALIZED (SELECT r, t, a FROM lead JOIN occ USING (r, t) WHERE abs(p - off - a) <= {SLACK} GROUP BY r, t, a
          HAVING count(DISTINCT k) = (SELECT count(*) FROM keyed WHERE keyed.t = any_value(occ.t))),
        cov AS (SELECT r, t, a, sum(weight) AS seen FROM (SELECT DISTINCT m.r, m.t, a, q, tmpl.word FROM m JOIN tmpl USING (t) JOIN pos ON pos.r = m.r AND pos.word = tmpl.word
          AND abs(p - a - q) <= {SLACK}) JOIN idf USING (word) GROUP BY r, t, a),
        whole AS (SELECT t, label, sum(weight) AS weight FROM tmpl JOIN idf USING (word) GROUP BY t, label),
        s AS (SELECT r, max(seen / weight) AS score FROM cov JOIN whole USING (t) GROUP BY r),
        bs AS (SELECT r, count(*) AS n_base, min(p) AS first_word, max(p) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM b GROUP BY r),
        ls AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM b UNION SELECT r, label FROM m JOIN whole USING (t)) GROUP BY r)
        SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
          coalesce(labels, '') AS labels, round(coalesce(score, 0), 6) AS score FROM dw LEFT JOIN bs USING (r) LEFT JOIN ls USING (r) LEFT JOIN s USING (r)"""
