"""Each operator against a plain version of its rules, on texts chosen for their edges."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.llm import (decontaminate, packing, quality, secrets, simhash, token_counts, token_store, toxicity, urls, warc)
from panelwright.llm.common import cut, shared_folder
from panelwright.llm.encoding import Encoder
from panelwright.llm.queries import vocabulary

LONG = " ".join(f"word{i % 977} text{i % 89}," for i in range(6000))
TEXTS = [None, "", " \n\t", "one", "two words", "a b c d e f a b c d e f", "Same line here\nSame line here\n\nother | line # $",
         "x y z x y z", "El niño — façade\x0bcafé 日本語 テキスト", LONG, LONG.upper(), "a b c d e f a b c d e f",
         "tab\x1cseparated\x00 nul <|endoftext|> end", "  two  blanks\r\n\r\nline ", "it's they've 123abc 4,5.6 ΑΣ İx"]
SHAPE = "doc_id long, text string, lang string, source string, n_chars long, utf8 string, hits string, body string, length int, fp int, spans string"


@pytest.fixture(scope="module")
def docs(spark):
    """Null ids, repeated rows, and columns with the names that operators use inside."""
    rows = [(i if i != 4 else None, t, None, "s", len(t or ""), "u", None, "b", 7, 1, "x") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[5]], SHAPE).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SHAPE)


def by_text(docs, found):
    """Rows of an operator beside the text of their id."""
    ids = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = found.collect()
    assert len(rows) == len(TEXTS) + 1
    return [(ids[r["doc_id"]] or "", r) for r in rows]


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def test_quality_counts(docs, empty):
    for text, r in by_text(docs, quality.statistics(docs)):
        words = split(text)
        windows = collections.Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
        hit = {k for i in range(len(words) - 4) if windows[tuple(words[i:i + 5])] > 1 for k in range(i, i + 5)}
        lines = [x for x in text.split("\n") if split(x)]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (
            len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit))
    assert quality.statistics(empty).count() == 0


def test_quality_learns_faults_without_labels(spark, empty):
    rng = np.random.default_rng(5)

    def words(n):
        return [f"w{'abcdefgh'[k % 8]}{k}" for k in rng.integers(0, 3000, n)]

    good = [" ".join(words(120)) + "\n" + " ".join(words(60)) for _ in range(150)]
    odd = [" ".join(w + "#$%" for w in words(150)) for _ in range(12)]
    loud = [" ".join(w.upper() + "!!" for w in words(150)) for _ in range(12)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(good + odd + loud)], "doc_id long, text string")
    counts = cut(quality.statistics(docs))
    model = quality.fit(counts)
    kept = {r["doc_id"]: r for r in quality.judge(counts, model).collect()}
    assert all(kept[i]["kept"] for i in range(150)) and not any(kept[i]["kept"] for i in range(150, 174))
    assert all(0 <= r["posterior"] <= 1 for r in kept.values())
    assert {r["doc_id"] for r in quality.keep(docs, counts).collect()} == set(range(150))
    assert model.share[quality.GOOD] > 0.8
    assert quality.fit(quality.statistics(empty)) == quality._start()
    assert quality.keep(empty, quality.statistics(empty)).columns == empty.columns


def print_of(text, words=3):
    found = re.sub("[A-Z]", lambda m: m[0].lower(), text).encode().split()
    if not found:
        return 0
    import xxhash

    shingles = [b" ".join(found[i:i + words]) for i in range(max(1, len(found) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(docs, empty):
    for text, r in by_text(docs, simhash.fingerprints(docs)):
        assert r["fp"] % (1 << 64) == print_of(text)
    assert simhash.groups(simhash.fingerprints(empty)).count() == 0
    row = simhash.fingerprints(docs).where("doc_id = 1").select(simhash.hex_of(F.col("fp")).alias("h")).first()
    assert row["h"] == "0" * 16


@pytest.mark.parametrize(("radius", "segments"), [(2, 2), (3, 2), (5, 3), (7, 4)])
def test_near_fingerprints_link_and_no_others(spark, radius, segments):
    rng = np.random.default_rng(radius)
    prints = list(rng.integers(0, 1 << 64, 40, np.uint64))
    for p in list(prints):
        for n in range(1, radius + 2):
            prints.append(np.uint64(int(p) ^ sum(1 << int(b) for b in rng.choice(64, n, replace=False))))
    prints = [int(p) for p in prints]
    rows = [(100 + i if i % 17 else None, p - (1 << 64) if p >= 1 << 63 else p) for i, p in enumerate(prints)]
    df = spark.createDataFrame(rows, "doc_id long, fp long")
    expected = {frozenset((a, b)) for a in prints for b in prints if a != b and (a ^ b).bit_count() <= radius}
    found = {frozenset((r["a"] % (1 << 64), r["b"] % (1 << 64))) for r in simhash.links(df.select("fp").distinct(), radius, segments).collect()}
    assert found == expected
    root = {p: p for p in prints}

    def top(p):
        while root[p] != p:
            p = root[p]
        return p

    for a, b in map(tuple, expected):
        root[top(a)] = top(b)
    least = {}
    for (i, _), p in zip(rows, prints):
        if i is not None:
            least[top(p)] = min(i, least.get(top(p), i))
    for r in simhash.groups(df, radius, segments).collect():
        assert r["component_id"] == least.get(top(r["fp"] % (1 << 64)))


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    rows = simhash.components(edges).collect()
    assert {r["node"] for r in rows} == set(range(201)) and {r["root"] for r in rows} == {0}


def words_of(text):
    return re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@pytest.mark.parametrize("block_bytes", [1 << 20, 40])
def test_wu_manber_finds_every_window(spark, docs, empty, block_bytes):
    items = [(7, "a b c d e f"), (70, "a b c d e f"), (8, " ".join(LONG.split()[100:125])), (9, "two"), (10, None), (11, "..!"),
             (12, "x y z x y z"), (None, "one"), (13, "niño façade")]
    benchmark = spark.createDataFrame([(*i, "clash") for i in items], "item_id long, text string, utf8 string")
    windows = collections.defaultdict(set)
    for i, text in items:
        w = words_of(text)
        for k in range(len(w) - min(10, len(w)) + 1 if w else 0):
            windows[tuple(w[k:k + 10])] |= {str(i)} if i is not None else set()
    for text, r in by_text(docs, decontaminate.search(docs, benchmark, block_bytes=block_bytes)):
        words, hit, ids = words_of(text), set(), set()
        for length in {len(w) for w in windows}:
            for k in range(len(words) - length + 1):
                if tuple(words[k:k + length]) in windows:
                    hit.update(range(k, k + length))
                    ids |= windows[tuple(words[k:k + length])]
        assert r["n_words"] == len(words) and r["items"] == sorted(ids)
        assert {k for a, b in r["hits"] for k in range(a, b)} == hit
    assert decontaminate.search(empty, benchmark).count() == 0
    assert decontaminate.clean(docs, benchmark.limit(0)).count() == len(TEXTS) + 1
    assert decontaminate.clean(docs, benchmark).columns == docs.columns


KEY, RANDOM = "0123abcd" * 4, "kJ8sQ2vLr9Xw4Zt7Bn1Yc6Pd3Mf5Gh0R"


def test_secret_spans(spark, empty):
    texts = [f"Token : '{KEY}x' and api_key=short", "AKIA" + "A1" * 6 + " AKIA12", f"π {KEY}", f"see {RANDOM} here",
             "550e8400-e29b-41d4-a716-446655440000 plain " + "internationalization" * 2, "ABCDEFGHabcdefgh0123456789example", None, "",
             "z" * 5000 + RANDOM + "!" + "y" * 5000, "PASSWD = " + "q" * 8 + " secret=" + "z" * 7]
    docs = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    spans = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in secrets.scan(docs).collect()}
    assert spans[0] == [("assign", 0, len(texts[0]) - len(" and api_key=short") - 1), ("hex", 9, 41)]
    assert spans[1] == [("access", 0, 16)] and spans[2] == [("hex", 2, 34)]
    assert spans[3] == [("entropy_base64", 4, 36)]
    assert spans[4] == spans[5] == spans[6] == spans[7] == []
    assert [s for s in spans[8] if s[0] == "entropy_base64"] and spans[9] == [("assign", 0, 17)]
    masked = {r["doc_id"]: r["text"] for r in secrets.mask(docs).collect()}
    assert masked[3] == "see [secret] here" and masked[6] is None and masked[9] == "[secret] secret=" + "z" * 7
    assert secrets.scan(empty).count() == secrets.mask(empty).count() == 0


def test_entropy_by_counts_is_that_of_each_window():
    text = "aaaaaaaaaaaaaaaaaaaaaa" + RANDOM + "abababababababababababababab"
    for least in (1.0, 2.5, 4.0):
        inside = set()
        for at in range(len(text) - 19):
            counts = collections.Counter(text[at:at + 20]).values()
            if -sum(c / 20 * np.log2(c / 20) for c in counts) >= least - 1e-9:
                inside |= set(range(at, at + 20))
        assert {k for a, b in secrets.dense(text, least) for k in range(a, b)} == inside


def library_ids(name):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary(name))
    return lambda text: library.encode(text, add_special_tokens=False).ids


def test_packing(docs, empty):
    path, ids = vocabulary("byte_bpe_50k.json"), library_ids("byte_bpe_50k.json")
    packed = packing.pack(cut(packing.pieces(docs, path)))
    rows, texts = packed.collect(), {r["doc_id"]: r["text"] for r in docs.collect()}
    of, inside = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        of[r["doc_id"]].append(r)
        inside[r["sequence_id"]].append(r)
    for i, own in of.items():
        own.sort(key=lambda r: (r["piece"], r["sequence_id"]))
        own = own[::2] if i == 5 else own  # that row is there twice
        raw = b"".join(bytes(r["ids"]) for r in own)
        assert np.frombuffer(raw, "<u4").tolist() == [*ids(texts[i] or ""), 2]
        assert [r["start"] for r in own] == np.cumsum([0, *(r["length"] for r in own)])[:-1].tolist()
        assert all(r["length"] == 1024 for r in own[1:])
    for own in inside.values():
        own.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in own] == np.cumsum([0, *(r["length"] for r in own)])[:-1].tolist()
        assert sum(r["length"] for r in own) <= 1024
    whole = {r["sequence_id"]: bytes(r["ids"]) for r in packing.sequences(packed).collect()}
    assert whole == {k: b"".join(bytes(r["ids"]) for r in own) for k, own in inside.items()}
    assert packing.pack(cut(packing.pieces(empty, path))).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_piece_and_wastes_little(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 1025 if seed % 2 else 400, 3000)
    counts = {int(k): int(v) for k, v in zip(*np.unique(lengths, return_counts=True))}
    used, bins = collections.Counter(), 0
    for n, made in packing.plan(counts):
        assert sum(k * c for k, c in made.items()) <= 1024 and n > 0
        used.update({k: n * c for k, c in made.items()})
        bins += n
    assert used == counts
    above = int((lengths > 512).sum())
    assert bins <= max(-(-int(lengths.sum()) // 1024), above) * 1.02 + 1


def test_two_shorter_pieces_replace_the_shortest():
    # Greedily 6 + 3 leaves 1 of 10; 2 + 2 fill the place of 3 and the gap.
    assert packing.plan({6: 1, 3: 1, 2: 2}, 10)[0] == (1, collections.Counter({6: 1, 2: 2}))


def test_byte_encoder_has_the_librarys_ids(spark):
    ids = library_ids("byte_bpe_50k.json")
    some = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    for text in [*filter(None, TEXTS), *some]:
        assert packing.ids_of(text, vocabulary("byte_bpe_50k.json")).tolist() == [*ids(text), 2]


def test_word_encoder_has_the_librarys_ids(spark):
    import pyarrow as pa

    some = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    texts = [t or "" for t in TEXTS] + ["a|b | c||d", "x<|startoftext|>|y", "　wide space\x85"] + some
    encoder, ids = Encoder(vocabulary("word_bpe_49k.json"), memo_words=200), library_ids("word_bpe_49k.json")
    for _ in range(2):
        for at in range(0, len(texts), 7):
            own = encoder.encode(pa.array(texts[at:at + 7]))
            assert [np.frombuffer(x, "<u4").tolist() for x in own] == [ids(t) for t in texts[at:at + 7]]
    assert Encoder(vocabulary("byte_bpe_50k.json")).by_word is False


def test_token_files_round_trip(spark, docs, empty):
    ids, folder = library_ids("word_bpe_49k.json"), shared_folder(spark)
    files = token_store.write(docs, folder, vocabulary("word_bpe_49k.json"))
    rows = token_store.read(files, with_ids=True).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows.sort(key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == sorted([*texts, 5], key=lambda i: (i is not None, i or 0))
    at = 0
    for r in rows:
        own = np.array([*ids(texts[r["doc_id"]] or ""), 2], "<u4")
        assert bytes(r["ids"]) == own.tobytes() and r["ids_crc32"] == zlib.crc32(own.tobytes())
        assert (r["start"], r["n_tokens"]) == (at, len(own))
        at += len(own)
    reader = token_store.Reader(files.first()["uri"])
    assert reader.at(reader.docs - 1).tolist()[-1] == 2
    assert token_store.read(token_store.write(empty, shared_folder(spark), vocabulary("word_bpe_49k.json"))).count() == 0


def test_token_counts_come_from_the_cache(spark, docs, empty):
    import sentencepiece

    path, cache = vocabulary("piece_bpe_32k.model"), shared_folder(spark)
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    for text, r in by_text(docs, token_counts.counts(docs, cache, path)):
        assert (r["n_tokens"], r["n_bytes"]) == (len(model.encode(text)), len(text.encode()))
    stored = spark.read.parquet(cache)
    assert stored.count() == len({t or "" for t in TEXTS})
    token_counts.counts(docs, cache, path)
    assert spark.read.parquet(cache).count() == stored.count()  # nothing was missing
    spark.createDataFrame([(hashlib.sha256(b"one").hexdigest(), token_counts.version(path), 77)], token_counts.CACHE).write.mode("append").parquet(cache)
    assert token_counts.counts(docs, cache, path).where("doc_id = 3").first()["n_tokens"] == 77
    assert token_counts.counts(empty, cache, path).count() == 0


def test_toxic_words_and_stems_are_learned(spark, empty):
    rng = np.random.default_rng(3)
    rows, marks = [], []
    for i in range(600):
        words = [f"{'abcdefghij'[a]}{'klmnopqrst'[b]}o" for a, b in rng.integers(0, 10, (60, 2))]
        toxic = i % 5 == 0
        if toxic:
            for k in (7, 30, 41):
                words[k] = "vilest" if i % 2 else "grubx" + "abcd"[i % 4]
        rows.append((i, " ".join(words)))
        marks.append((i, int(toxic)))
    rows += [(600, None), (601, ""), (600, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([*marks, (None, 1), (3, None), (9999, 1)], "doc_id long, toxic int")
    field = toxicity.fit(docs, labels)
    found = {r["doc_id"]: r for r in toxicity.score(docs, field).collect()}
    assert all((found[i]["score"] >= 0.3) == bool(t) for i, t in marks)
    texts = dict(rows)
    assert {texts[i][s["start"]:s["end"]][:5] for i, t in marks if t for s in found[i]["spans"]} == {"viles", "grubx"}
    assert found[600]["score"] < 0.3 and found[601]["spans"] == []
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) == r["h"] for r in docs.select("doc_id", toxicity.held_out().alias("h")).collect())
    assert toxicity.score(empty, field).count() == 0
    none = toxicity.fit(docs, labels.limit(0))
    assert {round(r["score"], 6) for r in toxicity.score(docs, none).collect()} == {0.5}


def test_marginals_are_those_of_all_paths():
    field = toxicity.Field({"wbad": 2.0, "3bad": 0.7}, -1.5, ((0.3, -0.4), (0.1, 0.9)), -0.2, (0.0, 1.0, 0.0, 0.0))
    tagger, words = toxicity.Tagger(field), ["ok", "bad", "fine", "badly", "ok"]
    said = [tagger._weight(w) for w in words]
    total, toxic = 0.0, np.zeros(5)
    for path in range(32):
        states = [path >> k & 1 for k in range(5)]
        x = field.start * states[0] + sum(s * (field.bias + np.log(v)) for s, v in zip(states, said))
        x = np.exp(x + sum(field.turn[a][b] for a, b in zip(states, states[1:])))
        total += x
        toxic += x * np.array(states)
    assert np.allclose(tagger._marginals(said), toxic / total)


PAGES = [(1, "http://A.example.net/en/1?utm_source=feed", "x" * 150), (2, "https://a.b.net/de/#t", "y" * 99), (3, None, None), (4, "no scheme", ""),
         (5, "http://example.com/de/5", "x" * 150), (6, "http://www.example.com/en/7?utm_source=feed", "é" * 60000), (7, "http://z.org?ref=x", "y" * 99),
         (8, "http://example.com/de", "é" * 60000), (0, "http://q.org/fr/a b?c", "<p>\r\n\r\n0\r\n\r\n</p>" * 9), (9, "http://ads.site.io/x\ny", "z"),
         (10, "http://notexample.com/de/1", "x" * 150), (None, "http://net", "x" * 150)]


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(*p, "clash", "clash") for p in PAGES]
    return spark.createDataFrame([*rows, rows[4]], "page_id long, url string, html string, payload string, host string").repartition(2).cache()


@pytest.mark.parametrize("segment", [64, 1 << 16])
def test_archives_round_trip(spark, pages, segment):
    rows = warc.read(warc.write(pages, shared_folder(spark), segment), with_payload=True).collect()
    html = {p[0]: (p[2] or "").encode() for p in PAGES}
    assert sorted(r["page"] for r in rows) == sorted([*(str(i) if i is not None else "" for i in html), "5"])
    for r in rows:
        i = int(r["page"]) if r["page"] else None
        payload = html[i]
        first = min(k for k, v in html.items() if v == payload and k is not None)
        revisit = len(payload) >= 100 and i != first
        assert (r["kind"], r["refers_to"]) == (("revisit", str(first)) if revisit else ("response", None))
        assert r["bytes"] == len(payload) and r["digest"] == hashlib.sha256(payload).hexdigest()
        assert revisit or bytes(r["payload"] or b"") == payload
    assert warc.read(warc.write(pages.limit(0), shared_folder(spark))).count() == 0


def test_damaged_archives_are_refused():
    body = b"".join(b"%d" % i for i in range(3000))
    digest = hashlib.sha256(body).hexdigest()
    raw = list(warc.records("1", "u", "response", digest, None, body, "n", 1000))
    segments = [warc.segment_of(warc.parsed(r)) for r in raw]
    headers, block = warc.joined(segments[::-1])
    assert warc.payload_of(block) == (body, len(body)) and headers["warc-page-id"] == "1"
    with pytest.raises(ValueError, match="missing"):
        warc.joined(segments[:2] + segments[3:])
    with pytest.raises(ValueError, match="bytes, not"):
        warc.joined([*segments[:-1], segments[-1] | {"total": 5}])
    with pytest.raises(ValueError, match="whole"):
        warc.parsed(raw[0][:-4])
    with pytest.raises(ValueError, match="isn't the one"):
        warc.row_of(headers | {"warc-payload-digest": "sha256:00"}, block, False)
    assert warc.unchunked(b"3;x=y\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc"
    for bad in (b"zz\r\nabc\r\n", b"5\r\nabc\r\n0\r\n\r\n", b"3\r\nabc\r\n0\r\n"):
        with pytest.raises(ValueError, match="chunk"):
            warc.unchunked(bad)


def test_url_verdicts(spark, pages):
    found = {r["page_id"]: r for r in urls.judge(pages).collect()}
    assert (found[1]["host"], found[1]["path"], found[1]["rule"], found[1]["verdict"]) == ("a.example.net", "/en/1", "example.net/en/", "allow")
    assert (found[2]["rule"], found[2]["verdict"]) == ("net/", "block")
    assert [found[i]["host"] + found[i]["path"] for i in (3, 4)] == ["", ""] and found[3]["verdict"] == "allow"
    assert found[5]["rule"] == "example.com/de/" and found[8]["rule"] is None and found[10]["rule"] is None
    assert found[6]["verdict"] == "block" and found[7]["verdict"] == "block" and found[9]["verdict"] == "block"
    assert found[None]["path"] == "" and found[None]["rule"] is None
    # The index gives what running every pattern gives.
    for r in pages.collect():
        said = {rule.verdict for rule in urls.RULES if r["url"] and re.search(rule.pattern, r["url"])}
        judged = urls.Judge(urls.index(urls.RULES, urls.frequencies(pages)))
        assert judged.verdict(r["url"]) == ("allow" if "allow" in said else "block" if said else None)
    assert urls.judge(pages.limit(0)).count() == 0
