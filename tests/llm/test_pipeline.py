"""The pipeline's stages, each on what the one before has kept."""

import collections
import re
import zlib

import corpus_pipeline
import numpy as np
from panelwright.llm import decontaminate, secrets
from panelwright.llm.common import cut, shared_folder
from panelwright.llm.packing import END_ID, library_encoder, sequences
from panelwright.llm.queries import vocabulary
from tests.llm.test_near import brute

SF = "/root/testdata/sf0.001"


def test_stages_take_effect_and_keep_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, folder = docs, shared_folder(spark)
        stage(spark, docs, SF).write.parquet(folder)
        docs = spark.read.parquet(folder)
        assert docs.columns == columns
        kept[name] = (before.collect(), docs.collect())
    before, after = kept["quality rules"]
    assert 0 < len(after) < len(before)
    for r in after:
        assert len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) >= 10
    before, after = kept["SimHash near-dedup"]
    rows = sorted((r["doc_id"], r["text"]) for r in before)
    roots, _ = brute([t for _, t in rows])
    assert {r["doc_id"] for r in after} == {rows[r][0] for r in roots} and len(after) < len(before)
    before, after = kept["benchmark decontamination"]
    items = [(str(r["item_id"]), (r["text"] or "").encode()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    tables = decontaminate.tables(items)
    clean = {r["doc_id"] for r in before if not decontaminate.hits_of(decontaminate.words_of((r["text"] or "").encode()), tables)[0]}
    assert {r["doc_id"] for r in after} == clean
    before, after = kept["secret scans"]
    texts = {r["doc_id"]: r for r in after}
    assert set(texts) == {r["doc_id"] for r in before}
    for r in before:
        assert texts[r["doc_id"]]["text"] == secrets.masked(r["text"]) and texts[r["doc_id"]]["n_chars"] == len(texts[r["doc_id"]]["text"])


def test_packed_sequences_hold_every_token_once(spark):
    own = [(1, None), (2, ""), (3, "A few words."), (3, "A few words."), (4, "word " * 3000), (None, "no id")]
    docs = spark.createDataFrame([(i, t, "z") for i, t in own], "doc_id long, text string, ids string")
    packed = cut(corpus_pipeline.packed(spark, docs, SF))
    library = library_encoder(vocabulary("byte_bpe_50k.json"))
    ids = [library.encode(t or "", add_special_tokens=False).ids + [END_ID] for _, t in own]
    whole = np.concatenate([np.frombuffer(r["ids"], "<u4") for r in sequences(packed).collect()])
    assert collections.Counter(whole.tolist()) == collections.Counter(x for d in ids for x in d)
    by_row = collections.defaultdict(list)
    for r in packed.collect():
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] <= 4096
        by_row[r["doc_id"], r["start"]].append(list(np.frombuffer(r["ids"], "<u4")))
    for (i, _), d in zip(own, ids):
        assert [x for (j, s), own_ids in sorted(by_row.items(), key=lambda k: k[0][1]) if j == i for x in own_ids[0]] == d


def test_an_empty_table_goes_through_and_clashing_columns_stay(spark, tmp_path):
    shape = "doc_id long, text string, lang string, source string, n_chars long, row_key string, digest string, root int, `__content` int, id long"
    text, other = (r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").where("lang = 'en' and n_chars between 2000 and 4000").orderBy(
        "doc_id").limit(2).collect())
    rows = [(k, t, "en", "s", len(t), "k", "d", k, 5, 6) for k, t in enumerate([text, text, text + " end", "short", other])]
    for n in (0, len(rows)):
        folder = tmp_path / str(n)
        spark.createDataFrame(rows[:n], shape).write.parquet(f"{folder}/documents.parquet")
        spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(folder))
            assert out.columns == docs.columns
            assert all(tuple(r)[5:] == ("k", "d", r["doc_id"], 5, 6) for r in out.collect())
        found = {r["doc_id"] for r in corpus_pipeline.run(spark, str(folder)).collect()}
        assert found <= {0, 4} and (found or not n)


def test_repeated_rows_and_ids_of_null(spark):
    text = " ".join(f"word{i}" for i in range(300))
    rows = [(None, text), (4, text), (4, text), (3, text + " tail"), (None, "alone here now"), (None, "alone here now"), (9, "alone there then")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t), 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, content int")
    kept = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()]
    assert collections.Counter(kept) == collections.Counter([(3, text + " tail"), (None, "alone here now"), (9, "alone there then")])
