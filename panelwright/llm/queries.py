"""Registered queries of the operators, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.llm import conversations, decontaminate, licences, negatives, packing, quality, secrets, simhash, token_counts, token_store, toxicity, urls, warc
from panelwright.llm.common import cut, shared_folder, table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.read(warc.write(table(spark, sf_dir, "pages"), shared_folder(spark)))
    return found.select(F.nullif("page", F.lit("")).cast("long").alias("page_id"), F.col("bytes").alias("payload_bytes"),
                        F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"),
                        F.col("refers_to").cast("long").alias("refers_to"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = packing.pieces(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    return packing.pack(cut(made.withColumn("ids_crc32", F.crc32("ids")).drop("ids")))


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))

    def of(*kinds: str) -> Column:
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    return found.select(
        "doc_id", *(F.size(of(k)).cast("bigint").alias(f"n_{k}") for k in secrets.BASE),
        F.sha2(secrets.written(of(*secrets.BASE)).cast("binary"), 256).alias("base_sha256"),
        secrets.written(F.col("spans")).alias("spans"))


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = cut(simhash.fingerprints(table(spark, sf_dir, "documents")))
    return simhash.groups(prints).select("doc_id", simhash.hex_of(F.col("fp")).alias("fingerprint"), "component_id")


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), urls.PRODUCTION)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = cut(quality.statistics(table(spark, sf_dir, "documents")))
    return quality.judge(counts, quality.fit(counts)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", toxicity.held_out().alias("held_out"), "score",
                        F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"),
                        F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))),
                                     ",").alias("spans"))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hits", F.lit(0).cast("bigint"), lambda n, s: n + s[1] - s[0])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
                        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
                        (n_hit > 0).alias("contaminated"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a cache of its own; one that is kept between runs is a parameter of the operator."""
    cache = shared_folder(spark)
    return token_counts.counts(table(spark, sf_dir, "documents"), cache, vocabulary("piece_bpe_32k.model")).withColumn(
        "over_limit", F.col("n_tokens") > 4096)


def op10_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = token_store.write(table(spark, sf_dir, "documents"), shared_folder(spark), vocabulary("word_bpe_49k.json"))
    return token_store.read(files)


def op11_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = licences.scan(docs, licences.weights(docs))
    base, labels = F.col("base.label"), F.concat("base.label", "matches.label")
    return found.select(
        "doc_id", "n_words", F.size("base").cast("bigint").alias("n_base"), F.array_min("base.start").alias("first_word"),
        F.array_max("base.start").alias("last_word"), F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(labels)), ",").alias("labels"),
        F.round(F.coalesce(F.array_max("matches.coverage"), F.lit(0.0)), 6).alias("score"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = negatives.whole_numbers(table(spark, sf_dir, "embeddings"))
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return negatives.mine(rows, rows.where(F.col("vec_id") % 100 == 0))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = conversations.damaged(table(spark, sf_dir, "conversations"))
    return conversations.digests(turns, cut(conversations.audits(turns)))


QUERIES = {f.__name__: f for f in (
    pipeline, op1_warc, op2_best_fit_packing, op3_secret_scans, op4_simhash_dedup, op5_url_filters, op6_quality_rules,
    op7_toxicity, op8_benchmark_decontamination, op9_token_counts, op10_token_id_output,
    op11_license_scans, op12_hard_negatives, op13_conversation_repair)}
#: SQL for operators whose results SQL can express: not those with a tokenizer, a fitted model or an entropy window.
#: That of op5 runs every pattern on every URL, where the operator runs those that its index fetches.
ORACLES: dict[str, str] = {
    "op1_warc": f"""WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        f AS (SELECT html, min(page_id) AS first FROM p WHERE strlen(html) >= {warc.LEAST_BYTES} GROUP BY html)
        SELECT page_id, strlen(html) AS payload_bytes, sha256(html) AS payload_digest,
          CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
          CASE WHEN page_id <> first THEN first END AS refers_to FROM p LEFT JOIN f USING (html)""",
    "op5_url_filters": """WITH u AS (SELECT page_id, url, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1),
          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
          coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
        fit AS (SELECT *, CASE """ + " ".join(
            f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}'"
            for _, h, p in sorted(urls.HOSTS, key=lambda r: -len(r[1] + r[2]))) + """ END AS rule FROM u)
        SELECT page_id, host, path, rule, CASE """ + " ".join(
            f"WHEN rule = '{h}{p}' THEN '{v}'" for v, h, p in urls.HOSTS) + " " + " ".join(
            f"WHEN regexp_matches(small, '{r.pattern}') THEN '{r.verdict}'"
            for r in sorted(urls.PRODUCTION, key=lambda r: r.verdict)) + """ ELSE 'allow' END AS verdict
        FROM (SELECT *, translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS small FROM fit)""",
    "op8_benchmark_decontamination": r"""WITH dw AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''),
          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        win AS MATERIALIZED (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, n, array_to_string(w[i:i + n - 1], ' ') AS body FROM
          (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT *, least(10, len(w)) AS n FROM bw WHERE len(w) > 0))),
        sizes AS (SELECT DISTINCT n FROM win),
        own AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS body FROM
          (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, sizes WHERE len(w) >= n)),
        hit AS MATERIALIZED (SELECT doc_id, item, n, i FROM own JOIN win USING (n, body)),
        words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM (SELECT DISTINCT doc_id, n, i FROM hit)) GROUP BY doc_id),
        items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
          sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op11_license_scans": licences.sql(),
    "op12_hard_negatives": """WITH v AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
          list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL
          AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same,
          CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
        p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
          QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
        SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, other AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
        WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) QUALIFY row_number() OVER w <= 5""",
}
