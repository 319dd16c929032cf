"""From documents to packed training sequences, one written stage after the other.

Every stage works on what the one before has kept, takes tables with further columns of any name, and gives an empty
table for an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.llm import decontaminate, near, packing, quality, secrets
from panelwright.llm.common import cut, numbered, shared_folder, table, utf8_of
from panelwright.llm.queries import vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the rules reject: null, empty and blank texts go, repeated rows go or stay together, very
    long texts are counted whole."""
    return quality.keep(docs, cut(quality.statistics(docs)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the least id.

    Copies have a Jaccard similarity of 0.8 or more of their shingles of five words, counted on the whole sets. SimHash
    and sketches find the candidates; most come from the sketches. Of rows with the same id and text, one stays; a row
    without an id stays only where its group has no id. Null, empty and blank texts are one group.
    """
    own, _, names = numbered(docs)
    first = F.struct(F.col("doc_id").isNull(), "doc_id", "digest")
    stay = near.groups(docs.select("doc_id", "text")).groupBy("root").agg(F.min_by(F.struct("doc_id", "digest"), first).alias("row"))
    stay = stay.select(F.concat_ws(":", F.lower(F.hex("row.digest")), F.col("row.doc_id").cast("string")).alias("row_key"))
    ids = docs.columns.index("doc_id")
    rows = own.withColumn("row_key", F.concat_ws(":", F.sha2(utf8_of(), 256), F.col(f"column_{ids}").cast("string"))).drop("text")
    return rows.join(stay, "row_key", "left_semi").dropDuplicates(["row_key"]).select(*names)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a window of a benchmark item. Null and empty texts hold none and stay, as repeated
    rows do; very long texts are searched whole."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secret_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret. Null texts stay null, empty ones empty; repeated rows stay."""
    return secrets.mask(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their token ids (little-endian, unsigned, 32 bits) and their places in sequences of at most
    1024 tokens: packing.sequences joins a sequence's pieces. Null and empty texts are an end token each; repeated rows
    are packed each."""
    made = packing.pieces(docs, vocabulary("byte_bpe_50k.json"))
    return packing.pack(cut(made.withColumn("ids_crc32", F.crc32("ids"))))


STAGES = [("quality rules", quality_rules), ("SimHash near-dedup", near_duplicates),
          ("benchmark decontamination", benchmark_free), ("secret scans", secret_free), ("best-fit packing", packed)]

#: SQL has neither the tokenizer nor expectation-maximisation; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        folder = shared_folder(spark)
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return STAGES[-1][1](spark, docs, sf_dir)
