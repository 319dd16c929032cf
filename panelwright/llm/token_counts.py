"""Token counts from a digest cache.

The cache is a table of content digest, tokenizer digest and number of tokens, in the shared storage. Documents meet it
by the digest of their content; distinct contents that it lacks for this tokenizer are encoded once and appended. Copies
of a text meet before the shuffle, in each task.

Defined cases: a null text counts as empty; no other normalisation is applied, as counts have to be those of the text as
it is; repeated rows keep a row each; an empty table gives an empty result. Two runs that append the same content at the
same time leave it twice with equal counts, which are read as one. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import cut, portions, text_of

CACHE = "content string, tokenizer string, n_tokens long"


@lru_cache(maxsize=2)
def model(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def version(path: str) -> str:
    """Digest of what counts depend on besides the text: the model file and the library's version."""
    import sentencepiece

    return hashlib.sha256(Path(path).read_bytes() + sentencepiece.__version__.encode()).hexdigest()


def encoded(texts: DataFrame, path: str) -> DataFrame:
    """content and n_tokens of rows content, body."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, 1, 1 << 20):
            ids = model(path).encode(batch.column(1).to_pylist(), num_threads=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, ids), pa.int64())], names=["content", "n_tokens"])

    return texts.mapInArrow(run, "content string, n_tokens long")


def counts(docs: DataFrame, cache: str, path: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens of every document; the cache at `cache` then holds all contents."""
    spark, tokenizer = docs.sparkSession, version(path)
    own = docs.select("doc_id", text_of().alias("body")).withColumn("content", F.sha2(F.col("body").cast("binary"), 256))
    spark.createDataFrame([], CACHE).write.mode("append").parquet(cache)  # so that it exists

    def known() -> DataFrame:
        return spark.read.schema(CACHE).parquet(cache).where(F.col("tokenizer") == tokenizer).groupBy("content").agg(
            F.max("n_tokens").alias("n_tokens"))

    distinct = own.groupBy("content").agg(F.first("body").alias("body"))
    misses = distinct.join(known().select("content"), "content", "left_anti")
    encoded(misses, path).select("content", F.lit(tokenizer).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache)
    # Kept, so that both sides of the join come from a plain exchange, whose large partitions Spark splits: one content
    # may be that of a third of the documents.
    return own.select("doc_id", F.octet_length("body").cast("bigint").alias("n_bytes"), "content").join(cut(known()), "content").drop("content")
