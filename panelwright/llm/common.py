"""What the operators share: tables, the shared folder, cuts of lineage, small Arrow batches, stored files."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder name under spark.checkpoint.dir; a local run without that setting gets a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="llm-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The rows of `df`, computed once and kept in the shared folder, so that a lost executor loses none.

    Spark's cleaner deletes them with the DataFrame where spark.cleaner.referenceTracking.cleanCheckpoints is set.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def text_of(column: str = "text") -> Column:
    """The text, empty for null."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def utf8_of(column: str = "text") -> Column:
    """The text's UTF-8 bytes, empty for null."""
    return text_of(column).cast("binary")


def numbered(docs: DataFrame) -> tuple[DataFrame, tuple[str, ...], list[Column]]:
    """`docs` with numbers for column names and the text besides, those names, and what gives the old names back. So no
    column of a table can clash with one that an operator adds."""
    names = tuple(f"column_{i}" for i in range(len(docs.columns)))
    own = [F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)]
    return docs.select(*own, "text"), names, [F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)]


def parts(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches of few rows, so that Python holds few texts at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def portions(batches: Iterable[pa.RecordBatch], column: int, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Batches whose `column` (strings or bytes, no nulls) holds about `size` bytes at most, or a single row."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(ends, before + size, "right")))
            yield batch.slice(at, end - at)
            at = end


def kinds_of(df: DataFrame) -> str:
    """Names and types, as mapInArrow takes them."""
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def stored(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder in the shared storage, and the path in it."""
    return fs.FileSystem.from_uri(uri)


@contextmanager
def written_once(uri: str, attempt: int) -> Iterator[pa.NativeFile]:
    """A file that appears under its name when it is whole. Attempts of a task write the same bytes, so that the last to
    end may replace what an earlier one has left."""
    system, path = stored(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    own = f"{path}.{attempt}.tmp"
    with system.open_output_stream(own, compression=None) as out:
        yield out
    system.move(own, path)
