"""Join-side sizing and shared-folder helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of bytecode beyond which the JVM only interprets a method; Spark's own default lets generated ones grow to eight times that.
JIT_BYTES = 8000


def small_methods(spark: SparkSession) -> None:
    """Run projections and aggregates of many columns by split methods, which the JVM compiles, unless the session says otherwise."""
    if spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "65535":
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", str(JIT_BYTES))


def join_where_dealt(spark: SparkSession) -> None:
    """Let joins by (ticker, date) of tables that are stored by ticker read them as they lie: a ticker's rows are bounded by the calendar."""
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")


def calendar_span(df: DataFrame, date_col: str = "date") -> int:
    """Days between the first and last date: the most rows a per-day table can have.

    One column, aggregated map-side; on parquet it reads only that column.
    """
    row = df.agg(F.min(date_col).alias("lo"), F.max(date_col).alias("hi")).first()
    return 0 if row["lo"] is None else (row["hi"] - row["lo"]).days + 1


def attach_by_day(big: DataFrame, per_day: DataFrame, on, span: int | None, limit: int,
                  how: str = "inner") -> DataFrame:
    """Join a table with at most one row per day.

    Broadcast only when the calendar span was measured and lies under the
    limit; otherwise an ordinary join, which AQE may split on hot days.
    """
    small = span is not None and span <= limit
    return big.join(F.broadcast(per_day) if small else per_day, on, how)


#: A table is broadcast if its rows, at the size of their types, take no more.
BROADCAST_BYTES = 32 << 20


def fits_broadcast(df: DataFrame) -> bool:
    """Whether a stored table of columns of fixed size, and short strings counted as 64 bytes, is small enough to broadcast."""
    width = sum(64 if f.dataType.simpleString() == "string" else 16 for f in df.schema.fields)
    most = BROADCAST_BYTES // max(1, width)
    return df.limit(most + 1).count() <= most


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors see: the cluster's checkpoint folder.

    Only a local master without that setting falls back to a temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder: survives lost executors and ends the lineage."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """The rows as files of columns in the shared folder, which take a fraction of a checkpoint's disk and are read by column."""
    path = shared_path(df.sparkSession, "written")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_path(spark: SparkSession, kind: str) -> str:
    return f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"


def _buckets(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def dealt(df: DataFrame, key: str) -> DataFrame:
    """The rows dealt by ``key`` as ``stored`` deals them, so that what is grouped by it can be stored where it is made."""
    return df.repartition(_buckets(df.sparkSession), F.col(key))


def stored(df: DataFrame, key: str, *order: str, in_place: bool = False) -> DataFrame:
    """The rows, written once to the shared folder in buckets of ``key`` and read back as a table.

    Readers take the columns they name, group and window by ``key`` without an exchange, and plan from the table
    instead of from all that made it. ``in_place`` says that the rows lie where ``dealt`` has put their key.
    """
    spark = df.sparkSession
    buckets = _buckets(spark)
    name = f"stored_{uuid.uuid4().hex}"
    rows = df if in_place else dealt(df, key)
    # Values of doubles and floats hardly repeat, so a dictionary is only built for the key.
    plain = {"parquet.enable.dictionary": "false", f"parquet.enable.dictionary#{key}": "true"}
    rows.write.options(**plain).bucketBy(buckets, key).sortBy(key, *order).option("path", shared_path(spark, "stored")).saveAsTable(name)
    return spark.table(name)
