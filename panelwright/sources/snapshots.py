"""Snapshot tables keyed by fetch date: scans, landing rules and sinks."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwright.functions import sizing, windows as w
from panelwright.params import JobParams
from panelwright.sources.bars import BAR_SCHEMA

#: A header line is looked for in so many bytes.
HEADER_BYTES = 1 << 16
REQUIRED = ["open", "high", "low", "close", "volume"]
INFO_SCHEMA = T.StructType([
    T.StructField("ticker", T.StringType()), T.StructField("sector", T.StringType()),
    T.StructField("market_cap", T.DoubleType()), T.StructField("average_volume", T.DoubleType()),
    T.StructField("short_name", T.StringType())])
UNIVERSE_SCHEMA = T.StructType([
    T.StructField("ord", T.IntegerType()), T.StructField("ticker", T.StringType())])
SCHEMAS = {"prices": BAR_SCHEMA, "info": INFO_SCHEMA, "universe": UNIVERSE_SCHEMA}


def write_snapshot(df: DataFrame, root: str, kind: str, fetch_date: dt.date) -> None:
    """Replace one fetch date's partition; other dates stay."""
    (df.select(*[f.name for f in SCHEMAS[kind]]).withColumn("fetch_date", F.lit(fetch_date))
     .write.partitionBy("fetch_date").mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").parquet(f"{root}/{kind}"))


def scan_snapshot(spark: SparkSession, root: str, kind: str, fetch_date: dt.date) -> DataFrame:
    """One fetch date; only its partition is read. A missing snapshot is empty; a broken file fails the read, so no row is lost unseen."""
    schema = T.StructType([*SCHEMAS[kind], T.StructField("fetch_date", T.DateType())])
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{kind}")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], SCHEMAS[kind])
    return (spark.read.schema(schema).parquet(f"{root}/{kind}")
            .where(F.col("fetch_date") == F.lit(fetch_date)).drop("fetch_date"))


def split_cached(universe: DataFrame, snapshot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Universe members already in the snapshot, and those still to fetch."""
    have = snapshot.select("ticker").distinct()
    return universe.join(have, "ticker", "left_semi"), universe.join(have, "ticker", "left_anti")


# ------------------------------------------------------------ single files
def files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """path of every file below a folder; contents aren't read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(root).select("path")


def _opened(path: str):
    system, inside = fs.FileSystem.from_uri(path if "://" in path else path.replace(":/", ":///", 1))
    return system.open_input_file(inside)


def probe(paths: DataFrame, header: bool = False) -> DataFrame:
    """(path, header, error) of every file, each tried by itself: parquet files batch by batch, text files by their first line."""
    def tried(path: str) -> tuple[str | None, str | None]:
        try:
            with _opened(path) as file:
                if header:
                    line = file.read(HEADER_BYTES).split(b"\n", 1)[0].decode("utf-8").strip()
                    return (line, None) if line else (None, "no header")
                for _ in pq.ParquetFile(file).iter_batches():
                    pass
            return None, None
        except (OSError, ValueError) as wrong:  # what pyarrow raises for files that are cut off, no parquet or no text
            return None, type(wrong).__name__

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(path, *tried(path)) for path in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.string()) for i in range(3)], names=["path", "header", "error"])

    return paths.mapInArrow(run, "path string, header string, error string")


def scan_files(spark: SparkSession, root: str, schema: T.StructType = BAR_SCHEMA) -> tuple[DataFrame, DataFrame]:
    """Rows of all readable parquet files below ``root``, and (path, reason) of the others, which cost no rows but their own.

    Each file is read once more, by the probe. The driver holds the list of files, as Spark's own reader does.
    """
    tried = sizing.cut(probe(files(spark, root, "*.parquet")))
    good = [r["path"] for r in tried.where("error IS NULL").select("path").collect()]
    rows = spark.read.schema(schema).parquet(*good) if good else spark.createDataFrame([], schema)
    return rows, tried.where("error IS NOT NULL").select("path", F.col("error").alias("reason"))


def scan_mixed(spark: SparkSession, root: str, wanted: tuple[str, ...] = ("ticker", "date", *REQUIRED)) -> tuple[DataFrame, DataFrame]:
    """Rows of CSV files that each have a header of their own, as ticker, date, open..volume, and (path, reason) of the others.

    Files are grouped by their header; each group is read with it, its names are trimmed and compared without case, and
    it is rejected if a required one is missing. Values that aren't of their type are NULL.
    """
    tried = sizing.cut(probe(files(spark, root, "*.csv"), header=True))
    groups: dict[str, list[str]] = {}
    for r in tried.where("header IS NOT NULL").select("header", "path").collect():
        groups.setdefault(r["header"], []).append(r["path"])
    kinds = {f.name: f.dataType.simpleString() for f in BAR_SCHEMA} | {"volume": "bigint"}
    rows = spark.createDataFrame([], T.StructType([f for f in BAR_SCHEMA if f.name in wanted]))
    lost = tried.where("header IS NULL").select("path", F.col("error").alias("reason"))
    for header, paths in sorted(groups.items()):
        raw = spark.read.option("header", True).csv(paths)
        names = [c.strip().lower() for c in raw.columns]
        missing = [c for c in wanted if c not in names]
        if missing or len(set(names)) < len(names):
            why = f"missing: {', '.join(missing)}" if missing else "a name stands twice"
            lost = lost.unionByName(spark.createDataFrame([(p, why) for p in paths], "path string, reason string"))
            continue
        named = raw.toDF(*names)
        rows = rows.unionByName(named.select(*[F.trim(F.col(c)).try_cast(kinds[c]).alias(c) for c in wanted]))
    return rows, lost


def standard_columns(raw: DataFrame) -> DataFrame | None:
    """Trim and lower-case column names; None when a required column is missing."""
    names = [c.strip().lower() for c in raw.columns]
    named = raw.toDF(*names)
    return named if set(REQUIRED) <= set(names) else None


def wall_clock_date(ts: Column, zone: Column | None = None) -> Column:
    """Day of a timestamp's own wall clock, zone dropped.

    ``zone`` names the zone each row's source keeps its clock in. An instant is then read on that clock, whatever the
    session's zone is. Without it ``ts`` is a wall clock already.
    """
    if zone is None:
        return F.to_date(ts.cast("timestamp_ntz"))
    utc = F.timestamp_add("MICROSECOND", F.unix_micros(ts), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    return F.to_date(F.convert_timezone(F.lit("UTC"), zone, utc))


def _valid(df: DataFrame) -> Column:
    present = F.lit(True)
    for c in REQUIRED:
        present = present & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    return present & (F.col("close") > 0)


def normalise_prices(raw: DataFrame, params: JobParams = JobParams()) -> DataFrame:
    """Land raw ``ticker, date, open..volume`` rows: drop bad rows, then short tickers, then narrow types."""
    good = raw.where(_valid(raw)).select(
        "ticker", "date", *REQUIRED, F.count(F.lit(1)).over(w.by_ticker()).alias("n"))
    kept = good.where(F.col("n") >= params.min_bars)
    return kept.select("ticker", "date",
                       *[F.col(c).cast("float").alias(c) for c in REQUIRED[:4]],
                       F.col("volume").cast("long").alias("volume"))


def rejected(universe: DataFrame, raw: DataFrame, params: JobParams = JobParams()) -> DataFrame:
    """Universe members that landed nothing, with the reason. Counted, never fatal."""
    counts = raw.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("n_raw"), F.sum(F.when(_valid(raw), 1).otherwise(0)).alias("n_good"))
    rows = universe.join(counts, "ticker", "left")
    reason = (F.when(F.col("n_raw").isNull(), "missing").when(F.col("n_good") == 0, "no valid rows")
              .when(F.col("n_good") < params.min_bars, "short history"))
    return rows.select("ticker", reason.alias("reason"),
                       F.coalesce("n_good", F.lit(0)).alias("n_good")).where(F.col("reason").isNotNull())
