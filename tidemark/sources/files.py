"""Readers and sinks with explicit schemas."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Where it is unset, a session in one process gets a folder of its own; a cluster has to name one.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it back, so that several branches start from files."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header and # comments; a byte-order mark is read over."""
    return spark.read.schema(schema).option("header", True).option("comment", "#").option("enforceSchema", True).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_sorted(df: DataFrame, path: str, keys: Sequence[str], partitions: int | None = None) -> None:
    """ZSTD Parquet in key order: ranges of the first keys, sorted within."""
    ranged = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
    ranged.sortWithinPartitions(*keys).write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_tape(tape: DataFrame, root: str) -> None:
    """Tape with ``venue`` and ``date`` as folders."""
    tape.repartition("venue", "date").write.mode("overwrite").partitionBy("venue", "date").parquet(root)


def read_tape(spark: SparkSession, root: str, start: str, end: str) -> DataFrame:
    """Partitioned tape (venue=, date=) from one date to another; only the partitions asked for are read."""
    return spark.read.parquet(root).where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def read_long(spark: SparkSession, csv: str, parquet: str) -> DataFrame:
    """(date, ticker, field, value) from CSV and Parquet files with those columns in any case; rows without a value go."""

    def tidy(df: DataFrame) -> DataFrame:
        df = df.toDF(*[c.lower() for c in df.columns])
        return df.select(F.to_date("date").alias("date"), "ticker", "field", F.col("value").cast("double").alias("value")).where("value is not null")

    return tidy(spark.read.option("header", True).csv(csv)).unionByName(tidy(spark.read.parquet(parquet)))


def _struct_fields(schema: str) -> str:
    return ",".join(":".join(f.split()) for f in schema.split(","))


def read_json_dict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file with one JSON object of objects as a table: key and the fields of ``schema``."""
    text = spark.read.option("wholetext", True).text(path)
    entries = text.select(F.explode(F.from_json("value", f"map<string,struct<{_struct_fields(schema)}>>")))
    return entries.select("key", "value.*")


def export_registry(registry: Sequence[tuple], root: str, spark: SparkSession) -> DataFrame:
    """Build and write every table (name, builder, description, units by column); returns the catalog, one row a column.

    A table whose source is missing is skipped and has one row without columns, with ``written`` false.
    """
    rows = []
    for name, build, about, units in registry:
        try:
            df = build()
            df.write.mode("overwrite").parquet(f"{root}/{name}")
        except AnalysisException as error:
            if error.getCondition() not in ("PATH_NOT_FOUND", "TABLE_OR_VIEW_NOT_FOUND"):
                raise
            rows.append((name, about, None, None, None, None, False))
            continue
        rows += [(name, about, i, c, t, units.get(c), True) for i, (c, t) in enumerate(df.dtypes)]
    return spark.createDataFrame(rows, "name string, about string, place int, column string, type string, units string, written boolean")
