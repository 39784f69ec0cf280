"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as arrow_fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Spark's setting for the removal of exchange files at the end of an execution
_FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables, through Spark's reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Where it is unset, a session in one process gets a folder of its own; a cluster has to name one.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def open_fs(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """File system and path within it of a plain path or a URI, for tasks that read or write files themselves."""
    if path.startswith("file:"):
        return arrow_fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    if "://" in path:
        return arrow_fs.FileSystem.from_uri(path)
    return arrow_fs.LocalFileSystem(), path


def materialize(df: DataFrame, label: str, drop_exchanges: bool = False, files: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Later steps then start from files that outlive any executor, and a costly scan
    that two branches need runs once.  With ``drop_exchanges`` Spark removes the files of
    the write's exchanges as soon as it has ended, not when the driver collects its garbage.
    ``files`` (see ``files_for``) keeps a small table from being written as a file for each
    shuffle partition: on some file systems every file starts processes of its own.
    """
    spark = df.sparkSession
    if files and files < wide_partitions(spark):
        df = df.coalesce(files)
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(_FILE_CLEANUP, "false")
    if drop_exchanges:
        spark.conf.set(_FILE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if drop_exchanges:
            spark.conf.set(_FILE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def stored_rows(df: DataFrame, label: str, names: Sequence[str]) -> tuple[str, DataFrame]:
    """Writes every row of ``df`` to a file of its own in the shared folder; returns the folder and the ``names`` columns.

    For rows of some megabytes that many tasks read (``stored_row``); ``names`` are unique. A repeated task writes the same files again.
    """
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    names = list(names)

    def store(batches):
        fs, root = open_fs(folder)
        for batch in batches:
            for i in range(batch.num_rows):
                row = pa.Table.from_batches([batch.slice(i, 1)])
                fs.create_dir(root)
                name = f"{root}/{'-'.join(str(row[n][0].as_py()) for n in names)}"
                staged = f"{name}.{uuid.uuid4().hex}"
                pq.write_table(row, staged, filesystem=fs)
                fs.move(staged, name)
            yield batch.select(names)

    schema = df.select(*names).schema
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return folder, materialize(df.mapInArrow(store, ddl), label)


def stored_row(folder: str, *names) -> dict:
    """A row written by ``stored_rows``, in a task."""
    fs, path = open_fs(f"{folder}/{'-'.join(map(str, names))}")
    return pq.read_table(path, filesystem=fs).to_pylist()[0]


def text_or_empty(col: str = "text"):
    """Null counts as the empty text."""
    return F.coalesce(F.col(col), F.lit(""))


def partitions_for(df: DataFrame, row_bytes: Column, target_bytes: int) -> int:
    """Number of partitions of about ``target_bytes`` for an exchange of all rows; one narrow scan adds up the sizes."""
    total = df.agg(F.sum(row_bytes.cast("long"))).head()[0] or 0
    return max(wide_partitions(df.sparkSession), -(-int(total) // target_bytes))


def files_for(written: DataFrame, rows: int, floor: int = 12) -> int:
    """Number of tasks of about ``rows`` rows each for a table with as many rows as the written one, by its files' footers."""
    return max(floor, -(-written.count() // rows))


def wide_partitions(spark: SparkSession, floor: int = 12) -> int:
    """Number of partitions for a keyed exchange: the session's own setting."""
    return max(floor, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_order(df: DataFrame, prefix: str = "") -> Column:
    """A hash of all columns (but maps), so that a choice among rows is the same in every run."""
    return F.xxhash64(*[F.col(f"{prefix}`{f.name}`") for f in df.schema if "map<" not in f.dataType.simpleString()])
