"""Shards with size-tiered compaction and a versioned manifest.

Arrivals are appended as small immutable files, straight from the tasks that read them.
Compaction puts the files of a manifest version into tiers by the logarithm of their
size, lays the files of a tier in order, cuts them into runs of about the target size and
merges each run of at least ``min_run`` files into one file.  New files and the new
manifest are written beside the old ones; the manifest becomes visible by one rename, so
a reader sees the old or the new version and never a mixture.  DataFrame functions only.

Cases: nulls in any column, empty and long texts and repeated rows are stored as they
are; an empty arrival adds no files; a file of the target size or more is left alone; a
table may have any columns.  If a commit finds its version taken, it fails and can be repeated.
"""

from __future__ import annotations

import math
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import free_name, materialize, wide_partitions

CELLS = 256
MANIFEST = "path string, shard long, first_id long, n_docs long, n_bytes long, tier int, added_in int"


class ShardStore:
    """A folder with data files and manifest versions, on a file system whose rename is atomic and can refuse to replace (HDFS or a shared disk).

    Plain object stores copy in place of a rename; there a commit is not atomic.
    """

    def __init__(self, spark: SparkSession, root: str, id_col: str = "doc_id"):
        self.spark, self.root, self.id_col = spark, root.rstrip("/"), id_col

    # -- manifest ---------------------------------------------------------------------------------

    def _fs(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def version(self) -> int:
        """Latest committed version; 0 before the first."""
        fs, p = self._fs(f"{self.root}/manifest")
        if not fs.exists(p):
            return 0
        return max([int(s.getPath().getName()[1:]) for s in fs.listStatus(p) if s.getPath().getName()[0] == "v"], default=0)

    def manifest(self, version: int | None = None) -> DataFrame:
        """Files of a version: path, shard, first_id, n_docs, n_bytes (of the file), tier, added_in."""
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifest/v{version:08d}")

    def _commit(self, files: DataFrame, version: int) -> int:
        """Makes the manifest visible by a rename that fails if the version is there already."""
        staged = f"{self.root}/staged-{uuid.uuid4().hex}"
        columns = ["path", "shard", "first_id", "n_docs", "n_bytes", "tier", "added_in"]
        files.select(*columns).repartition("path").write.parquet(staged)  # adaptive execution merges small partitions
        hadoop, gateway = self.spark._jvm.org.apache.hadoop, self.spark.sparkContext._gateway
        fs, source = self._fs(staged)
        _, folder = self._fs(f"{self.root}/manifest")
        _, target = self._fs(f"{self.root}/manifest/v{version:08d}")
        fs.mkdirs(folder)
        mode = getattr(hadoop.fs, "Options$Rename")
        modes = gateway.new_array(mode, 1)
        modes[0] = mode.NONE
        context = hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(fs.makeQualified(source), fs.makeQualified(target), modes)
        except Py4JJavaError as error:
            if not fs.exists(target):
                raise
            raise RuntimeError(f"manifest version {version} was committed by someone else") from error
        return version

    # -- data -------------------------------------------------------------------------------------

    def _files(self, folder: str, tiers: float, version: int) -> DataFrame:
        """Manifest rows (without shard numbers) of the files written to ``folder``."""
        fs, p = self._fs(folder)
        if not fs.exists(p):
            return self.spark.createDataFrame([], MANIFEST).drop("shard")
        written = self._rows([folder])
        if self.id_col not in written.columns:
            raise ValueError(f"no column {self.id_col}")
        return (
            written.select(F.col(self.id_col).cast("long").alias("i"), "_metadata.file_path", "_metadata.file_size")
            .groupBy(F.col("file_path").alias("path"))
            .agg(F.min("i").alias("first_id"), F.count("*").alias("n_docs"), F.max("file_size").alias("n_bytes"))
            .withColumn("tier", F.floor(F.log("n_bytes") / math.log(tiers)).cast("int"))
            .withColumn("added_in", F.lit(version))
        )

    def append(self, rows: DataFrame, rows_per_file: int = 2000, fanout: float = 4.0) -> int:
        """Add an arrival as small files and commit the next version."""
        version = self.version() + 1
        folder = f"{self.root}/data/arrival-{uuid.uuid4().hex}"
        rows.write.option("compression", "zstd").option("maxRecordsPerFile", rows_per_file).parquet(folder)
        return self._commit(self._numbered(version, self._files(folder, fanout, version)), version)

    def _numbered(self, version: int, new: DataFrame, without: DataFrame | None = None) -> DataFrame:
        """The files of the version before, less those in ``without``, and the new ones with numbers after theirs."""
        old = self.manifest(version - 1)
        last = old.agg(F.coalesce(F.max("shard"), F.lit(-1)).alias("last"))
        # numbers within cells of the path's hash, after those of the cells before
        new = new.withColumn("cell", F.pmod(F.xxhash64("path"), F.lit(CELLS)))
        cells = new.groupBy("cell").agg(F.count("*").alias("n")).crossJoin(last)  # one row; CELLS rows at most
        before = F.sum("n").over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
        cells = cells.select("cell", (F.col("last") + F.coalesce(before, F.lit(0))).alias("before"))
        row = F.row_number().over(Window.partitionBy("cell").orderBy("path"))
        new = new.withColumn("row", row).join(cells, "cell")
        new = new.withColumn("shard", (F.col("before") + F.col("row")).cast("long")).drop("cell", "row", "before")
        kept = old if without is None else old.join(without, "path", "left_anti")
        return kept.unionByName(new)

    def plan(self, target_bytes: int, min_run: int, max_files: int) -> DataFrame:
        """(path, run): files to merge, at most ``max_files`` of them, in order of tier and first id."""
        small = self.manifest().where(F.col("n_bytes") < target_bytes).orderBy("tier", "first_id", "path").limit(max_files)
        tier = Window.partitionBy("tier").orderBy(F.col("first_id").asc_nulls_last(), "path")
        before = F.coalesce(F.sum("n_bytes").over(tier.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        runs = small.withColumn("cut", F.floor(before / target_bytes))
        runs = runs.withColumn("n", F.count("*").over(Window.partitionBy("tier", "cut")))
        return runs.where(F.col("n") >= min_run).select("path", F.concat_ws("-", "tier", "cut").alias("run"))

    def compact(
        self, target_bytes: int = 32 << 20, min_run: int = 2, fanout: float = 4.0, max_files: int = 50_000
    ) -> int:
        """Merge runs of similarly sized files; commits and returns the next version, or the current if nothing is due.

        One call merges ``max_files`` files at most (the plan is broadcast); call it until the version stays.
        """
        current = self.version()
        plan = materialize(self.plan(target_bytes, min_run, max_files), "compaction-plan")
        paths = [r["path"] for r in plan.select("path").collect()]  # at most max_files
        if not paths:
            return current
        version = current + 1
        folder = f"{self.root}/data/merged-{uuid.uuid4().hex}"
        rows = self._rows(paths)
        columns = rows.columns
        run, path = free_name(rows, "run"), free_name(rows, "path")
        marked = rows.select(*[F.col(f"`{c}`") for c in columns], F.col("_metadata.file_path").alias(path))
        marked = marked.join(F.broadcast(plan.withColumnsRenamed({"path": path, "run": run})), path)
        marked = marked.repartition(wide_partitions(self.spark), run).sortWithinPartitions(run, self.id_col)
        marked.select(*[f"`{c}`" for c in columns], run).write.option("compression", "zstd").partitionBy(run).parquet(folder)
        files = self._files(folder, fanout, version)
        return self._commit(self._numbered(version, files, plan.select("path")), version)

    def read(self, version: int | None = None, columns: list[str] | None = None) -> DataFrame:
        """Rows of a version with their shard: the data columns, then shard, shard_docs, shard_bytes, tier, added_in."""
        files = self.manifest(version)
        paths = [r["path"] for r in files.select("path").collect()]  # Spark's file index holds the same list
        if not paths:
            raise ValueError("the store has no files")
        rows = self._rows(paths)
        columns, path = columns or rows.columns, free_name(rows, "path")
        of_file = files.select(
            F.col("path").alias(path), "shard", F.col("n_docs").alias("shard_docs"), F.col("n_bytes").alias("shard_bytes"), "tier", "added_in"
        )
        rows = rows.select(*[F.col(f"`{c}`") for c in columns], F.col("_metadata.file_path").alias(path))
        return rows.join(of_file, path).drop(path)

    def _rows(self, paths: list[str]) -> DataFrame:
        """The files' own columns; the folders that they lie in add none."""
        return self.spark.read.option("recursiveFileLookup", "true").parquet(*paths)


def shard_documents(
    documents: DataFrame, root: str, rows_per_file: int = 2000, target_bytes: int = 32 << 20, **options
) -> ShardStore:
    """Append ``documents`` as an arrival and compact until nothing is due."""
    store = ShardStore(documents.sparkSession, root)
    version = store.append(documents, rows_per_file)
    while (after := store.compact(target_bytes, **options)) != version:
        version = after
    return store


def assignment(store: ShardStore) -> DataFrame:
    """Per stored document: doc_id, n_bytes and sha of its text as stored, and its shard in the latest version."""
    rows = store.read(columns=["doc_id", "text"])
    return rows.select(
        "doc_id",
        F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"),
        "shard",
        "shard_docs",
        "shard_bytes",
        "tier",
        F.lit(store.version()).alias("version"),
    )
