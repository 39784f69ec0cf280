"""Exact deduplication over an extendible-hash index kept on shared files.

1. Directory.  Distinct hashes are counted by hash prefix.  Buckets start at ``base_depth``
   bits; a bucket of more than ``capacity`` hashes is split, which doubles the directory,
   until every bucket fits.  Prefixes may get 8 bits longer than evenly dealt hashes need, so
   that the depth grows with the data (or up to ``max_depth`` bits, where that is given).
2. Index.  Texts go to the owners of their buckets, after equal texts of a task have become
   one entry.  The owner compares the bytes of the entries with one hash: equal ones become
   one entry with the largest id and the number of rows, different ones are chained.  An
   entry keeps the SHA-256 and the length in place of the text.  The index is written
   bucket by bucket.
3. Decision.  Documents look their entry up in their bucket by hash, length and SHA-256.

DataFrame functions only.

Cases: a null text counts as empty; a null id is smaller than every id (``keep_id`` is
null only if no row of the group has an id); rows that repeat id and text can't be told
apart and share one decision; an empty table gives an empty result; other columns of the
input are ignored, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import materialize, text_or_empty, wide_partitions


def directory(entries: DataFrame, capacity: int, base_depth: int, max_depth: int) -> DataFrame:
    """(slot, depth, bucket): the bucket of each ``max_depth``-bit hash prefix ``slot`` of the entries.

    A bucket is the shortest prefix of at least ``base_depth`` bits with at most
    ``capacity`` entries; a full prefix of ``max_depth`` bits is not split.
    """
    slots = entries.groupBy("slot").agg(F.count("*").alias("n"))
    levels = slots.select(
        "slot", "n", F.explode(F.sequence(F.lit(base_depth), F.lit(max_depth))).alias("depth")
    ).withColumn("prefix", F.expr(f"shiftright(slot, {max_depth} - depth)"))
    fits = (
        levels.groupBy("depth", "prefix")
        .agg(F.sum("n").alias("n"))
        .where((F.col("n") <= capacity) | (F.col("depth") == max_depth))
        .select("depth", "prefix")
    )
    return (
        levels.join(fits, ["depth", "prefix"], "left_semi")
        .groupBy("slot")
        .agg(F.min("depth").alias("depth"))
        .withColumn("bucket", F.expr(f"shiftright(slot, {max_depth} - depth)"))
    )


def slot_of(h: str, depth: int):
    return F.expr(f"shiftrightunsigned({h}, {64 - depth})")


def hashed(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, h, n_bytes)"""
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return docs.select("doc_id", "text", F.xxhash64("text").alias("h"), F.octet_length("text").cast("long").alias("n_bytes"))


def build_index(
    docs: DataFrame, capacity: int, base_depth: int, max_depth: int | None = None
) -> tuple[DataFrame, DataFrame, int]:
    """The written index and directory of (doc_id, text, h, n_bytes), and the directory's bits.

    Index: (depth, bucket, h, chain, n_bytes, text_sha256, keep_id, n); ``chain`` numbers the
    different texts with one hash.
    """
    hashes = materialize(docs.select("h").distinct(), "exact-hashes")
    deepest = max_depth or max(base_depth, math.ceil(math.log2(max(1, hashes.count()) / capacity)) + 8)
    found = directory(hashes.select(slot_of("h", deepest).alias("slot")), capacity, base_depth, deepest)
    found = materialize(found, "exact-directory")
    # a directory has as many bits as its deepest bucket
    bits = found.agg(F.max("depth")).first()[0] or base_depth
    slots = found.select(F.expr(f"shiftright(slot, {deepest - bits})").alias("slot"), "depth", "bucket").distinct()
    slots = materialize(slots, "exact-slots")
    placed = docs.withColumn("slot", slot_of("h", bits)).join(slots, "slot")
    entries = placed.groupBy("depth", "bucket", "h", "n_bytes", "text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("n"))
    entries = entries.select("depth", "bucket", "h", "n_bytes", F.sha2("text", 256).alias("text_sha256"), "keep_id", "n")
    owned = entries.repartition(wide_partitions(docs.sparkSession), "depth", "bucket")
    chain = F.row_number().over(Window.partitionBy("depth", "bucket", "h").orderBy("n_bytes", "text_sha256"))
    return materialize(owned.withColumn("chain", chain), "exact-index"), slots, bits


def exact_dedup(
    documents: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 500_000,
    base_depth: int = 4,
    max_depth: int | None = None,
) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest id stays.
    """
    docs = hashed(documents, id_col, text_col)
    index, slots, bits = build_index(docs, capacity, base_depth, max_depth)
    asked = docs.select("doc_id", "h", "n_bytes", F.sha2("text", 256).alias("text_sha256"), slot_of("h", bits).alias("slot"))
    found = asked.join(slots, "slot").join(index, ["depth", "bucket", "h", "n_bytes", "text_sha256"])
    return found.select(
        "doc_id",
        "keep_id",
        F.col("n").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    )


ORACLE = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
