"""Mixing sources to target weights by systematic sampling.

Every document of a source is expected ``target / source_size`` times.  The documents of
a source are put in order of size (hash of the id among equal sizes), their expected
copies are summed up along that order, one offset per source is added, and a document is
emitted once per integer boundary that its share of the sum crosses.  Going by size makes
the error of a source's words no more than about one large document.

Positions come from counts: per (source, size, hash cell) and summed over sizes and
cells, so that a source with a third of all rows is ranked in as many tasks as there are cells.

Cases: a null text has size 0; a null source is a source of its own, after all others; a
null id is ordered like an empty one; rows that repeat an id take neighbouring positions;
a source without words has target 0 and takes nothing; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import free_name, materialize, row_order, text_or_empty


def source_targets(sizes: DataFrame, weights: Sequence[int], cap: int) -> DataFrame:
    """Targets of (skey, source_size): shares by weight, at most ``cap`` times the source.

    What stops at its cap is reshared by weight until none is above, which is one level:
    in order of cap per weight, the first sources stop and the rest share what is left.
    The table has one row per source.
    """
    by_name = Window.orderBy("skey")
    weight = F.element_at(
        F.array(*[F.lit(w).cast("long") for w in weights]),
        (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"),
    )
    s = sizes.withColumn("w", weight).withColumn("cap", F.lit(cap).cast("long") * F.col("source_size"))
    s = s.withColumn("fill", F.col("cap") / F.col("w"))
    order = Window.orderBy("fill", "skey")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    s = s.withColumn("left", F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
    s = s.withColumn("w_left", F.sum("w").over(onward))
    s = s.withColumn("stops", F.col("cap") * F.col("w_left") <= F.col("left") * F.col("w"))
    open_left = F.max(F.when(~F.col("stops"), F.col("left"))).over(everything)
    open_w = F.max(F.when(~F.col("stops"), F.col("w_left"))).over(everything)
    return s.select(
        "skey",
        "source_size",
        F.when(F.col("stops"), F.col("cap").cast("double"))
        .otherwise((F.col("w") * open_left).cast("double") / open_w)
        .alias("target"),
    )


def _placed(documents, weights, cap, seed, id_col, text_col, source_col) -> DataFrame:
    """systematic_mix with the hash of the text, which tells rows apart that repeat an id."""
    base = documents.select(
        F.col(id_col).alias("doc_id"),
        F.xxhash64(text_or_empty(text_col)).alias("th"),
        F.when(F.col(source_col).isNull(), F.lit("1"))
        .otherwise(F.concat(F.lit("0"), F.col(source_col).cast("string")))
        .alias("skey"),
        F.regexp_count(text_or_empty(text_col), F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("size"),
        F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("h"),
    ).withColumn("cell", F.substring("h", 1, 2))
    base = materialize(base, "mix-base")
    cells = base.groupBy("skey", "size", "cell").agg(F.count("*").alias("n"))
    cells = materialize(cells, "mix-cells")
    by_size = cells.groupBy("skey", "size").agg(F.sum("n").alias("n_size"))
    before = Window.unboundedPreceding, -1
    by_size = by_size.withColumn(
        "at_size",
        F.coalesce(F.sum("n_size").over(Window.partitionBy("skey").orderBy("size").rowsBetween(*before)), F.lit(0)),
    )
    sizes = by_size.groupBy("skey").agg(F.sum(F.col("size") * F.col("n_size")).alias("source_size"))
    unit = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.col("skey"))), 1, 4), 16, 10).cast("double") / 65536
    targets = source_targets(sizes, weights, cap).withColumn("u", unit)
    start = F.coalesce(
        F.sum("n").over(Window.partitionBy("skey", "size").orderBy("cell").rowsBetween(*before)), F.lit(0)
    )
    starts = (
        cells.withColumn("at_cell", start)
        .join(by_size.drop("n_size"), ["skey", "size"])
        .join(targets, "skey")
        .select("skey", "size", "cell", "source_size", "target", "u", (F.col("at_size") + F.col("at_cell")).alias("at"))
    )
    rank = F.row_number().over(Window.partitionBy("skey", "size", "cell").orderBy("h", "doc_id"))
    placed = base.withColumn("r", rank).join(starts, ["skey", "size", "cell"])
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    i = F.col("at") + F.col("r")
    copies = F.floor(i * expected + F.col("u")) - F.floor((i - 1) * expected + F.col("u"))
    return placed.withColumn("copies", copies).select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("copies") * F.col("size")).alias("taken"),
        "copies",
        "th",
    )


def systematic_mix(
    documents: DataFrame,
    weights: Sequence[int] = (5, 2, 1),
    cap: int = 3,
    seed: str = "mix",
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken, copies."""
    return _placed(documents, weights, cap, seed, id_col, text_col, source_col).drop("th")


def mix_documents(
    documents: DataFrame,
    weights: Sequence[int] = (5, 2, 1),
    cap: int = 3,
    seed: str = "mix",
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """The mix itself: the documents with all their columns, each as often as it is taken."""
    n = _placed(documents, weights, cap, seed, id_col, text_col, source_col)
    times = n.groupBy("doc_id", "th").agg(F.sum("copies").alias("all"), F.count("*").alias("rows")).alias("t")
    here = F.col(f"d.{id_col}").eqNullSafe(F.col("t.doc_id")) & (F.xxhash64(text_or_empty(f"d.{text_col}")) == F.col("t.th"))
    joined = documents.alias("d").join(times, here)
    # rows that repeat id and text share their copies as evenly as they divide
    row = F.row_number().over(Window.partitionBy("t.doc_id", "t.th").orderBy(row_order(documents, "d.")))
    own = F.floor(F.col("t.all") * row / F.col("t.rows")) - F.floor(F.col("t.all") * (row - 1) / F.col("t.rows"))
    name = free_name(documents, "times")
    return (
        joined.select("d.*", own.alias(name))
        .where(F.col(name) > 0)
        .withColumn(name, F.explode(F.sequence(F.lit(1).cast("long"), F.col(name))))
        .drop(name)
    )


ORACLE = r"""
WITH d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS skey,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
s0 AS (SELECT skey, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY skey),
s1 AS (SELECT *, [5, 2, 1][CAST((row_number() OVER (ORDER BY skey) - 1) % 3 + 1 AS INT)] AS w, 3 * source_size AS cap FROM s0),
s2 AS (SELECT *, cap / w AS fill,
              CAST(sum(source_size) OVER () AS BIGINT)
              - CAST(coalesce(sum(cap) OVER (ORDER BY cap / w, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS rest,
              CAST(sum(w) OVER (ORDER BY cap / w, skey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS w_rest
       FROM s1),
s3 AS (SELECT *, cap * w_rest <= rest * w AS stops FROM s2),
s4 AS (SELECT skey, source_size,
              CASE WHEN stops THEN CAST(cap AS DOUBLE)
                   ELSE CAST(w * max(CASE WHEN NOT stops THEN rest END) OVER () AS DOUBLE)
                        / max(CASE WHEN NOT stops THEN w_rest END) OVER () END AS target,
              CAST(('0x' || substr(md5('mix|' || skey), 1, 4)) AS BIGINT) / 65536.0::DOUBLE AS u
       FROM s3),
r AS (SELECT d.doc_id, d.size, s4.source_size, s4.target, s4.u,
             CASE WHEN s4.source_size > 0 THEN s4.target / s4.source_size ELSE 0.0::DOUBLE END AS e,
             row_number() OVER (PARTITION BY skey ORDER BY size, h, doc_id) AS i
      FROM d JOIN s4 USING (skey)),
c AS (SELECT *, CAST(floor(i * e + u) - floor((i - 1) * e + u) AS BIGINT) AS copies FROM r)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM c
"""
