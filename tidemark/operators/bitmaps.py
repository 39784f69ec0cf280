"""Distinct counts that merge: bitmaps of dictionary codes in place of an expanded row for each count.

Codes are dense numbers from 1.  A group keeps one bitmap for each 32,768 codes, built before
the shuffle, so that counts of days, events and contracts come from one pass, and bitmaps
of months add up to quarters and years.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELLS = 256


def with_code(rows: DataFrame, cols: Sequence[str], code: str, near: Sequence[str] = ()) -> DataFrame:
    """Adds a dense code from 1 for each different value of ``cols`` (nulls too), numbered within hash cells and after the cells before.

    Values with the same ``near`` columns get neighbouring codes, so that ranges of the one code hold few ranges of the other.
    ``rows`` should hold each value once or a few times, such as a table of contracts.
    """
    every = list(dict.fromkeys([*near, *cols]))
    each = rows.select(*every).distinct().withColumn("__cell", F.pmod(F.xxhash64(*(near or cols)), F.lit(CELLS)))
    counts = each.groupBy("__cell").agg(F.count("*").alias("__n"))  # CELLS rows at most
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("__cell", before.alias("__before"))
    number = F.row_number().over(Window.partitionBy("__cell").orderBy(*every))
    each = each.withColumn("__row", number).join(F.broadcast(offsets), "__cell").select(*every, (F.col("__row") + F.col("__before")).cast("long").alias(code))
    same = F.lit(True)
    for c in every:
        same = same & F.col(f"l.`{c}`").eqNullSafe(F.col(f"r.`{c}`"))
    return rows.alias("l").join(each.alias("r"), same).select("l.*", f"r.`{code}`")


def bitmaps(rows: DataFrame, keys: Sequence[str], codes: Mapping[str, Column], other: Mapping[str, Column] | None = None) -> DataFrame:
    """(keys, __at, bitmap columns, other aggregates): one row for each group and each combination of code ranges in it.

    ``codes`` maps names to code columns, null where a row doesn't count; a code that follows from another adds few combinations.  ``other`` are sums to carry along.
    """
    at = F.array(*[F.coalesce(F.bitmap_bucket_number(c.cast("long")), F.lit(0).cast("long")) for c in codes.values()])
    bits = [F.bitmap_construct_agg(F.bitmap_bit_position(c.cast("long"))).alias(n) for n, c in codes.items()]
    sums = [F.sum(c).alias(n) for n, c in (other or {}).items()]
    return rows.groupBy(*keys, at.alias("__at")).agg(*bits, *sums)


def merged(parts: DataFrame, keys: Sequence[str], names: Sequence[str], other: Sequence[str] = ()) -> DataFrame:
    """Bitmap rows rolled up to fewer ``keys``."""
    return parts.groupBy(*keys, "__at").agg(*[F.bitmap_or_agg(n).alias(n) for n in names], *[F.sum(c).alias(c) for c in other])


def counted(parts: DataFrame, keys: Sequence[str], names: Sequence[str], other: Sequence[str] = ()) -> DataFrame:
    """(keys, counts by name, sums): distinct codes of each group.

    Bitmaps of one range are united over the ranges of the other codes, then their sizes add up.
    """
    out = None
    for i, name in enumerate(names):
        ranges = parts.groupBy(*keys, F.col("__at")[i].alias("__r")).agg(F.bitmap_or_agg(name).alias("__b"))
        count = ranges.groupBy(*keys).agg(F.sum(F.when(F.col("__r") > 0, F.bitmap_count("__b")).otherwise(0)).cast("long").alias(name))
        out = count if out is None else _beside(out, count, keys)
    if other:
        out = _beside(out, parts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in other]), keys)
    return out


def _beside(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"a.`{k}`").eqNullSafe(F.col(f"b.`{k}`"))
    return a.alias("a").join(b.alias("b"), same).select("a.*", *[f"b.`{c}`" for c in b.columns if c not in keys])
