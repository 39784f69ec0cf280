"""Running values along keys that hold many rows: scans within time segments, then over the segments.

A key's rows are cut into segments by a column that grows with the order, such as a month.
What each segment hands on is a small table; a window scans it by key and gives every
segment one more row with what the segments before it hand to it.  A second window then
scans each segment.  Rows are shuffled by (key, segment), so that one key with a third of
all rows is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _with_carried(rows: DataFrame, keys: Sequence[str], handed: Column, carried: Column, place: int) -> DataFrame:
    """Rows (with __seg and __v) and one more for each segment whose __v is ``carried`` over what other segments hand on (__h).

    __place is ``place`` there and 0 in the rows.
    """
    parts = rows.groupBy(*keys, "__seg").agg(handed.alias("__h")).withColumn("__v", carried).where("__v is not null")
    parts = parts.select(*keys, "__seg", "__v", F.lit(place).alias("__place"))
    return rows.withColumn("__place", F.lit(0)).unionByName(parts, allowMissingColumns=True)


def last_known(rows: DataFrame, out: str, value: str, keys: Sequence[str], order: Sequence[str], segment: Column, ahead: bool = False, once: str | None = None) -> DataFrame:
    """Adds the last non-null ``value`` of the key up to each row, or with ``ahead`` the first from it on.

    ``order`` should have no ties but of rows without a value; ``segment`` grows with it.  Null keys are a key.  Of a key's rows that
    are equal in ``order`` and in the column ``once``, where that is not null, one is kept; ``once`` holds what ``order`` is made of.
    """
    rows = rows.withColumn("__seg", segment).withColumn("__v", F.col(value))
    turn = F.desc if ahead else F.asc  # ahead is behind in the opposite order: a frame up to the last row is computed anew for every row
    over = Window.partitionBy(*keys).orderBy(turn("__seg")).rowsBetween(Window.unboundedPreceding, -1)
    at, known = F.struct(*order), F.col("__v").isNotNull()
    v, when = F.when(known, F.col("__v")), F.when(known, at)
    carried = F.last("__h", ignorenulls=True).over(over)
    every = _with_carried(rows, keys, (F.min_by if ahead else F.max_by)(v, when), carried, 1 if ahead else -1)
    inside = Window.partitionBy(*keys, "__seg").orderBy(*[turn(c) for c in ("__place", *order, *([once] if once else []))])
    found = F.last("__v", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    every = every.withColumn(out, found)
    if once:
        again = F.coalesce(F.col(once) == F.lag(once).over(inside), F.lit(False))  # equal rows are neighbours in the scan, so nothing is dealt again
        every = every.withColumn("__again", again).where("not __again").drop("__again")
    return every.where("__place = 0").drop("__seg", "__v", "__place")


def running_sum(rows: DataFrame, out: str, value: str, keys: Sequence[str], order: Sequence[str], segment: Column) -> DataFrame:
    """Adds the sum of ``value`` over the key's rows up to each row; nulls count as nothing."""
    rows = rows.withColumn("__seg", segment).withColumn("__v", F.col(value))
    carried = F.sum("__h").over(Window.partitionBy(*keys).orderBy("__seg").rowsBetween(Window.unboundedPreceding, -1))
    every = _with_carried(rows, keys, F.sum("__v"), carried, -1)
    inside = Window.partitionBy(*keys, "__seg").orderBy("__place", *order).rowsBetween(Window.unboundedPreceding, 0)
    return every.withColumn(out, F.sum("__v").over(inside)).where("__place = 0").drop("__seg", "__v", "__place")
