"""Exponentially weighted moments over long series in a constant number of steps a row.

A series is cut into blocks of so many rows that a weight falls under 1e-16 over one block.
A decayed sum is then a running sum within the block, scaled back, plus the last total of
the block before; blocks further back weigh nothing.  All windows share one shuffle by key.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def alpha_of(span: float | None = None, halflife: float | None = None) -> float:
    return 2 / (span + 1) if span is not None else 1 - 0.5 ** (1 / halflife)


def frame_rows(alpha: float) -> int:
    return math.ceil(math.log(1e-16) / math.log(1 - alpha))


def decayed_sums(
    rows: DataFrame, sums: Mapping[str, tuple[Column, int]], alpha: float | Column, keys: Sequence[str], order: str, size: int | None = None
) -> DataFrame:
    """Adds for each name the sum of value * (1 - alpha) ** (power * age) over all rows so far; nulls count as 0.

    ``sums`` maps names to (value, power), where power is 1 or 2.  An ``alpha`` that differs among keys is a
    column, and ``size`` the block size that its smallest value needs.
    """
    d, size = 1 - alpha, size or frame_rows(alpha)
    d = d if isinstance(d, Column) else F.lit(d)
    by = Window.partitionBy(*keys).orderBy(order)
    out = rows.withColumn("__i", F.row_number().over(by) - 1)
    out = out.withColumn("__block", F.floor(F.col("__i") / size)).withColumn("__pos", (F.col("__i") % size).cast("double"))
    inside = Window.partitionBy(*keys, "__block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    for name, (value, power) in sums.items():
        grow, fall = F.pow(d, -power * F.col("__pos")), F.pow(d, power * F.col("__pos"))
        out = out.withColumn(name, F.sum(F.coalesce(value.cast("double"), F.lit(0.0)) * grow).over(inside) * fall)
    for name, (_, power) in sums.items():
        carried = F.last(F.when(F.col("__pos") == size - 1, F.col(name)), ignorenulls=True).over(before)
        out = out.withColumn(f"__c_{name}", F.coalesce(carried, F.lit(0.0)) * F.pow(d, power * (F.col("__pos") + 1)))
    for name in sums:
        out = out.withColumn(name, F.col(name) + F.col(f"__c_{name}"))
    return out.drop("__i", "__block", "__pos", *[f"__c_{n}" for n in sums])


def with_ewm_mean(
    rows: DataFrame, out: str, value: Column, alpha: float | Column, keys: Sequence[str], order: str, size: int | None = None
) -> DataFrame:
    """Adds the mean with weights (1 - alpha) ** age over all rows so far; null rows only age the others."""
    known = F.when(value.isNotNull(), 1.0)
    sums = decayed_sums(rows, {"__num": (value, 1), "__den": (known, 1)}, alpha, keys, order, size)
    return sums.withColumn(out, F.col("__num") / F.when(F.col("__den") > 0, F.col("__den"))).drop("__num", "__den")


def with_ewm_recursive(rows: DataFrame, out: str, value: Column, alpha: float, keys: Sequence[str], order: str) -> DataFrame:
    """Adds s = (1 - alpha) * s + alpha * x, started with the first x."""
    by = Window.partitionBy(*keys).orderBy(order)
    head = F.when(F.row_number().over(by) == 1, value)
    sums = decayed_sums(rows.withColumn("__head", head), {"__all": (value, 1), "__first": (F.col("__head"), 1)}, alpha, keys, order)
    return sums.withColumn(out, alpha * F.col("__all") + (1 - alpha) * F.col("__first")).drop("__head", "__all", "__first")


def with_ewm_var(rows: DataFrame, out: str, value: Column, alpha: float, keys: Sequence[str], order: str) -> DataFrame:
    """Adds the bias-corrected weighted variance over all rows so far."""
    known = F.when(value.isNotNull(), 1.0)
    sums = {"__w": (known, 1), "__w2": (known, 2), "__s": (value, 1), "__q": (value * value, 1)}
    a = decayed_sums(rows, sums, alpha, keys, order)
    w, w2, s, q = (F.col(c) for c in sums)
    room = w * w - w2
    return a.withColumn(out, F.when(room > 1e-12, (q / w - (s / w) * (s / w)) * w * w / room)).drop(*sums)
