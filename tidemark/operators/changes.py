"""From the contract-day panel to standardised changes, cell indices and shocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.common import clip
from tidemark.functions.ewm import alpha_of, with_ewm_mean
from tidemark.operators.ranks import running_quantile


def gap_scaled_changes(rows: DataFrame, key: Sequence[str] = ("contract_id",), day: str = "day", max_gap: int = 7) -> DataFrame:
    """Adds gap (days since the row before) and dv = change / sqrt(gap); null after gaps over ``max_gap``.

    ``key``, here and below, are the columns of a contract; those by which the rows are already dealt spare a shuffle.
    """
    w = Window.partitionBy(*key).orderBy(day)
    gap = F.datediff(day, F.lag(day).over(w))
    return (
        rows.withColumn("gap", gap)
        .withColumn("dv", F.when(F.col("gap") <= max_gap, (F.col("value") - F.lag("value").over(w)) / F.sqrt("gap")))
        .withColumn("n_past", F.row_number().over(w) - 1)
    )


def past_scale(rows: DataFrame, span: float = 60, key: Sequence[str] = ("contract_id",), day: str = "day") -> DataFrame:
    """Adds own_sd: root of the weighted mean of dv ** 2 over earlier rows."""
    w = Window.partitionBy(*key).orderBy(day)
    smooth = with_ewm_mean(rows, "ewm", F.col("dv") * F.col("dv"), alpha_of(span=span), list(key), day)
    return smooth.withColumn("own_sd", F.sqrt(F.lag("ewm").over(w))).drop("ewm")


def fallback_scale(rows: DataFrame, unit: str = "unit", day: str = "day") -> DataFrame:
    """(unit, day, fallback): 1.4826 x median of abs(dv) over all rows of the unit on earlier days.

    ``rows`` should be a written table: its days and its values are read one after the other.
    """
    past = running_quantile(rows.select(unit, day, F.abs("dv").alias("__x")), rows, [unit], day, "__x", 0.5, strict=True)
    return past.select(unit, day, (F.col("quantile") * 1.4826).alias("fallback"))


def contract_z(rows: DataFrame, k: float = 5.0, min_past: int = 5) -> DataFrame:
    """Adds sd (own if there is enough past, else the fallback) and z = clip(sign * dv / sd)."""
    own = (F.col("n_past") >= min_past) & (F.col("own_sd") > 0)
    sd = F.when(own, F.col("own_sd")).otherwise(F.col("fallback"))
    return rows.withColumn("sd", sd).withColumn("z", F.when(F.col("sd") > 0, clip(F.col("sign") * F.col("dv") / F.col("sd"), -k, k)))


def weighted_mean(x: str, weight: str) -> Column:
    """sum(x * w) / sum(w) over rows where x is known."""
    total = F.sum(F.when(F.col(x).isNotNull(), F.col(weight)))
    return F.sum(F.col(x) * F.col(weight)) / F.when(total != 0, total)


def cell_aggregate(rows: DataFrame, keys: Sequence[str] = ("zone", "theme", "day")) -> DataFrame:
    known = rows.where(F.col("z").isNotNull())
    return known.groupBy(*keys).agg(
        weighted_mean("z", "vol7d").alias("d_vw"),
        F.avg("z").alias("d_ew"),
        F.sum("vol7d").alias("vol7d"),
        F.count_distinct("contract_id").alias("n_contracts"),
    )


def dense_index(cells: DataFrame, keys: Sequence[str] = ("zone", "theme"), value: str = "d_vw", day: str = "day") -> DataFrame:
    """Every day of a cell from its first to its last, changes of missing days 0, and the running level."""
    span = cells.groupBy(*keys).agg(F.min(day).alias("a"), F.max(day).alias("b"))
    every = span.withColumn(day, F.explode(F.sequence("a", "b", F.expr("INTERVAL 1 DAY")))).select(*keys, day)
    dense = every.join(cells, [*keys, day], "left").withColumn(value, F.coalesce(value, F.lit(0.0)))
    w = Window.partitionBy(*keys).orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
    return dense.withColumn("index", F.sum(value).over(w))


def confirmed_shocks(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Adds confirmed, from same_day (c0) and next_day (n) tests without the rule on yesterday's outcome.

    A next-day confirmation needs yesterday not to be confirmed.  Rows with c0 are confirmed and
    rows with neither are not, whatever came before; a chain of next-day rows in between
    alternates, so its parity since the last settled row decides.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    i = F.row_number().over(w)
    settled = F.col("c0") | ~F.col("n")
    base = rows.withColumn("__i", i).withColumn("__at", F.last(F.when(settled, F.col("__i")), True).over(w))
    base = base.withColumn("__v", F.last(F.when(settled, F.col("c0")), True).over(w))
    odd = (F.col("__i") - F.coalesce("__at", F.lit(0))) % 2 == 1
    start = F.coalesce("__v", F.lit(False))
    return base.withColumn("confirmed", F.when(odd, ~start).otherwise(start)).drop("__i", "__at", "__v")
