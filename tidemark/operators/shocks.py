"""Signals of a theme across platforms: early changes, scaled shocks, confirmation, shares of a subset."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.common import clip
from tidemark.functions.ewm import alpha_of, frame_rows, with_ewm_mean
from tidemark.operators.changes import confirmed_shocks, weighted_mean


def with_early_z(rows: DataFrame, k: float = 5.0, key: str = "contract_id", day: str = "day") -> DataFrame:
    """Adds z_early: the change from the day before to the early value, scaled like z; rows need gap and sd."""
    before = F.lag("value").over(Window.partitionBy(key).orderBy(day))
    dv = F.when(F.col("gap") <= 7, (F.col("value_early") - before) / F.sqrt("gap"))
    return rows.withColumn("__dv", dv).withColumn("z_early", F.when(F.col("sd") > 0, clip(F.col("sign") * F.col("__dv") / F.col("sd"), -k, k))).drop("__dv")


def theme_series(rows: DataFrame, keys: Sequence[str], platforms: Sequence[str], subset: Column, day: str = "day") -> DataFrame:
    """Dense daily series of ``keys``: d, d_early, volume_usd, n_contracts, part (of ``subset`` in d) and d by platform."""
    known = rows.where("z is not null").withColumn("__sub", subset)
    part = F.coalesce(F.sum(F.when(F.col("__sub"), F.col("z") * F.col("vol7d"))), F.lit(0.0)) / F.expr("nullif(sum(vol7d), 0)")
    by_platform = [
        (F.sum(F.when(F.col("platform") == p, F.col("z") * F.col("vol7d"))) / F.expr(f"nullif(sum(case when platform = '{p}' then vol7d end), 0)")).alias(f"d_{p}")
        for p in platforms
    ]
    cells = known.groupBy(*keys, day).agg(
        weighted_mean("z", "vol7d").alias("d"),
        weighted_mean("z_early", "vol7d").alias("d_early"),
        F.sum("vol1d").alias("volume_usd"),
        F.count_distinct("contract_id").alias("n_contracts"),
        part.alias("part"),
        *by_platform,
    )
    span = cells.groupBy(*keys).agg(F.min(day).alias("__a"), F.max(day).alias("__b"))
    every = span.withColumn(day, F.explode(F.sequence("__a", "__b", F.expr("INTERVAL 1 DAY")))).select(*keys, day)
    return every.join(cells, [*keys, day], "left").na.fill(0, ["d", "d_early", "volume_usd", "n_contracts", "part"])


def with_sigma(series: DataFrame, keys: Sequence[str], span: float = 60, least: int = 20, day: str = "day") -> DataFrame:
    """Adds sigma: root of the weighted mean square of d over active days, as known the day before."""
    by = Window.partitionBy(*keys).orderBy(day)
    square = F.when(F.col("n_contracts") > 0, F.col("d") * F.col("d"))
    out = with_ewm_mean(series, "__var", square, alpha_of(span=span), keys, day)
    seen = F.count(F.when(F.col("n_contracts") > 0, 1)).over(by)
    out = out.withColumn("__var", F.when(seen >= least, F.col("__var")))
    out = out.withColumn("__var", F.lag("__var").over(by))
    return out.withColumn("sigma", F.sqrt(F.last("__var", ignorenulls=True).over(by))).drop("__var")


def with_shocks(series: DataFrame, keys: Sequence[str], k: float, min_volume: float, pair: tuple[str, str], day: str = "day") -> DataFrame:
    """Adds shock_raw (d over k sigma), confirmed, share (of the subset in a confirmed shock) and mostly (share over a half).

    A shock is confirmed the same day by half the threshold early, enough volume and both platforms of ``pair`` up
    where both are known; or the next day, if it was not confirmed and both days together pass the threshold.
    """
    by = Window.partitionBy(*keys).orderBy(day)
    a, b = (F.col(f"d_{p}") for p in pair)
    s = series.withColumn("__thr", k * F.col("sigma"))
    s = s.withColumn("shock_raw", F.coalesce(F.col("d") > F.col("__thr"), F.lit(False)))
    s = s.withColumn("__ok", (F.col("volume_usd") >= min_volume) & F.coalesce((a > 0) & (b > 0), F.lit(True)))
    s = s.withColumn("c0", F.col("shock_raw") & F.col("__ok") & F.coalesce(F.col("d_early") > 0.5 * F.col("__thr"), F.lit(False)))
    two = F.coalesce(F.lag("d").over(by) + F.col("d") > F.col("__thr"), F.lit(False))
    s = s.withColumn("n", F.coalesce(F.lag("shock_raw").over(by) & F.lag("__ok").over(by), F.lit(False)) & two)
    s = confirmed_shocks(s, keys, day)
    before_part, before_d = F.coalesce(F.lag("part").over(by), F.lit(0.0)), F.coalesce(F.lag("d").over(by), F.lit(0.0))
    total = F.col("d") + before_d
    share = F.when(F.col("shock_raw") & (F.col("d") > 0), F.col("part") / F.col("d")).otherwise((F.col("part") + before_part) / F.when(total != 0, total))
    s = s.withColumn("share", F.when(F.col("confirmed"), share))
    return s.withColumn("mostly", F.coalesce(F.round("share", 9) > 0.5, F.lit(False))).drop("__thr", "__ok", "c0", "n")


def cell_signal(series: DataFrame, keys: Sequence[str], halflife: float | Column = 5.0, longest: float | None = None, least: int = 20, day: str = "day") -> DataFrame:
    """Adds s (weighted mean of d, 0 on inactive days), sd (of earlier s, from the first active day on) and z = s / sd.

    z is 0 until ``least`` active days lie before.  A half-life that differs among keys is a column, with its ``longest`` value.
    """
    by = Window.partitionBy(*keys).orderBy(day)
    past = by.rowsBetween(Window.unboundedPreceding, -1)
    active = F.col("n_contracts") > 0
    if isinstance(halflife, Column):
        alpha, size = 1 - F.pow(F.lit(0.5), 1 / halflife), frame_rows(alpha_of(halflife=longest))
    else:
        alpha, size = alpha_of(halflife=halflife), None
    out = with_ewm_mean(series, "s", F.when(active, F.col("d")).otherwise(0.0), alpha, keys, day, size)
    out = out.withColumn("__before", F.count(F.when(active, 1)).over(past))
    out = out.withColumn("__s", F.when(F.col("__before") > 0, F.col("s")))
    out = out.withColumn("sd", F.when(F.count("__s").over(past) >= least, F.stddev_samp("__s").over(past)))
    z = F.when((F.col("__before") >= least) & (F.col("sd") > 0), F.col("s") / F.col("sd"))
    return out.withColumn("z", F.coalesce(z, F.lit(0.0))).drop("__before", "__s")
