"""Performance, risk and concentration statistics by group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def skewness_sample(x: str) -> Column:
    n = F.count(x).cast("double")
    return F.when(n > 2, F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2))


def kurtosis_sample(x: str) -> Column:
    """Sample-corrected excess kurtosis."""
    n = F.count(x).cast("double")
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x) + 6))


def compounded(r: str) -> Column:
    """Product of 1 + r less 1; a return of -100 % or less counts like any other."""
    return F.product(1 + F.col(r)) - 1


def drawdowns(rows: DataFrame, keys: Sequence[str], order: str, r: str = "r") -> DataFrame:
    """Adds wealth (product of 1 + r) and dd = wealth / its running maximum - 1 (null while that is 0)."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("wealth", F.product(1 + F.col(r)).over(w))
    top = F.max("wealth").over(w)
    return out.withColumn("dd", F.col("wealth") / F.when(top != 0, top) - 1)


def drawdown_episodes(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """One row an episode under water: peak, trough, recovery (null if still under water), depth."""
    w = Window.partitionBy(*keys).orderBy(order)
    e = rows.withColumn("episode", F.sum(F.when(F.col("dd") >= -1e-12, 1).otherwise(0)).over(w))
    g = e.groupBy(*keys, "episode").agg(
        F.min(order).alias("peak"),
        F.min_by(order, F.struct("dd", order)).alias("trough"),
        F.min("dd").alias("depth"),
        F.count("*").alias("n_rows"),
    )
    g = g.withColumn("recovery", F.lead("peak").over(Window.partitionBy(*keys).orderBy("episode")))
    return g.where(F.col("depth") < -1e-12)


def perf_stats(rows: DataFrame, keys: Sequence[str], r: str = "r", year: float = 252.0) -> DataFrame:
    """Per group: n, compounded return, annual mean and volatility, Sharpe, Sortino, hit rate, skew, kurtosis."""
    x = F.col(r)
    n = F.count(r)
    mean, sd = F.avg(r), F.stddev_samp(r)
    down = F.sqrt(F.sum(F.when(x < 0, x * x).otherwise(0.0)) / n)
    return rows.where(x.isNotNull()).groupBy(*keys).agg(
        n.alias("n"),
        compounded(r).alias("total_return"),
        (mean * year).alias("ann_mean"),
        (sd * F.lit(year) ** 0.5).alias("ann_vol"),
        (mean / F.when(sd > 0, sd) * F.lit(year) ** 0.5).alias("sharpe"),
        (mean / F.when(down > 0, down) * F.lit(year) ** 0.5).alias("sortino"),
        F.avg(F.when(x > 0, 1.0).otherwise(0.0)).alias("hit_rate"),
        skewness_sample(r).alias("skew"),
        kurtosis_sample(r).alias("kurt"),
        (mean / F.when(sd > 0, sd) * F.sqrt(n)).alias("t_mean"),
    )


def share_of_abs(value: str, *group: str) -> Column:
    """abs(value) over the group's sum of abs(value)."""
    total = F.sum(F.abs(value)).over(Window.partitionBy(*group))
    return F.abs(value) / F.when(total > 0, total)


def hhi(rows: DataFrame, group: Sequence[str], item: str, value: str) -> DataFrame:
    """(group, hhi): sum of squared shares of abs totals by item."""
    t = rows.groupBy(*group, item).agg(F.sum(value).alias("total")).withColumn("share", share_of_abs("total", *group))
    return t.groupBy(*group).agg(F.sum(F.col("share") * F.col("share")).alias("hhi"))


def histogram(rows: DataFrame, value: str, bins: int, keys: Sequence[str]) -> DataFrame:
    """Equal-width counts between a group's minimum and maximum; the last bin is closed."""
    w = Window.partitionBy(*keys)
    b = rows.withColumn("lo", F.min(value).over(w)).withColumn("hi", F.max(value).over(w))
    at = F.floor((F.col(value) - F.col("lo")) / F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / bins))
    return b.withColumn("bin", F.coalesce(F.least(at, F.lit(bins - 1)), F.lit(0)).cast("int")).groupBy(*keys, "bin").agg(F.count("*").alias("n"))


def perf_table(rows: DataFrame, keys: Sequence[str], order: str, r: str = "r", turnover: str = "dw", gross: str = "g", cost: str = "cost", year: float = 252.0) -> DataFrame:
    """``perf_stats`` with the deepest drawdown and its length in days, Calmar, turnover, holding days, gross and cost drag.

    ``order`` is a day.  A drawdown that goes on is counted to the last day.
    """
    keys = list(keys)
    known = rows.where(F.col(r).isNotNull())
    d = drawdowns(known, keys, order, r)
    last = d.groupBy(*keys).agg(F.max(order).alias("__last"))
    deepest = F.row_number().over(Window.partitionBy(*keys).orderBy(F.round("depth", 12), "peak"))
    worst = drawdown_episodes(d, keys, order).withColumn("__k", deepest).where("__k = 1").join(last, keys)
    worst = worst.select(*keys, F.col("depth").alias("__depth"), F.datediff(F.coalesce("recovery", "__last"), "peak").alias("__days"))
    traded = known.groupBy(*keys).agg(F.avg(turnover).alias("__t"), F.avg(gross).alias("gross"), (F.avg(cost) * year).alias("cost_drag"))
    out = perf_stats(rows, keys, r, year).join(traded, keys).join(worst, keys, "left")
    return (
        out.withColumn("max_drawdown", F.coalesce("__depth", F.lit(0.0)))
        .withColumn("duration", F.coalesce("__days", F.lit(0)))
        .withColumn("calmar", F.col("ann_mean") / -F.col("__depth"))
        .withColumn("turnover", F.col("__t") * year)
        .withColumn("holding_days", F.col("gross") / F.when(F.col("__t") > 0, F.col("__t")))
        .drop("__t", "__depth", "__days")
    )
