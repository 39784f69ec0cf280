"""Market operators on long tables: excess returns, covariances, volatility targets, carry and tilt books.

Series are (asset, day) rows.  A covariance is a long table (day, a, b, c) with a <= b.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.ewm import alpha_of, with_ewm_recursive, with_ewm_var
from tidemark.operators.book import leg_sizes

YEAR = 252.0


def excess_returns(rows: DataFrame, asset: str, day: str, s: str, carry: str, stale: str) -> DataFrame:
    """Adds rx: change of the log price plus a day's share of yesterday's annual carry; null where the quote is stale."""
    w = Window.partitionBy(asset).orderBy(day)
    rx = F.col(s) - F.lag(s).over(w) + F.lag(carry).over(w) / YEAR
    return rows.withColumn("rx", F.when(~F.col(stale), rx))


def dense(rows: DataFrame, asset: str, day: str, value: str) -> DataFrame:
    """(asset, day, value): every asset on every day, 0 where it has no value."""
    grid = rows.select(asset).distinct().crossJoin(rows.select(day).distinct())  # one row an asset and day is what is asked for
    return grid.join(rows.select(asset, day, value), [asset, day], "left").withColumn(value, F.coalesce(value, F.lit(0.0)))


def ewma_cov(rows: DataFrame, asset: str = "ticker", day: str = "day", r: str = "rx", span: float = 60, min_rows: int = 20) -> DataFrame:
    """(day, a, b, c) with a <= b: S = (1 - alpha) * S + alpha * x x', started with the first x x', from row ``min_rows`` on."""
    d = dense(rows, asset, day, r)
    left = d.select(F.col(day).alias("day"), F.col(asset).alias("a"), F.col(r).alias("__p"))
    right = d.select(F.col(day).alias("day"), F.col(asset).alias("b"), F.col(r).alias("__q"))
    pairs = left.join(right, "day").where(F.col("a") <= F.col("b")).withColumn("__x", F.col("__p") * F.col("__q"))
    out = with_ewm_recursive(pairs, "c", F.col("__x"), alpha_of(span=span), ["a", "b"], "day")
    row = F.row_number().over(Window.partitionBy("a", "b").orderBy("day"))
    return out.withColumn("__row", row).where(F.col("__row") >= min_rows).select("day", "a", "b", "c")


def target_scale(weights: DataFrame, cov: DataFrame, target: float, asset: str = "ticker", day: str = "day", w: str = "w") -> DataFrame:
    """(day, k): target / sqrt(252 w'Sw) of each day with weights; null without a covariance, 0 where w'Sw is 0."""
    left = weights.select(F.col(day).alias("day"), F.col(asset).alias("a"), F.col(w).alias("__u"))
    right = weights.select(F.col(day).alias("day"), F.col(asset).alias("b"), F.col(w).alias("__v"))
    both = cov.join(left, ["day", "a"]).join(right, ["day", "b"])
    twice = F.when(F.col("a") == F.col("b"), 1.0).otherwise(2.0)
    var = both.groupBy("day").agg(F.sum(F.col("c") * F.col("__u") * F.col("__v") * twice).alias("__var"))
    days = weights.select(F.col(day).alias("day")).distinct().join(var, "day", "left")
    known = cov.select("day").distinct().withColumn("__known", F.lit(True))
    k = F.when(F.col("__var") > 0, target / F.sqrt(YEAR * F.col("__var"))).when(F.col("__known"), 0.0)
    return days.join(known, "day", "left").select("day", k.alias("k"))


def rolling_vol(rows: DataFrame, asset: str, day: str, r: str, n: int = 60, least: int = 40) -> DataFrame:
    """Adds vol: annual deviation over ``n`` rows, null with fewer than ``least`` values."""
    w = Window.partitionBy(asset).orderBy(day).rowsBetween(-(n - 1), 0)
    return rows.withColumn("vol", F.when(F.count(r).over(w) >= least, F.stddev_samp(r).over(w) * F.lit(YEAR) ** 0.5))


def month_ends(rows: DataFrame, day: str = "day") -> DataFrame:
    return rows.groupBy(F.last_day(day).alias("__month")).agg(F.max(day).alias(day)).select(day)


def carry_legs(rows: DataFrame, asset: str = "ticker", day: str = "day", carry: str = "carry") -> DataFrame:
    """(day, asset, w): long the third with the largest carry, short the third with the smallest, inverse volatility within a leg.

    rows need ``vol``; assets without carry or volatility take no part.
    """
    known = rows.where(F.col(carry).isNotNull() & F.col("vol").isNotNull())
    by = Window.partitionBy(day)
    r = known.withColumn("__n", F.count("*").over(by)).where("__n >= 2")
    r = r.withColumn("__up", F.row_number().over(by.orderBy(F.desc(carry), F.desc(asset)))).withColumn("__down", F.row_number().over(by.orderBy(carry, asset)))
    leg = F.when(F.col("__up") <= leg_sizes("__n"), 1).when(F.col("__down") <= leg_sizes("__n"), -1)
    r = r.withColumn("__leg", leg).where("__leg is not null").withColumn("__iv", 1 / F.col("vol"))
    return r.select(day, asset, (F.col("__leg") * F.col("__iv") / F.sum("__iv").over(Window.partitionBy(day, "__leg"))).alias("w"))


def scaled(weights: DataFrame, cov: DataFrame, target: float, keep_unscaled: bool, asset: str = "ticker", day: str = "day") -> DataFrame:
    """Weights times the day's scale; days without a covariance keep their weights or have none."""
    k = target_scale(weights, cov, target, asset, day)
    k = k.withColumn("k", F.coalesce("k", F.lit(1.0))) if keep_unscaled else k.where("k is not null")
    return weights.join(k, day).select(day, asset, (F.col("w") * F.col("k")).alias("w"))


def held(weights: DataFrame, days: DataFrame, day: str = "day") -> DataFrame:
    """The weights of the last rebalance at or before each day; ``weights`` has rows on rebalance days only."""
    dates = weights.select(F.col(day).alias("__from")).distinct()
    until = dates.withColumn("__to", F.lead("__from").over(Window.orderBy("__from")))  # a row a rebalance
    on = days.select(day).distinct().join(until, (F.col(day) >= F.col("__from")) & (F.col("__to").isNull() | (F.col(day) < F.col("__to"))))
    return on.drop("__to").join(weights.withColumnRenamed(day, "__from"), "__from").drop("__from")


def list_tilt(rows: DataFrame, side: Column, asset: str = "ticker", day: str = "day") -> DataFrame:
    """(day, asset, w): +1 and -1 dealt by inverse volatility over two fixed lists; no row on days on which a listed volatility is null.

    ``side`` is 1, -1 or null by asset; rows need ``vol``.
    """
    r = rows.withColumn("__side", side).where("__side is not null")
    listed = r.select(asset).distinct().agg(F.count("*").alias("__listed"))
    r = r.crossJoin(listed).withColumn("__known", F.count("vol").over(Window.partitionBy(day))).where("__known = __listed")
    r = r.withColumn("__iv", 1 / F.col("vol"))
    return r.select(day, asset, (F.col("__side") * F.col("__iv") / F.sum("__iv").over(Window.partitionBy(day, "__side"))).alias("w"))


def raw_positions(rows: DataFrame, forecast: str, r: str, span: float = 60, least: int = 20, demean: bool = False, asset: str = "ticker", day: str = "day") -> DataFrame:
    """(asset, day, pos): forecast over variance; forecasts under 1e-9 and unknown or zero variances give 0.

    With ``demean`` the forecast is taken from its mean over the assets of the day.
    """
    y = F.col(forecast) - F.avg(forecast).over(Window.partitionBy(day)) if demean else F.col(forecast)
    v = with_ewm_var(rows, "__var", F.col(r), alpha_of(span=span), [asset], day)
    seen = F.count(r).over(Window.partitionBy(asset).orderBy(day))
    v = v.withColumn("__y", F.when(F.abs(y) > 1e-9, y).otherwise(0.0)).withColumn("__seen", seen)
    pos = F.when((F.col("__seen") >= least) & (F.col("__var") > 0), F.col("__y") / F.col("__var"))
    return v.select(asset, day, F.coalesce(pos, F.lit(0.0)).alias("pos"))


def overlay(base: DataFrame, tilt: DataFrame, exposure: DataFrame, lags: DataFrame, asset: str = "ticker", day: str = "day") -> DataFrame:
    """(asset, day, w): base * mult + tilt * add, where exposure (day, mult, add) acts ``lag`` rows later by asset (asset, lag)."""
    by = Window.partitionBy(asset).orderBy(day)
    e = exposure.crossJoin(F.broadcast(lags))  # one row an asset
    late = F.when(F.col("lag") > 0, F.lag(F.struct("mult", "add")).over(by)).otherwise(F.struct("mult", "add"))
    e = e.withColumn("__e", late).select(asset, day, F.coalesce("__e.mult", F.lit(1.0)).alias("mult"), F.coalesce("__e.add", F.lit(0.0)).alias("add"))
    both = base.select(asset, day, "w", F.lit(0.0).alias("t")).unionByName(tilt.select(asset, day, F.lit(0.0).alias("w"), F.col("w").alias("t")))
    both = both.groupBy(asset, day).agg(F.sum("w").alias("w"), F.sum("t").alias("t"))
    return both.join(e, [asset, day]).select(asset, day, (F.col("w") * F.col("mult") + F.col("t") * F.col("add")).alias("w"))
