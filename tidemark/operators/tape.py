"""From a tape of trades on binary contracts to a market-day panel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.common import local_time, second_of_day

SNAP_SECOND = 16 * 3600
ZONE = "Europe/London"


def archive_and_live(archive: DataFrame, live: DataFrame, cutoff: str, ts: str = "ts") -> DataFrame:
    """Archive rows before the cutoff and live rows from it on; no row counts twice."""
    edge = F.lit(cutoff).cast("timestamp")
    return archive.where(F.col(ts) < edge).unionByName(live.where(F.col(ts) >= edge), allowMissingColumns=True)


def yes_trades(tape: DataFrame) -> DataFrame:
    """Adds px (price of the yes side) and usd (absolute notional); prices outside (0, 1) go."""
    return (
        tape.where((F.col("price") > 0) & (F.col("price") < 1))
        .withColumn("px", F.when(F.col("is_yes"), F.col("price")).otherwise(1 - F.col("price")))
        .withColumn("usd", F.abs(F.col("price") * F.col("size")))
    )


def snapshot_date(ts: str | Column = "ts", zone: str = ZONE, second: int = SNAP_SECOND) -> Column:
    """Day of the first snapshot strictly after the event, in local time."""
    local = local_time(ts, zone)
    return F.date_add(F.to_date(local), F.when(second_of_day(local) < second, 0).otherwise(1))


def is_last_hour(ts: str | Column = "ts", zone: str = ZONE, second: int = SNAP_SECOND) -> Column:
    s = second_of_day(local_time(ts, zone))
    return (s >= second - 3600) & (s < second)


def is_early(ts: str | Column = "ts", hours: int = 2, zone: str = ZONE, second: int = SNAP_SECOND) -> Column:
    """At least ``hours`` before the snapshot that the event belongs to."""
    s = second_of_day(local_time(ts, zone))
    return ~((s >= second - hours * 3600) & (s < second))


def with_snapshot(trades: DataFrame) -> DataFrame:
    """Adds snap_date, late (last hour) and early flags."""
    return (
        trades.withColumn("snap_date", snapshot_date())
        .withColumn("late", is_last_hour())
        .withColumn("early", is_early())
    )


def last_by(value: str, *order: str, where: Column | None = None) -> Column:
    """Value of the last row in ``order``; the order should have no ties."""
    key = F.struct(*order)
    if where is None:
        return F.max_by(value, key)
    return F.max_by(F.when(where, F.col(value)), F.when(where, key))


def vwap(value: str, weight: str, where: Column) -> Column:
    total = F.sum(F.when(where, F.col(weight)))
    return F.sum(F.when(where, F.col(value) * F.col(weight))) / F.when(total != 0, total)


def market_day_panel(trades: DataFrame) -> DataFrame:
    """One row a market and snapshot day with trades: last, early and volume-weighted prices, volumes, count."""
    return trades.groupBy("platform", "platform_id", "snap_date").agg(
        last_by("px", "ts", "event_id").alias("px_last"),
        vwap("px", "usd", F.col("late")).alias("px_vwap_1h"),
        F.max("ts").alias("last_ts"),
        last_by("px", "ts", "event_id", where=F.col("early")).alias("px_early"),
        F.max(F.when(F.col("early"), F.col("ts"))).alias("early_ts"),
        F.sum("usd").alias("volume_usd"),
        F.sum(F.when(F.col("late"), F.col("usd")).otherwise(0.0)).alias("volume_late_usd"),
        F.count("*").alias("n_trades"),
    )


def hourly_last(trades: DataFrame) -> DataFrame:
    """Last price of each market and hour; hours are named by their end."""
    hour = F.date_trunc("hour", "ts") + F.expr("INTERVAL 1 HOUR")
    return trades.groupBy("platform", "platform_id", hour.alias("hour_end")).agg(
        last_by("px", "ts", "event_id").alias("px"), F.sum("usd").alias("usd")
    )


def normalise_candles(candles: DataFrame, key: str, start: str, level: float, inverted: Column) -> DataFrame:
    """Hourly candles (bid, ask, volume) in units of ``level``, stamped by the end of the hour, without empty ones.

    Prices are divided by the power of ten that brings the key's median ask nearest to ``level``; inverted quotes swap
    bid and ask.
    """
    scale = candles.groupBy(key).agg(F.pow(F.lit(10.0), F.round(F.log10(F.percentile("ask", 0.5) / level))).alias("__f"))
    c = candles.join(scale, key).where(F.col("volume") > 0)
    bid, ask = F.col("bid") / F.col("__f"), F.col("ask") / F.col("__f")
    c = c.withColumn("__b", F.when(inverted, 1 / ask).otherwise(bid)).withColumn("__a", F.when(inverted, 1 / bid).otherwise(ask))
    c = c.withColumn("hour_end", F.col(start) + F.expr("INTERVAL 1 HOUR"))
    return c.withColumn("bid", F.col("__b")).withColumn("ask", F.col("__a")).withColumn("mid", (F.col("__b") + F.col("__a")) / 2).drop("__f", "__a", "__b", start)
