"""Calendars, dense grids and the contract-day panel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.common import hazard


def calendar_days(spark: SparkSession, start: str, end: str) -> DataFrame:
    return spark.range(1).select(
        F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"), F.expr("INTERVAL 1 DAY"))).alias("day")
    )


def business_days(spark: SparkSession, start: str, end: str) -> DataFrame:
    return calendar_days(spark, start, end).where(F.weekday("day") < 5)


def dense_days(keys: DataFrame, start: str, end: str, day: str = "day") -> DataFrame:
    """One row a key and day from ``start`` to ``end``; keys whose span is empty give no row."""
    span = F.sequence(F.col(start), F.col(end), F.expr("INTERVAL 1 DAY"))
    return keys.where(F.col(start) <= F.col(end)).withColumn(day, F.explode(span))


def forward_fill(value: str, *keys: str, day: str = "day") -> Column:
    return F.last(value, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(day))


def trailing_sum(value: str, n_days: int, *keys: str, day: str = "day") -> Column:
    """Sum over the last ``n_days`` calendar days, this one among them."""
    w = Window.partitionBy(*keys).orderBy(F.unix_date(day)).rangeBetween(-(n_days - 1), 0)
    return F.sum(value).over(w)


def contract_days(markets: DataFrame, panel: DataFrame) -> DataFrame:
    """Dense contract-day panel.

    markets: platform, platform_id, created, closes (days), sign; panel: a market-day panel.
    Prices are carried forward, volumes of days without trades are 0, and the early value falls
    back on the price of the day before.
    """
    key = ("platform", "platform_id")
    # Dealt to a fixed number of partitions: adaptive execution would size them by the few rows before the days are laid
    # out.  The keys stand in another order than in an aggregate below, beside which the exchange would be taken out.
    dealt = markets.repartition(int(markets.sparkSession.conf.get("spark.sql.shuffle.partitions")), *reversed(key))
    dense = dense_days(dealt, "created", "closes").join(panel.withColumnRenamed("snap_date", "day"), [*key, "day"], "left")
    filled = dense.select(
        *markets.columns,
        "day",
        forward_fill("px_last", *key).alias("px"),
        forward_fill("last_ts", *key).alias("last_ts"),
        "px_early",
        F.coalesce("volume_usd", F.lit(0.0)).alias("vol1d"),
        F.datediff("closes", "day").cast("double").alias("ttr_days"),
    )
    week = Window.partitionBy(*key).orderBy("day").rowsBetween(-6, 0)  # every day has its row
    filled = filled.withColumn("vol7d", F.sum("vol1d").over(week))
    before = F.lag("px").over(Window.partitionBy(*key).orderBy("day"))
    return filled.withColumn("px_early", F.coalesce("px_early", before))


def stale(last_ts: str = "last_ts", day: str = "day", hours: int = 48, snap_hour: int = 16) -> Column:
    """No trade yet, or the last one more than ``hours`` before the day's snapshot."""
    snap = F.unix_seconds(F.col(day).cast("timestamp")) + snap_hour * 3600
    return F.col(last_ts).isNull() | (snap - F.unix_seconds(last_ts) > hours * 3600)


def eligible(min_volume: float | Column, low: float = 0.02, high: float = 0.98, min_ttr: float = 3.0, max_ttr: float = 365.0) -> Column:
    """Price in the band, enough volume and time left; null counts as no."""
    ok = (
        F.col("px").between(low, high)
        & (F.col("vol7d") >= min_volume)
        & F.col("ttr_days").between(min_ttr, max_ttr)
    )
    return F.coalesce(ok, F.lit(False))


def contract_value(px: str = "px") -> Column:
    """Hazard rate of contracts with a deadline, else the price."""
    years = F.greatest(F.col("ttr_days"), F.lit(3.0)) / 365.25
    return F.when(F.col("is_deadline"), hazard(px, years)).otherwise(F.col(px))


def partition_ev(rows: DataFrame) -> DataFrame:
    """Expected bucket value of partitioned events by day: sum(px * v) / sum(px) over priced buckets."""
    priced = F.col("px").isNotNull()
    total = F.sum(F.when(priced, F.col("px")))
    return rows.groupBy("event_key", "day").agg(
        (F.sum(F.when(priced, F.col("px") * F.col("bucket_value"))) / F.when(total != 0, total)).alias("value"),
        total.alias("px_sum"),
        F.count_if(priced).alias("n_buckets"),
        F.max("last_ts").alias("last_ts"),
        F.sum("vol1d").alias("vol1d"),
        F.sum("vol7d").alias("vol7d"),
    )


def with_buckets(rows: DataFrame, event: list[str], day: str = "day") -> DataFrame:
    """Adds n_buckets (priced) and px_sum of the partition rows of an event and day."""
    w = Window.partitionBy(*event, day, "partition")
    return rows.withColumn("n_buckets", F.count("px").over(w)).withColumn("px_sum", F.sum("px").over(w))


def eligible_partition(min_volume: float, min_ttr: float = 3.0, max_ttr: float = 365.0, low: float = 0.5, high: float = 1.5) -> Column:
    """The rule for buckets of a partition: priced, enough volume and time left, two priced buckets at least, prices that add up."""
    ok = (
        F.col("px").isNotNull()
        & (F.col("vol7d") >= min_volume)
        & F.col("ttr_days").between(min_ttr, max_ttr)
        & (F.col("n_buckets") >= 2)
        & F.col("px_sum").between(low, high)
    )
    return F.coalesce(ok, F.lit(False))
