"""Stand-in inputs: the given tables read as a tape, a label table, market prices and signals.

Each function has a SQL counterpart (a CTE) for the DuckDB side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import grid, tape

CUTOFF = "2024-01-21 16:00:00"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def raw_tape(spark, sf) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("event_type").alias("platform"),
        F.col("user_id").cast("string").alias("platform_id"),
        "user_id",
        F.col("ts").cast("timestamp").alias("ts"),
        "event_id",
        (F.lit(0.01) + F.lit(0.98) * F.col("value") / (F.col("value") + 50)).alias("price"),
        F.col("value").alias("size"),
        (F.col("event_id") % 2 == 0).alias("is_yes"),
    )


def trades(spark, sf) -> DataFrame:
    return tape.with_snapshot(tape.yes_trades(raw_tape(spark, sf)))


def panel(spark, sf) -> DataFrame:
    return tape.market_day_panel(trades(spark, sf))


RAW = """raw AS (SELECT event_type AS platform, CAST(user_id AS VARCHAR) AS platform_id, user_id, ts, event_id,
  0.01::DOUBLE + 0.98::DOUBLE * value / (value + 50) AS price, value AS size, event_id % 2 = 0 AS is_yes FROM events)"""
TRADES = (
    RAW
    + """,
tr0 AS (SELECT *, CASE WHEN is_yes THEN price ELSE 1 - price END AS px, abs(price * size) AS usd,
  (ts AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/London' AS lts FROM raw WHERE price > 0 AND price < 1),
tr AS (SELECT *, CAST(lts AS DATE) + CASE WHEN CAST(lts AS TIME) < TIME '16:00:00' THEN 0 ELSE 1 END AS snap_date,
  CAST(lts AS TIME) >= TIME '15:00:00' AND CAST(lts AS TIME) < TIME '16:00:00' AS late,
  NOT (CAST(lts AS TIME) >= TIME '14:00:00' AND CAST(lts AS TIME) < TIME '16:00:00') AS early FROM tr0)"""
)
PANEL = (
    TRADES
    + """,
pn AS (SELECT platform, platform_id, snap_date, arg_max(px, (ts, event_id)) AS px_last,
  sum(px * usd) FILTER (late) / nullif(sum(usd) FILTER (late), 0) AS px_vwap_1h, max(ts) AS last_ts,
  arg_max(px, (ts, event_id)) FILTER (early) AS px_early, max(ts) FILTER (early) AS early_ts,
  sum(usd) AS volume_usd, coalesce(sum(usd) FILTER (late), 0) AS volume_late_usd, count(*) AS n_trades
  FROM tr GROUP BY platform, platform_id, snap_date)"""
)


def markets(spark, sf) -> DataFrame:
    """One row a contract: its life in days and its labels."""
    uid = F.col("platform_id").cast("long")
    return (
        panel(spark, sf)
        .groupBy("platform", "platform_id")
        .agg(F.min("snap_date").alias("created"), F.max("snap_date").alias("last_day"))
        .select(
            "platform",
            "platform_id",
            F.concat_ws(":", "platform", "platform_id").alias("contract_id"),
            "created",
            F.date_add("last_day", (uid % 40).cast("int")).alias("closes"),
            F.col("platform").alias("zone"),
            (uid % 5).cast("int").alias("theme"),
            F.when(uid % 2 == 0, 1).otherwise(-1).alias("sign"),
            (uid % 3 == 0).alias("is_deadline"),
            (uid % 11 == 0).alias("partition"),
            (uid % 5).cast("double").alias("bucket_value"),
            F.expr("platform_id div 5").cast("long").alias("event_no"),
        )
    )


MARKETS = (
    PANEL
    + """,
mk AS (SELECT platform, platform_id, platform || ':' || platform_id AS contract_id, min(snap_date) AS created,
  max(snap_date) + CAST(any_value(CAST(platform_id AS BIGINT)) % 40 AS INT) AS closes, platform AS zone,
  CAST(CAST(platform_id AS BIGINT) % 5 AS INT) AS theme,
  CASE WHEN CAST(platform_id AS BIGINT) % 2 = 0 THEN 1 ELSE -1 END AS sign,
  CAST(platform_id AS BIGINT) % 3 = 0 AS is_deadline, CAST(platform_id AS BIGINT) % 11 = 0 AS partition,
  CAST(CAST(platform_id AS BIGINT) % 5 AS DOUBLE) AS bucket_value, CAST(platform_id AS BIGINT) // 5 AS event_no
  FROM pn GROUP BY platform, platform_id)"""
)


def days(spark, sf, contracts: DataFrame | None = None) -> DataFrame:
    """Contract-day panel with value, stale and eligible; ``contracts`` are markets with further columns."""
    d = grid.contract_days(markets(spark, sf) if contracts is None else contracts, panel(spark, sf))
    return (
        d.withColumn("value", grid.contract_value("px"))
        .withColumn("value_early", grid.contract_value("px_early"))
        .withColumn("stale", grid.stale())
        .withColumn("eligible", grid.eligible(20.0))
    )


DAYS = (
    MARKETS
    + """,
cd0 AS (SELECT mk.*, CAST(unnest(generate_series(created, closes, INTERVAL 1 DAY)) AS DATE) AS day FROM mk),
cd1 AS (SELECT c.*, last_value(px_last IGNORE NULLS) OVER w AS px, last_value(last_ts IGNORE NULLS) OVER w AS last_ts,
  px_early AS pe, coalesce(volume_usd, 0) AS vol1d, CAST(closes - c.day AS DOUBLE) AS ttr_days
  FROM cd0 c LEFT JOIN pn ON pn.platform = c.platform AND pn.platform_id = c.platform_id AND pn.snap_date = c.day
  WINDOW w AS (PARTITION BY c.platform, c.platform_id ORDER BY c.day)),
cd2 AS (SELECT *, sum(vol1d) OVER (PARTITION BY platform, platform_id ORDER BY day RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW) AS vol7d,
  coalesce(pe, lag(px) OVER (PARTITION BY platform, platform_id ORDER BY day)) AS px_early FROM cd1),
cd AS (SELECT *, CASE WHEN is_deadline THEN CASE WHEN px IS NOT NULL THEN -ln(1 - greatest(0.001::DOUBLE, least(0.999::DOUBLE, px))) END / (greatest(ttr_days, 3.0::DOUBLE) / 365.25::DOUBLE) ELSE px END AS value,
  CASE WHEN is_deadline THEN CASE WHEN px_early IS NOT NULL THEN -ln(1 - greatest(0.001::DOUBLE, least(0.999::DOUBLE, px_early))) END / (greatest(ttr_days, 3.0::DOUBLE) / 365.25::DOUBLE) ELSE px_early END AS value_early,
  last_ts IS NULL OR (epoch(CAST(day AS TIMESTAMP)) + 16 * 3600 - floor(epoch(last_ts))) > 48 * 3600 AS stale,
  coalesce(px BETWEEN 0.02 AND 0.98 AND vol7d >= 20 AND ttr_days BETWEEN 3 AND 365, false) AS eligible FROM cd2)"""
)


def market_long(spark, sf) -> DataFrame:
    """Long market data: (day, ticker, field, value), one daily mean price a ticker, sparse."""
    return (
        table(spark, sf, "orders")
        .groupBy(F.to_date("o_orderdate").alias("day"), F.col("o_orderpriority").alias("ticker"))
        .agg(F.avg("o_totalprice").alias("value"), F.count("*").alias("n"))
        .withColumn("field", F.lit("last"))
    )


def returns(spark, sf) -> DataFrame:
    """(ticker, day, s, r): log price and log return on the days a ticker is quoted, scaled to daily size."""
    w = Window.partitionBy("ticker").orderBy("day")
    m = market_long(spark, sf).withColumn("s", F.log("value"))
    return m.withColumn("r", (F.col("s") - F.lag("s").over(w)) / 100).select("ticker", "day", "s", "r", "value", "n")


MARKET = """ml AS (SELECT CAST(o_orderdate AS DATE) AS day, o_orderpriority AS ticker, avg(o_totalprice) AS value, count(*) AS n, 'last' AS field
  FROM orders GROUP BY 1, 2)"""
RETURNS = (
    MARKET
    + """,
rt AS (SELECT ticker, day, ln(value) AS s, (ln(value) - lag(ln(value)) OVER (PARTITION BY ticker ORDER BY day)) / 100 AS r, value, n FROM ml)"""
)


def sql(ctes: str, select: str) -> str:
    return f"WITH {ctes}\n{select}"
