"""Queries for sinks, carry and overlay books, signal chains and regression sweeps."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.common import rnd
from tidemark.operators.asof import asof_join
from tidemark.plans.base import MARKET, RETURNS, market_long, raw_tape, returns, sql, table
from tidemark.plans.registry import query
from tidemark.sources import files


def scratch(spark):
    return files.shared_path(spark, "files")


def by_ticker():
    return Window.partitionBy("ticker").orderBy("day")


@query("scan_csv_commented", "SELECT n_nationkey, n_name FROM nation")
def _(spark, sf):
    path = scratch(spark)
    n = table(spark, sf, "nation").select(F.concat_ws(",", "n_nationkey", "n_name").alias("value"))
    head = spark.createDataFrame([("# a comment",)], "value string")
    head.unionByName(n).coalesce(1).write.text(path)
    return spark.read.schema("n_nationkey int, n_name string").option("comment", "#").csv(path)


@query("sink_csv_table", "SELECT c_custkey, c_mktsegment, c_acctbal FROM customer")
def _(spark, sf):
    path = scratch(spark)
    files.write_csv(table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal"), path)
    return files.read_csv(spark, path, "c_custkey long, c_mktsegment string, c_acctbal double")


@query("sink_parquet_sorted", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def _(spark, sf):
    path = scratch(spark)
    files.write_sorted(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), path, ["o_custkey", "o_orderkey"])
    return spark.read.parquet(path)


@query("export_registry")
def _(spark, sf):
    units = {"customer": {"c_acctbal": "USD"}, "orders": {"o_totalprice": "USD", "o_orderdate": "UTC"}}
    tables = [(t, lambda t=t: table(spark, sf, t), f"the {t} table", units.get(t, {})) for t in ("nation", "region", "customer", "orders", "not_there")]
    return files.export_registry(tables, scratch(spark), spark)


@query("stress_cost_mult", sql(MARKET, "SELECT ticker, day, CASE WHEN lag(n > 4) OVER (PARTITION BY ticker ORDER BY day) THEN 0.0004::DOUBLE ELSE 0.0002::DOUBLE END AS cost FROM ml"))
def _(spark, sf):
    return market_long(spark, sf).select("ticker", "day", F.when(F.lag(F.col("n") > 4).over(by_ticker()), 0.0004).otherwise(0.0002).alias("cost"))


RI = RETURNS + ", ri AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY day) AS i FROM rt)"


@query("weekend_gap", sql("raw AS (SELECT event_type AS platform, ts, event_id, 0.01::DOUBLE + 0.98::DOUBLE * value / (value + 50) AS price FROM events), f AS (SELECT platform, (CAST(d AS TIMESTAMP) + INTERVAL 17 HOUR) AT TIME ZONE 'America/New_York' AT TIME ZONE 'UTC' AS t1, (CAST(d AS TIMESTAMP) + INTERVAL 65 HOUR) AT TIME ZONE 'America/New_York' AT TIME ZONE 'UTC' AS t2 FROM (SELECT DISTINCT platform, CAST(ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York' AS DATE) AS d FROM raw) WHERE isodow(d) = 5)", "SELECT f.platform, f.t1, round(ln((SELECT arg_min(price, (ts, event_id)) FROM raw WHERE raw.platform = f.platform AND ts >= f.t2) / (SELECT arg_max(price, (ts, event_id)) FROM raw WHERE raw.platform = f.platform AND ts <= f.t1)), 6) + 0.0 AS gap FROM f"))
def _(spark, sf):
    """From the close on Friday at 17:00 to the reopening on Sunday at 17:00, both by the clocks of New York."""
    zone = "America/New_York"
    q = raw_tape(spark, sf).select("platform", "ts", "event_id", "price")
    d = q.select("platform", F.to_date(F.from_utc_timestamp("ts", zone)).alias("d")).distinct().where(F.weekday("d") == 4)
    at = lambda hours: F.to_utc_timestamp(F.col("d").cast("timestamp") + F.expr(f"INTERVAL {hours} HOUR"), zone)
    f = d.select("platform", at(17).alias("t1"), at(65).alias("t2"))
    q = q.where("price is not null")
    a = asof_join(f, q, ["platform"], "t1", "ts", ["price"], "le", ties=["event_id"], segment="day").withColumnRenamed("price", "p1").drop("ts_found")
    b = asof_join(a, q, ["platform"], "t2", "ts", ["price"], "ge", ties=["event_id"], segment="day")
    return b.select("platform", "t1", rnd(F.log(F.col("price") / F.col("p1"))).alias("gap"))


@query("event_study_ci", sql(RI, ", e AS (SELECT ticker, i, sign(r) AS s FROM ri WHERE abs(r) > 0.015) SELECT k::INT AS k, count(*) AS n, round(avg(ri.r * e.s), 8) + 0.0 AS m, round(1.96::DOUBLE * stddev_samp(ri.r * e.s) / sqrt(count(*)), 8) + 0.0 AS half FROM e, unnest(generate_series(-6, 6)) t(k), ri WHERE ri.ticker = e.ticker AND ri.i = e.i + t.k AND ri.r IS NOT NULL GROUP BY 1").replace(")\n, e AS", "), e AS"))
def _(spark, sf):
    r = returns(spark, sf).withColumn("i", F.row_number().over(by_ticker()))
    e = r.where("abs(r) > 0.015").select("ticker", F.col("i").alias("at"), F.signum("r").alias("s"), F.explode(F.sequence(F.lit(-6), F.lit(6))).alias("k"))
    x = e.withColumn("i", F.col("at") + F.col("k")).join(r.select("ticker", "i", "r"), ["ticker", "i"]).where("r is not null").withColumn("x", F.col("r") * F.col("s"))
    return x.groupBy("k").agg(F.count("*").alias("n"), rnd(F.avg("x"), 8).alias("m"), rnd(1.96 * F.stddev_samp("x") / F.sqrt(F.count("*")), 8).alias("half"))
