"""Queries over returns and positions: performance, risk, P&L, regressions, resampling."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.common import rnd
from tidemark.operators import book, regress, resample, stats
from tidemark.plans.base import MARKET, RETURNS, market_long, returns, sql, table
from tidemark.plans.q_joins import WIN, windows
from tidemark.plans.registry import query

STAT = """count(r) AS n, round(product(1 + r) - 1, 6) + 0.0 AS total_return, round(avg(r) * 252, 6) + 0.0 AS ann_mean, round(stddev_samp(r) * pow(252, 0.5), 6) + 0.0 AS ann_vol,
  round(avg(r) / stddev_samp(r) * pow(252, 0.5), 5) + 0.0 AS sharpe, round(avg(r) / sqrt(sum(CASE WHEN r < 0 THEN r * r ELSE 0 END) / count(r)) * pow(252, 0.5), 5) + 0.0 AS sortino,
  round(avg(CASE WHEN r > 0 THEN 1.0::DOUBLE ELSE 0 END), 6) + 0.0 AS hit_rate, round(skewness(r), 4) + 0.0 AS skew, round(kurtosis(r), 4) + 0.0 AS kurt, round(avg(r) / stddev_samp(r) * sqrt(count(r)), 5) + 0.0 AS t_mean"""


def stat_out(df, *keys):
    digits = {"total_return": 6, "ann_mean": 6, "ann_vol": 6, "sharpe": 5, "sortino": 5, "hit_rate": 6, "skew": 4, "kurt": 4, "t_mean": 5}
    return df.select(*keys, "n", *[rnd(c, d).alias(c) for c, d in digits.items()])


@query("conditional_perf", sql(RETURNS, ", q AS (SELECT ticker, quantile_cont(value, 0.333::DOUBLE) AS a, quantile_cont(value, 0.667::DOUBLE) AS b FROM rt GROUP BY 1) SELECT rt.ticker, CASE WHEN value <= a THEN 'low' WHEN value <= b THEN 'mid' ELSE 'high' END AS bucket, count(*) AS n, round(avg(r) * 252, 6) + 0.0 AS mean, round(avg(CASE WHEN r > 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS hit FROM rt JOIN q ON q.ticker = rt.ticker WHERE r IS NOT NULL GROUP BY 1, 2").replace(")\n, q", "), q"))
def _(spark, sf):
    r = returns(spark, sf)
    q = r.groupBy("ticker").agg(F.percentile("value", 0.333).alias("a"), F.percentile("value", 0.667).alias("b"))
    bucket = F.when(F.col("value") <= F.col("a"), "low").when(F.col("value") <= F.col("b"), "mid").otherwise("high")
    return r.where("r is not null").join(q, "ticker").groupBy("ticker", bucket.alias("bucket")).agg(F.count("*").alias("n"), rnd(F.avg("r") * 252).alias("mean"), F.round(F.avg(F.when(F.col("r") > 0, 1.0).otherwise(0.0)), 6).alias("hit"))


@query("concentration_hhi", "SELECT c_mktsegment, round(sum(share * share), 8) + 0.0 AS hhi FROM (SELECT c_mktsegment, abs(t) / sum(abs(t)) OVER (PARTITION BY c_mktsegment) AS share FROM (SELECT c_mktsegment, c_nationkey, sum(c_acctbal) AS t FROM customer GROUP BY 1, 2)) GROUP BY 1")
def _(spark, sf):
    return stats.hhi(table(spark, sf, "customer"), ["c_mktsegment"], "c_nationkey", "c_acctbal").select("c_mktsegment", rnd("hhi", 8).alias("hhi"))


@query("concentration_month", sql(RETURNS, "SELECT ticker, round(sum(share * share), 8) + 0.0 AS hhi FROM (SELECT ticker, abs(t) / sum(abs(t)) OVER (PARTITION BY ticker) AS share FROM (SELECT ticker, date_trunc('month', day) AS m, sum(r) AS t FROM rt GROUP BY 1, 2)) GROUP BY 1"))
def _(spark, sf):
    return stats.hhi(returns(spark, sf).withColumn("m", F.trunc("day", "month")), ["ticker"], "m", "r").select("ticker", rnd("hhi", 8).alias("hhi"))


@query("episode_returns", sql(RETURNS + ", " + WIN, "SELECT name, ticker, count(r) AS n, round(product(1 + r) - 1, 6) + 0.0 AS total, round(min(r), 6) + 0.0 AS worst FROM rt JOIN w ON day BETWEEN a AND b GROUP BY 1, 2"))
def _(spark, sf):
    r = returns(spark, sf).join(windows(spark), F.col("day").between(F.col("a"), F.col("b")))
    return r.groupBy("name", "ticker").agg(F.count("r").alias("n"), rnd(stats.compounded("r")).alias("total"), rnd(F.min("r")).alias("worst"))


@query("resample_week", sql(RETURNS, "SELECT ticker, (day + CAST((12 - isodow(day)) % 7 AS INT))::DATE AS week, round(sum(r), 7) + 0.0 AS r FROM rt GROUP BY 1, 2 HAVING count(r) > 0"))
def _(spark, sf):
    friday = F.next_day(F.date_sub("day", 1), "Fri")
    return returns(spark, sf).where("r is not null").groupBy("ticker", friday.alias("week")).agg(rnd(F.sum("r"), 7).alias("r"))


@query("resample_month", sql(RETURNS, "SELECT ticker, last_day(day) AS month_end, round(sum(r), 7) + 0.0 AS r, arg_max(value, day) AS last_value FROM rt GROUP BY 1, 2"))
def _(spark, sf):
    return returns(spark, sf).groupBy("ticker", F.last_day("day").alias("month_end")).agg(rnd(F.sum("r"), 7).alias("r"), F.max_by("value", "day").alias("last_value"))


@query("weekly_multi_agg", sql(RETURNS, "SELECT ticker, (day + CAST((12 - isodow(day)) % 7 AS INT))::DATE AS week, round(avg(value), 6) + 0.0 AS mean_value, sum(n)::BIGINT AS n FROM rt GROUP BY 1, 2"))
def _(spark, sf):
    return returns(spark, sf).groupBy("ticker", F.next_day(F.date_sub("day", 1), "Fri").alias("week")).agg(rnd(F.avg("value")).alias("mean_value"), F.sum("n").alias("n"))


@query("histogram", sql(RETURNS, "SELECT ticker, least(floor((r - lo) / ((hi - lo) / 12)), 11)::INT AS bin, count(*) AS n FROM (SELECT *, min(r) OVER (PARTITION BY ticker) AS lo, max(r) OVER (PARTITION BY ticker) AS hi FROM rt WHERE r IS NOT NULL) GROUP BY 1, 2"))
def _(spark, sf):
    return stats.histogram(returns(spark, sf).where("r is not null"), "r", 12, ["ticker"])


@query("month_end_share", sql(MARKET, "SELECT ticker, round(avg(CASE WHEN v >= 140000 THEN 1.0::DOUBLE ELSE 0 END), 6) AS share FROM (SELECT ticker, last_day(day), arg_max(value, day) AS v FROM ml GROUP BY 1, 2) GROUP BY 1"))
def _(spark, sf):
    m = market_long(spark, sf).groupBy("ticker", F.last_day("day")).agg(F.max_by("value", "day").alias("v"))
    return m.groupBy("ticker").agg(F.round(F.avg(F.when(F.col("v") >= 140000, 1.0).otherwise(0.0)), 6).alias("share"))


@query("event_info", sql(RETURNS, "SELECT ticker, count(*) FILTER (abs(r) > 0.03) AS n, coalesce(string_agg(CAST(day AS VARCHAR), ',' ORDER BY day) FILTER (abs(r) > 0.03), '') AS dates FROM rt GROUP BY 1"))
def _(spark, sf):
    hit = F.abs("r") > 0.03
    return returns(spark, sf).groupBy("ticker").agg(F.count_if(hit).alias("n"), F.array_join(F.array_sort(F.collect_list(F.when(hit, F.col("day").cast("string")))), ",").alias("dates"))


@query("index_change_between", sql(RETURNS + ", " + WIN, "SELECT name, ticker, round(arg_max(value, day) - arg_min(value, day), 6) + 0.0 AS change, round(avg(value), 6) + 0.0 AS mean, round(arg_min(r, day) FILTER (r IS NOT NULL), 8) + 0.0 AS signal_start, round(arg_max(r, day) FILTER (r IS NOT NULL), 8) + 0.0 AS signal_end, round(avg(r), 8) + 0.0 AS signal_mean FROM rt JOIN w ON day BETWEEN a AND b GROUP BY 1, 2"))
def _(spark, sf):
    m = returns(spark, sf).join(windows(spark), F.col("day").between(F.col("a"), F.col("b")))
    known = F.when(F.col("r").isNotNull(), F.col("day"))
    return m.groupBy("name", "ticker").agg(
        rnd(F.max_by("value", "day") - F.min_by("value", "day")).alias("change"), rnd(F.avg("value")).alias("mean"),
        rnd(F.min_by("r", known), 8).alias("signal_start"), rnd(F.max_by("r", known), 8).alias("signal_end"), rnd(F.avg("r"), 8).alias("signal_mean"),
    )


@query("window_profile", sql(RETURNS + ", " + WIN, "SELECT name, round(avg(abs(r)), 7) + 0.0 AS mean_abs, round(sum(r), 6) + 0.0 AS pnl, round(avg(CASE WHEN n > 1 THEN 1.0::DOUBLE ELSE 0 END), 6) AS busy FROM rt JOIN w ON day BETWEEN a AND b GROUP BY 1"))
def _(spark, sf):
    r = returns(spark, sf).join(windows(spark), F.col("day").between(F.col("a"), F.col("b")))
    return r.groupBy("name").agg(rnd(F.avg(F.abs("r")), 7).alias("mean_abs"), rnd(F.sum("r")).alias("pnl"), F.round(F.avg(F.when(F.col("n") > 1, 1.0).otherwise(0.0)), 6).alias("busy"))


PRIORITIES = {"urgent": "1-URGENT", "high": "2-HIGH", "medium": "3-MEDIUM", "unset": "4-NOT SPECIFIED", "low": "5-LOW"}


@query("pivot_first", sql(RETURNS, "SELECT year(day)::INT AS y, " + ", ".join(f"count(*) FILTER (ticker = '{t}') AS {n}" for n, t in PRIORITIES.items()) + " FROM rt GROUP BY 1"))
def _(spark, sf):
    n = returns(spark, sf).groupBy(F.year("day").alias("y"), "ticker").agg(F.count("*").alias("n"))
    p = n.groupBy("y").pivot("ticker", list(PRIORITIES.values())).agg(F.first("n")).fillna(0)  # the declared order of all priorities
    return p.select("y", *[F.col(f"`{t}`").alias(n) for n, t in PRIORITIES.items()])


@query("gap_excluding_month", sql(RETURNS, "SELECT round(sum(CASE WHEN ticker = '1-URGENT' THEN r WHEN ticker = '5-LOW' THEN -r END), 6) + 0.0 AS gap, round(sum(CASE WHEN year(day) = 1997 AND month(day) = 5 THEN 0 WHEN ticker = '1-URGENT' THEN r WHEN ticker = '5-LOW' THEN -r END), 6) + 0.0 AS without FROM rt"))
def _(spark, sf):
    x = F.when(F.col("ticker") == "1-URGENT", F.col("r")).when(F.col("ticker") == "5-LOW", -F.col("r"))
    may = (F.year("day") == 1997) & (F.month("day") == 5)
    return returns(spark, sf).agg(rnd(F.sum(x)).alias("gap"), rnd(F.sum(F.when(may, 0.0).otherwise(x))).alias("without"))


@query("sign_agreement", sql(RETURNS, "SELECT b.ticker, round(avg(CASE WHEN sign(a.r) = sign(b.r) THEN 1.0::DOUBLE ELSE 0 END), 6) AS share FROM rt a JOIN rt b ON a.day = b.day AND a.ticker = '1-URGENT' AND b.ticker > a.ticker WHERE a.r IS NOT NULL AND b.r IS NOT NULL GROUP BY 1"))
def _(spark, sf):
    r = returns(spark, sf).where("r is not null").select("ticker", "day", "r")
    a = r.where("ticker = '1-URGENT'").select("day", F.col("r").alias("a"))
    return r.where("ticker > '1-URGENT'").join(a, "day").groupBy("ticker").agg(F.round(F.avg(F.when(F.signum("a") == F.signum("r"), 1.0).otherwise(0.0)), 6).alias("share"))


@query("adjudicate", "SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 1 - quality ELSE quality END AS quality, CASE WHEN doc_id % 10 <> 0 THEN toxic END AS toxic FROM labels")
def _(spark, sf):
    l = table(spark, sf, "labels")
    fix = l.where("doc_id % 10 = 0").select("doc_id", (1 - F.col("quality")).alias("final"))
    return l.join(fix, "doc_id", "left").select("doc_id", F.coalesce("final", "quality").alias("quality"), F.when(F.col("final").isNull(), F.col("toxic")).alias("toxic"))


# -- positions and P&L ----------------------------------------------------------------------------

BOOK = RETURNS + """, bk AS (SELECT ticker, day, r, sign(r) * (1 + n % 3) * 0.2 AS w FROM rt WHERE r IS NOT NULL)"""


def bk(spark, sf):
    return returns(spark, sf).where("r is not null").select("ticker", "day", "r", (F.signum("r") * (1 + F.col("n") % 3) * 0.2).alias("w"))


PNL = BOOK + """, pl AS (SELECT *, coalesce(lag(w) OVER o * r, 0) AS pnl, abs(w - coalesce(lag(w) OVER o, 0)) AS dw FROM bk WINDOW o AS (PARTITION BY ticker ORDER BY day))"""


def pl(spark, sf):
    return book.position_pnl(bk(spark, sf), ["ticker"], "day")


@query("position_pnl", sql(PNL, "SELECT ticker, day, round(pnl, 8) + 0.0 AS pnl FROM pl"))
def _(spark, sf):
    return pl(spark, sf).select("ticker", "day", rnd("pnl", 8).alias("pnl"))


@query("turnover_cost", sql(PNL, "SELECT ticker, round(sum(dw), 5) + 0.0 AS turnover, round(sum(dw) * 0.0002, 8) + 0.0 AS cost FROM pl GROUP BY 1"))
def _(spark, sf):
    return pl(spark, sf).groupBy("ticker").agg(rnd(F.sum("dw"), 5).alias("turnover"), rnd(F.sum("cost"), 8).alias("cost"))


@query("cost_sensitivity", sql(PNL, f"SELECT ticker, m, {STAT} FROM (SELECT ticker, m, pnl - m * dw * 0.0002::DOUBLE AS r FROM pl CROSS JOIN (VALUES (0.0::DOUBLE), (0.5), (1.0), (2.0), (3.0)) g(m)) GROUP BY 1, 2"))
def _(spark, sf):
    """Full statistics of the net return for each multiple of the costs."""
    g = F.broadcast(spark.createDataFrame([(m,) for m in (0.0, 0.5, 1.0, 2.0, 3.0)], "m double"))
    net = pl(spark, sf).crossJoin(g).withColumn("r", F.col("pnl") - F.col("m") * F.col("cost"))
    return stat_out(stats.perf_stats(net, ["ticker", "m"]), "ticker", "m")


@query("static_timing_split", sql(BOOK, "SELECT ticker, round(sum(mw * r), 7) + 0.0 AS static, round(sum((lw - mw) * r), 7) + 0.0 AS timing FROM (SELECT *, avg(w) FILTER (day < DATE '1998-01-01') OVER (PARTITION BY ticker) AS mw, lag(w) OVER (PARTITION BY ticker ORDER BY day) AS lw FROM bk) WHERE lw IS NOT NULL GROUP BY 1"))
def _(spark, sf):
    p = Window.partitionBy("ticker")
    b = bk(spark, sf).withColumn("mw", F.avg(F.when(F.col("day") < F.lit("1998-01-01").cast("date"), F.col("w"))).over(p)).withColumn("lw", F.lag("w").over(p.orderBy("day")))
    return b.where("lw is not null").groupBy("ticker").agg(rnd(F.sum(F.expr("mw * r")), 7).alias("static"), rnd(F.sum(F.expr("(lw - mw) * r")), 7).alias("timing"))


CAPPED = BOOK + """, c1 AS (SELECT *, 0.4 * sum(abs(w)) OVER (PARTITION BY day) AS lim FROM bk), c2 AS (SELECT *, greatest(-lim, least(lim, w)) AS w1, abs(w) > lim AS name_cap FROM c1),
c3 AS (SELECT *, sum(abs(w1)) OVER (PARTITION BY day) AS g FROM c2), c4 AS (SELECT *, g > 1.0 AS gross_cap, w1 * CASE WHEN g > 1.0 THEN 1.0 / g ELSE 1 END AS capped FROM c3)"""


@query("cap_weights", sql(CAPPED, "SELECT ticker, day, round(capped, 7) + 0.0 AS capped FROM c4"))
def _(spark, sf):
    return book.cap_weights(bk(spark, sf), ["day"], 0.4, 1.0).select("ticker", "day", rnd("capped", 7).alias("capped"))


@query("cap_bind_share", sql(CAPPED, "SELECT ticker, round(avg(name_cap::INT::DOUBLE), 6) AS name_cap, round(avg(gross_cap::INT::DOUBLE), 6) AS gross_cap FROM (SELECT ticker, abs(w) > lim + 1e-12 AS name_cap, g > 1.0 + 1e-9 AS gross_cap FROM c4) GROUP BY 1"))
def _(spark, sf):
    c = book.cap_weights(bk(spark, sf), ["day"], 0.4 + 1e-12, 1.0 + 1e-9)
    return c.groupBy("ticker").agg(F.round(F.avg(F.col("name_cap").cast("double")), 6).alias("name_cap"), F.round(F.avg(F.col("gross_cap").cast("double")), 6).alias("gross_cap"))


@query("net_usd", sql(BOOK, "SELECT day, round(-sum(w), 7) + 0.0 AS net, round(sum(abs(w)), 7) + 0.0 AS gross FROM bk GROUP BY 1"))
def _(spark, sf):
    return bk(spark, sf).groupBy("day").agg(rnd(-F.sum("w"), 7).alias("net"), rnd(F.sum(F.abs("w")), 7).alias("gross"))


@query("exposure_stats", sql(BOOK, "SELECT round(avg(g), 6) + 0.0 AS mean, round(quantile_cont(g, 0.5), 6) + 0.0 AS median, round(quantile_cont(g, 0.95), 6) + 0.0 AS p95, round(max(g), 6) + 0.0 AS top FROM (SELECT day, sum(abs(w)) AS g FROM bk GROUP BY 1)"))
def _(spark, sf):
    g = bk(spark, sf).groupBy("day").agg(F.sum(F.abs("w")).alias("g"))
    return g.agg(rnd(F.avg("g")).alias("mean"), rnd(F.percentile("g", 0.5)).alias("median"), rnd(F.percentile("g", 0.95)).alias("p95"), rnd(F.max("g")).alias("top"))


@query("position_profile", sql(BOOK, "SELECT ticker, count(*) AS n, round(avg((w > 0)::INT::DOUBLE), 6) AS long_share, round(avg((w < 0)::INT::DOUBLE), 6) AS short_share, round(avg((coalesce(w, 0) = 0)::INT::DOUBLE), 6) AS flat_share, count(*) FILTER (w IS DISTINCT FROM p) AS n_rebalances FROM (SELECT *, lag(w) OVER (PARTITION BY ticker ORDER BY day) AS p FROM bk) GROUP BY 1"))
def _(spark, sf):
    b = bk(spark, sf).withColumn("moved", ~F.col("w").eqNullSafe(F.lag("w").over(Window.partitionBy("ticker").orderBy("day"))))
    share = lambda c: F.round(F.avg(c.cast("double")), 6)
    return b.groupBy("ticker").agg(
        F.count("*").alias("n"), share(F.col("w") > 0).alias("long_share"), share(F.col("w") < 0).alias("short_share"),
        share(F.coalesce("w", F.lit(0.0)) == 0).alias("flat_share"), F.count_if("moved").alias("n_rebalances"),
    )


@query("composition", sql(BOOK, """, cg AS (SELECT *, abs(w) / nullif(sum(abs(w)) OVER (PARTITION BY day), 0) AS sh FROM bk), cw AS (SELECT ticker, (day + CAST((12 - isodow(day)) % 7 AS INT))::DATE AS week, sum(r) AS r FROM bk GROUP BY 1, 2),
cm AS (SELECT week, avg(r) AS m FROM cw GROUP BY 1), cb AS (SELECT ticker, regr_slope(r, m) AS beta FROM cw JOIN cm ON cm.week = cw.week GROUP BY 1)
SELECT cg.ticker, round(avg(w), 6) + 0.0 AS mean_w, round(avg(sh), 6) + 0.0 AS share, round(any_value(beta), 6) + 0.0 AS beta FROM cg JOIN cb ON cb.ticker = cg.ticker GROUP BY 1""").replace(")\n, cg", "), cg"))
def _(spark, sf):
    """Mean weight, mean of the daily shares of the gross, and the slope of weekly returns on those of the average."""
    gross = F.sum(F.abs("w")).over(Window.partitionBy("day"))
    b = bk(spark, sf)
    g = b.withColumn("sh", F.abs("w") / F.when(gross != 0, gross)).groupBy("ticker").agg(rnd(F.avg("w")).alias("mean_w"), rnd(F.avg("sh")).alias("share"))
    weekly = b.groupBy("ticker", F.date_add("day", (11 - F.weekday("day")) % 7).alias("week")).agg(F.sum("r").alias("r"))
    market = weekly.groupBy("week").agg(F.avg("r").alias("m"))
    return g.join(weekly.join(market, "week").groupBy("ticker").agg(rnd(F.regr_slope("r", "m")).alias("beta")), "ticker")


@query("waterfill_cap")
def _(spark, sf):
    c = table(spark, sf, "customer").groupBy("c_mktsegment", "c_nationkey").agg(F.sum(F.abs("c_acctbal")).alias("w"))
    share = c.withColumn("w", F.col("w") / F.sum("w").over(Window.partitionBy("c_mktsegment")))
    return book.waterfill(share, ["c_mktsegment"], "w", 0.06, "c_nationkey").select("c_mktsegment", "c_nationkey", rnd("w").alias("w"), rnd("filled").alias("filled"))


@query("timing_exposure", sql(RETURNS, ", ri AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY day) AS i FROM rt), s AS (SELECT *, i - last_value(CASE WHEN abs(r) > 0.02 THEN i END IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY day) AS g FROM ri) SELECT ticker, day, CASE WHEN g IS NULL OR g >= 4 THEN 1.0::DOUBLE ELSE 0.25::DOUBLE + 0.75::DOUBLE * g / 4 END AS e FROM s").replace(")\n, ri", "), ri"))
def _(spark, sf):
    w = Window.partitionBy("ticker").orderBy("day")
    r = returns(spark, sf).withColumn("i", F.row_number().over(w))
    r = r.withColumn("g", F.col("i") - F.last(F.when(F.abs("r") > 0.02, F.col("i")), True).over(w))
    return r.select("ticker", "day", book.timing_exposure("g", 0.25, 4).alias("e"))


@query("escalation_step", sql(MARKET, "SELECT ticker, day, CASE WHEN z IS NULL THEN 1.0::DOUBLE WHEN z > 200000 THEN 0 WHEN z > 140000 THEN 0.5 ELSE 1 END AS step FROM (SELECT ticker, day, last_value(CASE WHEN day = m THEN value END IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY day) AS z FROM (SELECT *, max(day) OVER (PARTITION BY ticker, last_day(day)) AS m FROM ml))"))
def _(spark, sf):
    m = market_long(spark, sf).withColumn("m", F.max("day").over(Window.partitionBy("ticker", F.last_day("day"))))
    z = m.withColumn("z", F.last(F.when(F.col("day") == F.col("m"), F.col("value")), True).over(Window.partitionBy("ticker").orderBy("day")))
    return z.select("ticker", "day", F.when(F.col("z").isNull(), 1.0).when(F.col("z") > 200000, 0.0).when(F.col("z") > 140000, 0.5).otherwise(1.0).alias("step"))


@query("phase_summary", sql(RETURNS, ", ri AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY day) % 20 AS o FROM rt), p AS (SELECT ticker, o, round(avg(r), 9) AS m FROM ri GROUP BY 1, 2) SELECT ticker, round(avg(m), 8) + 0.0 AS mean, round(min(m), 8) + 0.0 AS lo, round(max(m), 8) + 0.0 AS hi, count(*) FILTER (m > 0) AS n_pos, round(max(m) FILTER (o = 0), 8) + 0.0 AS published, 1 + count(*) FILTER (m > pub) AS rank FROM (SELECT *, max(m) FILTER (o = 0) OVER (PARTITION BY ticker) AS pub FROM p) GROUP BY 1").replace(")\n, ri", "), ri"))
def _(spark, sf):
    """All 20 offsets against the published one, which is 0; rank 1 is the best."""
    r = returns(spark, sf).withColumn("o", F.row_number().over(Window.partitionBy("ticker").orderBy("day")) % 20)
    p = r.groupBy("ticker", "o").agg(F.round(F.avg("r"), 9).alias("m"))
    p = p.withColumn("pub", F.max(F.when(F.col("o") == 0, F.col("m"))).over(Window.partitionBy("ticker")))
    return p.groupBy("ticker").agg(
        rnd(F.avg("m"), 8).alias("mean"), rnd(F.min("m"), 8).alias("lo"), rnd(F.max("m"), 8).alias("hi"), F.count_if(F.col("m") > 0).alias("n_pos"),
        rnd(F.max("pub"), 8).alias("published"), (1 + F.count_if(F.col("m") > F.col("pub"))).alias("rank"),
    )


# -- regressions ----------------------------------------------------------------------------------


def stacked(spark, sf):
    w = Window.partitionBy("ticker").orderBy("day")
    r = returns(spark, sf)
    return r.select("ticker", "day", F.lead("r").over(w).alias("y"), F.col("r").alias("x1"), F.col("n").cast("double").alias("x2")).dropna()


STACK = RETURNS + ", st AS (SELECT * FROM (SELECT ticker, day, lead(r) OVER (PARTITION BY ticker ORDER BY day) AS y, r AS x1, CAST(n AS DOUBLE) AS x2 FROM rt) WHERE y IS NOT NULL AND x1 IS NOT NULL)"


@query("stack_panel", sql(STACK, "SELECT ticker, day, round(y, 8) + 0.0 AS y, round(x1, 8) + 0.0 AS x1, x2 FROM st"))
def _(spark, sf):
    return stacked(spark, sf).select("ticker", "day", rnd("y", 8).alias("y"), rnd("x1", 8).alias("x1"), "x2")


@query("panel_fe", sql(STACK, "SELECT round(sum(x * y) / sum(x * x), 6) + 0.0 AS coef, count(*) AS n FROM (SELECT x1 - avg(x1) OVER (PARTITION BY ticker) AS x, y - avg(y) OVER (PARTITION BY ticker) AS y FROM st)"))
def _(spark, sf):
    w = regress.within(stacked(spark, sf), "ticker", ["y", "x1"])
    return w.agg(rnd(F.sum(F.col("x1") * F.col("y")) / F.sum(F.col("x1") * F.col("x1"))).alias("coef"), F.count("*").alias("n"))


@query("coef_table")
def _(spark, sf):
    rows = regress.panel_fit(stacked(spark, sf), "ticker", "day", "y", ["x1", "x2"], lags=5)
    out = spark.createDataFrame([(r["regressor"], r["coef"], r["se"], r["t"], r["p"], r["n"]) for r in rows], "regressor string, coef double, se double, t double, p double, n long")
    return out.withColumn("passes", F.col("t") > 3)


@query("driscoll_kraay", sql(STACK, """, d AS (SELECT ticker, day, x1 - avg(x1) OVER (PARTITION BY ticker) AS x, y - avg(y) OVER (PARTITION BY ticker) AS y FROM st), b AS (SELECT sum(x * y) / sum(x * x) AS b, sum(x * x) AS xx FROM d),
h AS (SELECT day, sum(x * (y - b.b * x)) AS h, row_number() OVER (ORDER BY day) AS i FROM d, b GROUP BY day),
v AS (SELECT sum(p.h * q.h * CASE WHEN p.i = q.i THEN 1 ELSE 2 * (1 - (p.i - q.i) / 6.0::DOUBLE) END) AS v FROM h p JOIN h q ON q.i BETWEEN p.i - 5 AND p.i)
SELECT round(b.b, 6) + 0.0 AS coef, round(b.b / (sqrt(v.v) / b.xx), 4) + 0.0 AS t FROM b, v""").replace(")\n, d", "), d"))
def _(spark, sf):
    r = regress.panel_fit(stacked(spark, sf), "ticker", "day", "y", ["x1"], lags=5)[0]
    return spark.createDataFrame([(r["coef"], r["t"])], "coef double, t double").select(rnd("coef").alias("coef"), rnd("t", 4).alias("t"))


# -- resampling -----------------------------------------------------------------------------------


@query("shuffle_within_month", sql(RETURNS, ", sd AS (SELECT s.seed, ticker, day, r, date_trunc('month', day) AS m FROM rt, unnest(generate_series(0, 4)) s(seed)), a AS (SELECT seed, ticker, day, m, row_number() OVER (PARTITION BY seed, ticker, m ORDER BY day) AS k FROM sd), b AS (SELECT seed, ticker, m, r, row_number() OVER (PARTITION BY seed, ticker, m ORDER BY md5('shuffle|' || seed || '|' || ticker || '|' || CAST(day AS VARCHAR))) AS k FROM sd) SELECT a.seed::INT AS seed, a.ticker, a.day, round(b.r, 8) + 0.0 AS r FROM a JOIN b USING (seed, ticker, m, k)").replace(")\n, sd", "), sd"))
def _(spark, sf):
    return resample.shuffle_within_month(returns(spark, sf), 5, ["ticker"], "day", "r").withColumn("r", rnd("r", 8))


BOOT = RETURNS + """,
bs AS (SELECT ticker, r, row_number() OVER w AS i, sum(r) OVER w AS s1, sum(r * r) OVER w AS s2 FROM rt WHERE r IS NOT NULL WINDOW w AS (PARTITION BY ticker ORDER BY day)),
bz AS (SELECT ticker, count(*) AS t FROM bs GROUP BY 1 HAVING count(*) >= 40),
bb AS (SELECT ticker, draw, CAST('0x' || substr(md5('boot|' || ticker || '|' || draw || '|' || b), 1, 8) AS BIGINT) % (t - 19) AS st, least(20, t - b * 20) AS len FROM bz, unnest(generate_series(0, 999)) d(draw), unnest(generate_series(0, (t - 1) // 20)) e(b)),
bq AS (SELECT bb.ticker, draw, sum(len) AS n, sum(y.s1 - coalesce(x.s1, 0)) AS s1, sum(y.s2 - coalesce(x.s2, 0)) AS s2 FROM bb JOIN bs y ON y.ticker = bb.ticker AND y.i = st + len LEFT JOIN bs x ON x.ticker = bb.ticker AND x.i = st GROUP BY 1, 2),
bh AS (SELECT ticker, s1 / n / sqrt((s2 - s1 * s1 / n) / (n - 1)) * sqrt(252) AS sh FROM bq)"""


@query("block_bootstrap_ci", sql(BOOT, "SELECT ticker, count(*) AS draws, round(quantile_cont(sh, 0.05::DOUBLE), 5) + 0.0 AS lo, round(quantile_cont(sh, 0.95::DOUBLE), 5) + 0.0 AS hi FROM bh GROUP BY 1"))
def _(spark, sf):
    b = resample.block_bootstrap(returns(spark, sf).where("r is not null"), 1000, 20, ["ticker"], "day", "r")
    q = b.select("ticker", resample.sharpe_of_sums().alias("sh"))
    return q.groupBy("ticker").agg(F.count("*").alias("draws"), rnd(F.percentile("sh", 0.05), 5).alias("lo"), rnd(F.percentile("sh", 0.95), 5).alias("hi"))
