"""Queries over contract changes, cell indices, shocks and market series (window functions)."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.common import rnd
from tidemark.functions.ewm import alpha_of, with_ewm_mean, with_ewm_var
from tidemark.operators import changes, ranks, shocks, stats
from tidemark.plans.base import DAYS, MARKET, PANEL, RETURNS, TRADES, days, market_long, panel, returns, sql, table, trades
from tidemark.plans.registry import query
from tidemark.sources.files import written

#: the columns of a contract in the day panel, by which it is dealt
MARKET_KEY = ("platform", "platform_id")


def changed(spark, sf):
    d = days(spark, sf).where("value is not null and not stale").withColumn("unit", F.when(F.col("is_deadline"), "hazard").otherwise("prob"))
    return changes.gap_scaled_changes(d, MARKET_KEY)


CHANGED = (
    DAYS
    + """,
ch AS (SELECT *, CASE WHEN is_deadline THEN 'hazard' ELSE 'prob' END AS unit, day - lag(day) OVER w AS gap,
  CASE WHEN day - lag(day) OVER w <= 7 THEN (value - lag(value) OVER w) / sqrt(day - lag(day) OVER w) END AS dv,
  row_number() OVER w - 1 AS n_past FROM cd WHERE value IS NOT NULL AND NOT stale WINDOW w AS (PARTITION BY contract_id ORDER BY day))"""
)


def z_rows(spark, sf):
    c = written(changes.past_scale(changed(spark, sf), key=MARKET_KEY), "changes")
    return changes.contract_z(c.join(changes.fallback_scale(c), ["unit", "day"], "left"))


Z = (
    CHANGED
    + """,
ew AS (SELECT a.contract_id, a.n_past, sum(b.dv * b.dv * pow(1 - 2 / 61.0::DOUBLE, a.n_past - b.n_past)) / nullif(sum(CASE WHEN b.dv IS NOT NULL THEN pow(1 - 2 / 61.0::DOUBLE, a.n_past - b.n_past) END), 0) AS v
  FROM ch a JOIN ch b ON a.contract_id = b.contract_id AND b.n_past <= a.n_past GROUP BY 1, 2),
fb AS (SELECT p.unit, p.day, quantile_cont(abs(c.dv), 0.5) * 1.4826::DOUBLE AS fallback FROM (SELECT DISTINCT unit, day FROM ch) p JOIN ch c ON c.unit = p.unit AND c.day < p.day AND c.dv IS NOT NULL GROUP BY 1, 2),
zz0 AS (SELECT ch.*, sqrt(ew.v) AS own_sd, fb.fallback FROM ch LEFT JOIN ew ON ew.contract_id = ch.contract_id AND ew.n_past = ch.n_past - 1 LEFT JOIN fb ON fb.unit = ch.unit AND fb.day = ch.day),
zz1 AS (SELECT *, CASE WHEN n_past >= 5 AND own_sd > 0 THEN own_sd ELSE fallback END AS sd FROM zz0),
zz AS (SELECT *, CASE WHEN sd > 0 AND dv IS NOT NULL THEN greatest(-5.0::DOUBLE, least(5.0::DOUBLE, sign * dv / sd)) END AS z FROM zz1)"""
)

CELLS = (
    Z
    + """,
ce AS (SELECT zone, theme, day, sum(z * vol7d) / nullif(sum(vol7d), 0) AS d_vw, avg(z) AS d_ew, sum(vol7d) AS vol7d, count(DISTINCT contract_id) AS n_contracts FROM zz WHERE z IS NOT NULL GROUP BY 1, 2, 3)"""
)


def cells(spark, sf):
    return changes.cell_aggregate(z_rows(spark, sf))


@query("gap_scaled_change", sql(CHANGED, "SELECT contract_id, CAST(day AS DATE) AS day, gap::INT AS gap, round(dv, 6) + 0.0 AS dv FROM ch"))
def _(spark, sf):
    return changed(spark, sf).select("contract_id", "day", "gap", rnd("dv").alias("dv"))


@query("n_past", sql(CHANGED, "SELECT contract_id, CAST(day AS DATE) AS day, n_past::INT AS n_past FROM ch"))
def _(spark, sf):
    return changed(spark, sf).select("contract_id", "day", "n_past")


@query("ewma_var_past", sql(Z, "SELECT contract_id, CAST(day AS DATE) AS day, round(own_sd, 6) + 0.0 AS own_sd FROM zz"))
def _(spark, sf):
    return changes.past_scale(changed(spark, sf), key=MARKET_KEY).select("contract_id", "day", rnd("own_sd").alias("own_sd"))


@query("fallback_median", sql(Z, "SELECT unit, CAST(day AS DATE) AS day, round(fallback, 6) + 0.0 AS fallback FROM fb"))
def _(spark, sf):
    return changes.fallback_scale(written(changed(spark, sf).select("unit", "day", "dv"), "changes")).select("unit", "day", rnd("fallback").alias("fallback"))


@query("own_or_fallback_sd", sql(Z, "SELECT contract_id, CAST(day AS DATE) AS day, round(sd, 6) + 0.0 AS sd FROM zz"))
def _(spark, sf):
    return z_rows(spark, sf).select("contract_id", "day", rnd("sd").alias("sd"))


@query("contract_z", sql(Z, "SELECT contract_id, CAST(day AS DATE) AS day, round(z, 5) + 0.0 AS z FROM zz"))
def _(spark, sf):
    return z_rows(spark, sf).select("contract_id", "day", rnd("z", 5).alias("z"))


@query("cell_aggregate", sql(CELLS, "SELECT zone, theme, CAST(day AS DATE) AS day, round(d_vw, 5) + 0.0 AS d_vw, round(d_ew, 5) + 0.0 AS d_ew, round(vol7d, 3) + 0.0 AS vol7d, n_contracts FROM ce"))
def _(spark, sf):
    return cells(spark, sf).select("zone", "theme", "day", rnd("d_vw", 5).alias("d_vw"), rnd("d_ew", 5).alias("d_ew"), rnd("vol7d", 3).alias("vol7d"), "n_contracts")


INDEX = (
    CELLS
    + """,
sp AS (SELECT zone, theme, CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM ce GROUP BY zone, theme),
ix AS (SELECT sp.zone, sp.theme, sp.day, coalesce(d_vw, 0) AS d_vw, coalesce(n_contracts, 0) AS n_contracts,
  sum(coalesce(d_vw, 0)) OVER (PARTITION BY sp.zone, sp.theme ORDER BY sp.day) AS idx FROM sp LEFT JOIN ce ON ce.zone = sp.zone AND ce.theme = sp.theme AND ce.day = sp.day)"""
)


def index(spark, sf):
    return changes.dense_index(cells(spark, sf)).withColumn("n_contracts", F.coalesce("n_contracts", F.lit(0)))


@query("cumsum_index", sql(INDEX, "SELECT zone, theme, CAST(day AS DATE) AS day, round(d_vw, 5) + 0.0 AS d_vw, round(idx, 4) + 0.0 AS index FROM ix"))
def _(spark, sf):
    return index(spark, sf).select("zone", "theme", "day", rnd("d_vw", 5).alias("d_vw"), rnd("index", 4).alias("index"))


@query("vw_mean_series", sql(Z, "SELECT theme, CAST(day AS DATE) AS day, round(sum(z * vol7d) / nullif(sum(vol7d), 0), 5) + 0.0 AS d FROM zz WHERE z IS NOT NULL GROUP BY 1, 2"))
def _(spark, sf):
    return z_rows(spark, sf).where("z is not null").groupBy("theme", "day").agg(rnd(changes.weighted_mean("z", "vol7d"), 5).alias("d"))


@query("composite_cells", sql(Z, "SELECT 'ALL_EVEN' AS cell, CAST(day AS DATE) AS day, round(avg(z), 5) + 0.0 AS d, count(*) AS n FROM (SELECT DISTINCT contract_id, day, z FROM zz WHERE z IS NOT NULL AND theme IN (0, 2, 4)) GROUP BY day"))
def _(spark, sf):
    some = z_rows(spark, sf).where("z is not null and theme in (0, 2, 4)").select("contract_id", "day", "z").dropDuplicates(["contract_id", "day"])
    return some.groupBy("day").agg(rnd(F.avg("z"), 5).alias("d"), F.count("*").alias("n")).select(F.lit("ALL_EVEN").alias("cell"), "day", "d", "n")


PLATFORMS = ("click", "error", "purchase", "signup", "view")


@query("platform_subindex", sql(Z, ", pf AS (SELECT theme, day, platform, round(sum(z * vol7d) / nullif(sum(vol7d), 0), 5) + 0.0 AS d FROM zz WHERE z IS NOT NULL GROUP BY 1, 2, 3) SELECT theme, CAST(day AS DATE) AS day, " + ", ".join(f"max(d) FILTER (platform = '{p}') AS d_{p}" for p in PLATFORMS) + ", count(d) >= 2 AND min(sign(d)) = max(sign(d)) AS agree FROM pf GROUP BY 1, 2").replace(")\n, pf", "), pf"))
def _(spark, sf):
    rows = z_rows(spark, sf).where("z is not null").groupBy("theme", "day", "platform").agg(rnd(changes.weighted_mean("z", "vol7d"), 5).alias("d"))
    agree = (F.count("d") >= 2) & (F.min(F.signum("d")) == F.max(F.signum("d")))
    return rows.groupBy("theme", "day").agg(*[F.max(F.when(F.col("platform") == p, F.col("d"))).alias(f"d_{p}") for p in PLATFORMS], agree.alias("agree"))


@query("min_events_having", sql(CHANGED, "SELECT theme, CAST(day AS DATE) AS day, count(*) AS n FROM ch GROUP BY 1, 2 HAVING count(DISTINCT event_no) >= 10"))
def _(spark, sf):
    g = changed(spark, sf).groupBy("theme", "day").agg(F.count("*").alias("n"), F.count_distinct("event_no").alias("e"))
    return g.where("e >= 10").drop("e")


@query("subset_contribution", sql(Z, "SELECT theme, CAST(day AS DATE) AS day, round(coalesce(sum(z * vol7d) FILTER (is_deadline), 0) / nullif(sum(vol7d), 0), 5) + 0.0 AS part FROM zz WHERE z IS NOT NULL GROUP BY 1, 2"))
def _(spark, sf):
    zz = z_rows(spark, sf).where("z is not null")
    part = F.sum(F.when(F.col("is_deadline"), F.col("z") * F.col("vol7d")).otherwise(0.0)) / F.expr("nullif(sum(vol7d), 0)")
    return zz.groupBy("theme", "day").agg(rnd(part, 5).alias("part"))


@query("weight_share", sql(Z, "SELECT contract_id, CAST(day AS DATE) AS day, round(vol7d / nullif(sum(vol7d) OVER (PARTITION BY zone, theme, day), 0), 6) + 0.0 AS share FROM zz WHERE z IS NOT NULL"))
def _(spark, sf):
    total = F.sum("vol7d").over(Window.partitionBy("zone", "theme", "day"))
    return z_rows(spark, sf).where("z is not null").select("contract_id", "day", rnd(F.col("vol7d") / F.when(total != 0, total)).alias("share"))


@query("top_moves_per_group", sql(CHANGED, ", dt AS (SELECT day, row_number() OVER (ORDER BY round(sum(abs(dv)), 6) DESC, day) AS day_rank FROM ch WHERE dv IS NOT NULL GROUP BY day), mv AS (SELECT day, contract_id, round(abs(dv), 9) AS a, row_number() OVER (PARTITION BY day ORDER BY round(abs(dv), 9) DESC, contract_id) AS k FROM ch WHERE dv IS NOT NULL) SELECT dt.day_rank::INT AS day_rank, CAST(mv.day AS DATE) AS day, contract_id, k::INT AS k, round(a, 6) + 0.0 AS move FROM mv JOIN dt ON dt.day = mv.day WHERE k <= 3").replace(")\n, dt", "), dt"))
def _(spark, sf):
    """The three largest moves of every day, and the day's place among all days by its movement."""
    c = written(changed(spark, sf).where("dv is not null").select("day", "contract_id", F.round(F.abs("dv"), 9).alias("a"), F.abs("dv").alias("m")), "moves")
    days_ = c.groupBy("day").agg(F.round(F.sum("m"), 6).alias("s"))
    days_ = days_.select("day", F.row_number().over(Window.orderBy(F.desc("s"), "day")).alias("day_rank"))  # a row a day
    w = Window.partitionBy("day").orderBy(F.desc("a"), "contract_id")
    top = c.withColumn("k", F.row_number().over(w)).where("k <= 3").join(days_, "day")
    return top.select("day_rank", "day", "contract_id", "k", rnd("a").alias("move"))


@query("within_day_change", sql(TRADES, "SELECT event_id, round(px - lag(px) OVER (PARTITION BY platform, platform_id, CAST(ts AS DATE) ORDER BY ts, event_id), 6) + 0.0 AS d FROM tr"))
def _(spark, sf):
    w = Window.partitionBy("platform", "platform_id", F.to_date("ts")).orderBy("ts", "event_id")
    return trades(spark, sf).select("event_id", rnd(F.col("px") - F.lag("px").over(w)).alias("d"))


@query("regime_days", sql(INDEX, "SELECT zone, year(day)::INT AS y, count(*) AS n_days, count(*) FILTER (idx < 0) AS n_regime, round(avg(CASE WHEN idx < 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS share FROM ix GROUP BY 1, 2"))
def _(spark, sf):
    return index(spark, sf).groupBy("zone", F.year("day").alias("y")).agg(F.count("*").alias("n_days"), F.count_if(F.col("index") < 0).alias("n_regime"), F.round(F.avg(F.when(F.col("index") < 0, 1.0).otherwise(0.0)), 6).alias("share"))


@query("active_days_mean", sql(INDEX, "SELECT zone, theme, count(*) FILTER (n_contracts > 0) AS n_active, round(avg(n_contracts), 6) AS mean_n FROM ix GROUP BY 1, 2"))
def _(spark, sf):
    return index(spark, sf).groupBy("zone", "theme").agg(F.count_if(F.col("n_contracts") > 0).alias("n_active"), F.round(F.avg("n_contracts"), 6).alias("mean_n"))


@query("drift_tstat", sql(CELLS, "SELECT zone, theme, round(avg(d_vw), 5) + 0.0 AS mean, round(avg(d_vw) / stddev_samp(d_vw) * sqrt(count(*)), 4) + 0.0 AS t FROM ce GROUP BY 1, 2"))
def _(spark, sf):
    return cells(spark, sf).groupBy("zone", "theme").agg(rnd(F.avg("d_vw"), 5).alias("mean"), rnd(F.avg("d_vw") / F.stddev_samp("d_vw") * F.sqrt(F.count("*")), 4).alias("t"))


@query("unit_share_of_moves", sql(Z, "SELECT zone, unit, round(s / sum(s) OVER (PARTITION BY zone), 6) + 0.0 AS share FROM (SELECT zone, unit, sum(abs(z)) AS s FROM zz WHERE z IS NOT NULL GROUP BY 1, 2)"))
def _(spark, sf):
    g = z_rows(spark, sf).where("z is not null").groupBy("zone", "unit").agg(F.sum(F.abs("z")).alias("s"))
    return g.select("zone", "unit", rnd(F.col("s") / F.sum("s").over(Window.partitionBy("zone"))).alias("share"))


@query("contract_profile", sql(Z, "SELECT contract_id, min(theme) AS theme, CAST(min(day) AS DATE) AS first_day, CAST(max(day) AS DATE) AS last_day, round(sum(vol1d), 4) + 0.0 AS volume, round(sum(abs(z)), 4) + 0.0 AS moves FROM zz GROUP BY 1"))
def _(spark, sf):
    return z_rows(spark, sf).groupBy("contract_id").agg(F.min("theme").alias("theme"), F.min("day").alias("first_day"), F.max("day").alias("last_day"), rnd(F.sum("vol1d"), 4).alias("volume"), rnd(F.sum(F.abs("z")), 4).alias("moves"))


# -- market series --------------------------------------------------------------------------------


def by_ticker():
    return Window.partitionBy("ticker").orderBy("day")


RT_I = RETURNS + ", ri AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY day) AS i FROM rt)"


@query("ffill", sql(PANEL, "SELECT platform, platform_id, CAST(snap_date AS DATE) AS snap_date, round(last_value(px_vwap_1h IGNORE NULLS) OVER (PARTITION BY platform, platform_id ORDER BY snap_date), 6) + 0.0 AS v FROM pn"))
def _(spark, sf):
    v = F.last("px_vwap_1h", True).over(Window.partitionBy("platform", "platform_id").orderBy("snap_date"))
    return panel(spark, sf).select("platform", "platform_id", "snap_date", rnd(v).alias("v"))


@query("trailing_7d_sum", sql(DAYS, "SELECT contract_id, CAST(day AS DATE) AS day, round(vol7d, 4) + 0.0 AS vol7d FROM cd"))
def _(spark, sf):
    return days(spark, sf).select("contract_id", "day", rnd("vol7d", 4).alias("vol7d"))


@query("lag_fallback", sql(DAYS, "SELECT contract_id, CAST(day AS DATE) AS day, round(px_early, 6) + 0.0 AS px_early FROM cd"))
def _(spark, sf):
    return days(spark, sf).select("contract_id", "day", rnd("px_early").alias("px_early"))


@query("partition_total", "SELECT o_orderkey, round(o_totalprice / sum(o_totalprice) OVER (PARTITION BY o_orderpriority, o_orderstatus), 9) + 0.0 AS share FROM orders")
def _(spark, sf):
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", rnd(F.col("o_totalprice") / F.sum("o_totalprice").over(Window.partitionBy("o_orderpriority", "o_orderstatus")), 9).alias("share"))


@query("dedupe_first", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders) WHERE k = 1")
def _(spark, sf):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf, "orders").withColumn("k", F.row_number().over(w)).where("k = 1").select("o_custkey", "o_orderkey")


def ewm_sql(x, alpha, extra=""):
    return f"""SELECT a.ticker, a.day, round(sum({x} * pow(1 - {alpha}, a.i - b.i)) / nullif(sum(CASE WHEN {x} IS NOT NULL THEN pow(1 - {alpha}, a.i - b.i) END), 0), 8) + 0.0 AS y
FROM ri a JOIN ri b ON a.ticker = b.ticker AND b.i <= a.i AND b.i >= a.i - 1200 GROUP BY 1, 2"""


@query("ewm_halflife", sql(RT_I, ewm_sql("b.r", "(1 - pow(0.5::DOUBLE, 0.2::DOUBLE))")))
def _(spark, sf):
    return with_ewm_mean(returns(spark, sf), "y", F.col("r"), alpha_of(halflife=5), ["ticker"], "day").select("ticker", "day", rnd("y", 8).alias("y"))


SPARSE = RT_I + """, sa AS (SELECT ticker, day, r, n > 1 AND r IS NOT NULL AS active, row_number() OVER (PARTITION BY ticker ORDER BY day) AS i FROM rt),
sv AS (SELECT a.ticker, a.i, CASE WHEN count(*) FILTER (b.active) >= 20 THEN sum(CASE WHEN b.active THEN b.r * b.r * pow(1 - 2 / 61.0::DOUBLE, a.i - b.i) END) / sum(CASE WHEN b.active THEN pow(1 - 2 / 61.0::DOUBLE, a.i - b.i) END) END AS v FROM sa a JOIN sa b ON a.ticker = b.ticker AND b.i <= a.i GROUP BY 1, 2)"""


@query("ewma_vol_sparse", sql(SPARSE, "SELECT sa.ticker, sa.day, round(sqrt(last_value(sv.v IGNORE NULLS) OVER (PARTITION BY sa.ticker ORDER BY sa.i)), 8) + 0.0 AS vol FROM sa LEFT JOIN sv ON sv.ticker = sa.ticker AND sv.i = sa.i - 1"))
def _(spark, sf):
    """Volatility over active days only, from 20 of them on, as known the day before and carried forward."""
    active = (F.col("n") > 1) & F.col("r").isNotNull()
    s = returns(spark, sf).select("ticker", "day", F.col("r").alias("d"), F.when(active, 1).otherwise(0).alias("n_contracts"))
    return shocks.with_sigma(s, ["ticker"]).select("ticker", "day", rnd("sigma", 8).alias("vol"))


@query("ewm_var_debiased", sql(RT_I, """SELECT ticker, day, round((q / w - (s / w) * (s / w)) * w * w / (w * w - w2), 8) + 0.0 AS y FROM (
SELECT a.ticker, a.day, sum(CASE WHEN b.r IS NOT NULL THEN pow(1 - 2 / 21.0::DOUBLE, a.i - b.i) END) AS w, sum(CASE WHEN b.r IS NOT NULL THEN pow(1 - 2 / 21.0::DOUBLE, 2 * (a.i - b.i)) END) AS w2,
  sum(b.r * pow(1 - 2 / 21.0::DOUBLE, a.i - b.i)) AS s, sum(b.r * b.r * pow(1 - 2 / 21.0::DOUBLE, a.i - b.i)) AS q
FROM ri a JOIN ri b ON a.ticker = b.ticker AND b.i <= a.i AND b.i >= a.i - 400 WHERE a.i > 20 GROUP BY 1, 2)"""))
def _(spark, sf):
    out = returns(spark, sf).withColumn("i", F.row_number().over(by_ticker()))
    out = with_ewm_var(out, "y", F.col("r"), alpha_of(span=20), ["ticker"], "day")
    return out.where("i > 20").select("ticker", "day", rnd("y", 8).alias("y"))


@query("expanding_z_burnin", sql(RT_I, "SELECT ticker, day, CASE WHEN i > 60 THEN round((r - avg(r) OVER w) / stddev_samp(r) OVER w, 6) + 0.0 END AS z FROM ri WINDOW w AS (PARTITION BY ticker ORDER BY day)"))
def _(spark, sf):
    w = by_ticker().rowsBetween(Window.unboundedPreceding, 0)
    z = (F.col("r") - F.avg("r").over(w)) / F.stddev_samp("r").over(w)
    return returns(spark, sf).select("ticker", "day", F.when(F.row_number().over(by_ticker()) > 60, rnd(z)).alias("z"))


@query("causal_demean", sql(RETURNS, "SELECT ticker, day, round(r - coalesce(avg(r) FILTER (n > 1) OVER (PARTITION BY ticker ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 8) + 0.0 AS d FROM rt"))
def _(spark, sf):
    past = F.avg(F.when(F.col("n") > 1, F.col("r"))).over(by_ticker().rowsBetween(Window.unboundedPreceding, -1))
    return returns(spark, sf).select("ticker", "day", rnd(F.col("r") - F.coalesce(past, F.lit(0.0)), 8).alias("d"))


@query("expost_demean", sql(RETURNS, "SELECT ticker, day, round(r - avg(r) FILTER (n > 1) OVER (PARTITION BY ticker), 8) + 0.0 AS d FROM rt"))
def _(spark, sf):
    m = F.avg(F.when(F.col("n") > 1, F.col("r"))).over(Window.partitionBy("ticker"))
    return returns(spark, sf).select("ticker", "day", rnd(F.col("r") - m, 8).alias("d"))


@query("rolling_corr_regime", sql(RETURNS, "SELECT ticker, day, lag(CASE WHEN c < 0 THEN 1 WHEN c >= 0 THEN 0 END) OVER (PARTITION BY ticker ORDER BY day) AS regime FROM (SELECT *, CASE WHEN count(r) OVER w >= 30 AND (stddev_samp(r) OVER w) * (stddev_samp(CASE WHEN r IS NOT NULL THEN n END) OVER w) > 0 THEN round(corr(r, CAST(n AS DOUBLE)) OVER w, 9) END AS c FROM rt WINDOW w AS (PARTITION BY ticker ORDER BY day ROWS BETWEEN 59 PRECEDING AND CURRENT ROW))"))
def _(spark, sf):
    w = by_ticker().rowsBetween(-59, 0)
    n = F.when(F.col("r").isNotNull(), F.col("n").cast("double"))
    spread = F.stddev_samp("r").over(w) * F.stddev_samp(n).over(w)
    corr = F.covar_samp("r", n).over(w) / F.when(spread > 0, spread)
    c = returns(spark, sf).withColumn("c", F.when(F.count("r").over(w) >= 30, F.round(corr, 9)))
    return c.select("ticker", "day", F.lag(F.when(F.col("c") < 0, 1).when(F.col("c") >= 0, 0)).over(by_ticker()).alias("regime"))


@query("rolling_median_spread", sql(MARKET, "SELECT ticker, day, round(quantile_cont(value, 0.5) OVER (PARTITION BY ticker ORDER BY day ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 4) + 0.0 AS m FROM ml"))
def _(spark, sf):
    return market_long(spark, sf).select("ticker", "day", rnd(F.percentile("value", 0.5).over(by_ticker().rowsBetween(-19, 0)), 4).alias("m"))


@query("expanding_quantile_flag", sql(MARKET, "SELECT ticker, day, lag(f) OVER (PARTITION BY ticker ORDER BY day) AS stress FROM (SELECT ticker, day, CASE WHEN count(*) OVER w >= 250 THEN value > quantile_cont(value, 0.9) OVER w END AS f FROM ml WINDOW w AS (PARTITION BY ticker ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"))
def _(spark, sf):
    m = written(market_long(spark, sf).select("ticker", "day", "value"), "market")
    past = ranks.running_quantile(m, m, ["ticker"], "day", "value", 0.9, strict=False)
    f = m.join(past, ["ticker", "day"]).withColumn("f", F.when(F.col("n") >= 250, F.col("value") > F.col("quantile")))
    return f.select("ticker", "day", F.lag("f").over(by_ticker()).alias("stress"))


@query("forward_sum", sql(RETURNS, "SELECT ticker, day, CASE WHEN count(r) OVER w = 5 THEN round(sum(r) OVER w, 8) + 0.0 END AS y FROM rt WINDOW w AS (PARTITION BY ticker ORDER BY day ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)"))
def _(spark, sf):
    w = by_ticker().rowsBetween(1, 5)
    return returns(spark, sf).select("ticker", "day", F.when(F.count("r").over(w) == 5, rnd(F.sum("r").over(w), 8)).alias("y"))


@query("rolling_vol", sql(RETURNS, "SELECT ticker, day, CASE WHEN count(r) OVER w >= 40 THEN round(stddev_samp(r) OVER w * sqrt(252), 8) + 0.0 END AS vol FROM rt WINDOW w AS (PARTITION BY ticker ORDER BY day ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)"))
def _(spark, sf):
    w = by_ticker().rowsBetween(-59, 0)
    return returns(spark, sf).select("ticker", "day", F.when(F.count("r").over(w) >= 40, rnd(F.stddev_samp("r").over(w) * F.sqrt(F.lit(252.0)), 8)).alias("vol"))


DD = RETURNS + """, wl AS (SELECT ticker, day, r, product(1 + r) OVER (PARTITION BY ticker ORDER BY day) AS wealth FROM rt WHERE r IS NOT NULL),
dw AS (SELECT *, wealth / max(wealth) OVER (PARTITION BY ticker ORDER BY day) - 1 AS dd FROM wl)"""


def dd(spark, sf):
    return stats.drawdowns(returns(spark, sf).where("r is not null"), ["ticker"], "day")


@query("drawdown", sql(DD, "SELECT ticker, day, round(dd, 6) + 0.0 AS dd FROM dw"))
def _(spark, sf):
    return dd(spark, sf).select("ticker", "day", rnd("dd").alias("dd"))


@query("drawdown_episodes", sql(DD, """, ep AS (SELECT *, sum(CASE WHEN dd >= -1e-12 THEN 1 ELSE 0 END) OVER (PARTITION BY ticker ORDER BY day) AS e FROM dw),
g AS (SELECT ticker, e, min(day) AS peak, arg_min(day, (dd, day)) AS trough, min(dd) AS depth, count(*) AS n_rows FROM ep GROUP BY 1, 2)
SELECT ticker, peak, trough, recovery, round(depth, 6) + 0.0 AS depth, n_rows FROM (SELECT *, lead(peak) OVER (PARTITION BY ticker ORDER BY e) AS recovery FROM g) WHERE depth < -1e-12""").replace(")\n, ep", "), ep"))
def _(spark, sf):
    return stats.drawdown_episodes(dd(spark, sf), ["ticker"], "day").select("ticker", "peak", "trough", "recovery", rnd("depth").alias("depth"), "n_rows")


@query("cumulative_return_series", sql(DD, "SELECT ticker, day, round((wealth - 1) * 100, 5) + 0.0 AS pct FROM dw"))
def _(spark, sf):
    return dd(spark, sf).select("ticker", "day", rnd((F.col("wealth") - 1) * 100, 5).alias("pct"))


@query("rank_terciles", sql(MARKET, "SELECT day, ticker, CASE WHEN up <= greatest(c // 3, 1) THEN 1 WHEN dn <= greatest(c // 3, 1) THEN -1 ELSE 0 END AS leg FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY value DESC, ticker) AS up, row_number() OVER (PARTITION BY day ORDER BY value, ticker DESC) AS dn, count(*) OVER (PARTITION BY day) AS c FROM ml) WHERE c >= 2"))
def _(spark, sf):
    d = Window.partitionBy("day")
    m = market_long(spark, sf).withColumn("up", F.row_number().over(d.orderBy(F.desc("value"), "ticker"))).withColumn("dn", F.row_number().over(d.orderBy("value", F.desc("ticker")))).withColumn("c", F.count("*").over(d))
    leg = F.greatest(F.floor(F.col("c") / 3), F.lit(1))
    return m.where("c >= 2").select("day", "ticker", F.when(F.col("up") <= leg, 1).when(F.col("dn") <= leg, -1).otherwise(0).alias("leg"))


@query("period_last_day", sql(MARKET, "SELECT ticker, 'month' AS period, last_day(day) AS period_end, max(day) AS last_trading_day FROM ml GROUP BY 1, 3 UNION ALL SELECT ticker, 'week', (day + CAST((12 - isodow(day)) % 7 AS INT))::DATE, max(day) FROM ml GROUP BY 1, 3"))
def _(spark, sf):
    """Last trading day of each month and of each week that ends on a Friday."""
    ends = F.array(F.struct(F.lit("month").alias("period"), F.last_day("day").alias("period_end")), F.struct(F.lit("week").alias("period"), friday("day").alias("period_end")))
    return market_long(spark, sf).select("ticker", "day", F.inline(ends)).groupBy("ticker", "period", "period_end").agg(F.max("day").alias("last_trading_day"))


def friday(day):
    """The Friday on or after a day."""
    return F.date_add(day, (11 - F.weekday(day)) % 7)


HELD = MARKET + """, hb AS (SELECT ticker, day, value, row_number() OVER (PARTITION BY ticker ORDER BY day) - 1 AS i, day = max(day) OVER (PARTITION BY ticker, (day + CAST((12 - isodow(day)) % 7 AS INT))::DATE) AS wk, day = max(day) OVER (PARTITION BY ticker, last_day(day)) AS mo FROM ml)"""


@query("hold_between_rebalance", sql(HELD, "SELECT ticker, day, rule, coalesce(last_value(CASE rule WHEN 'week' THEN CASE WHEN wk THEN value END WHEN 'month' THEN CASE WHEN mo THEN value END ELSE CASE WHEN i % 20 = 7 THEN value END END IGNORE NULLS) OVER (PARTITION BY ticker, rule ORDER BY day), 0) AS held FROM hb CROSS JOIN (VALUES ('week'), ('month'), ('every 20 from 7')) r(rule)"))
def _(spark, sf):
    """Values kept from the last day of a week or month, or from every twentieth row from the eighth on; 0 before the first."""
    last_of = lambda period: F.col("day") == F.max("day").over(Window.partitionBy("ticker", period))
    m = market_long(spark, sf).withColumn("i", F.row_number().over(by_ticker()) - 1).withColumn("wk", last_of(friday("day"))).withColumn("mo", last_of(F.last_day("day")))
    rules = F.array(*[F.struct(F.lit(n).alias("rule"), hit.alias("hit")) for n, hit in (("week", F.col("wk")), ("month", F.col("mo")), ("every 20 from 7", F.col("i") % 20 == 7))])
    r = m.select("ticker", "day", "value", F.inline(rules))
    held = F.last(F.when(F.col("hit"), F.col("value")), True).over(Window.partitionBy("ticker", "rule").orderBy("day"))
    return r.select("ticker", "day", "rule", F.coalesce(held, F.lit(0.0)).alias("held"))


@query("sign_changes", sql(RETURNS, "SELECT ticker, count(*) AS n FROM (SELECT ticker, sign(r) AS s, lag(sign(r)) OVER (PARTITION BY ticker ORDER BY day) AS p FROM rt WHERE r <> 0) WHERE s <> p GROUP BY 1"))
def _(spark, sf):
    s = returns(spark, sf).where("r <> 0").withColumn("s", F.signum("r")).withColumn("p", F.lag("s").over(by_ticker()))
    return s.where("s <> p").groupBy("ticker").agg(F.count("*").alias("n"))


@query("lagged_label", sql(RETURNS, "SELECT ticker, day, lag(CASE WHEN n > 1 THEN 'busy' ELSE 'quiet' END) OVER (PARTITION BY ticker ORDER BY day) AS label FROM rt"))
def _(spark, sf):
    return returns(spark, sf).select("ticker", "day", F.lag(F.when(F.col("n") > 1, "busy").otherwise("quiet")).over(by_ticker()).alias("label"))


@query("since_last_event", sql(RT_I, "SELECT ticker, day, (i - last_value(CASE WHEN n > 3 THEN i END IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY day))::INT AS since FROM ri"))
def _(spark, sf):
    r = returns(spark, sf).withColumn("i", F.row_number().over(by_ticker()))
    return r.select("ticker", "day", (F.col("i") - F.last(F.when(F.col("n") > 3, F.col("i")), True).over(by_ticker())).alias("since"))


@query("neighbour_window", sql(RT_I, "SELECT ticker, (ri.i - m.i)::INT AS off, round(r, 8) + 0.0 AS r FROM ri JOIN (SELECT ticker, arg_max(i, (abs(r), i)) AS i FROM ri WHERE r IS NOT NULL GROUP BY 1) m USING (ticker) WHERE ri.i BETWEEN m.i - 6 AND m.i + 6"))
def _(spark, sf):
    r = returns(spark, sf).withColumn("i", F.row_number().over(by_ticker()))
    m = r.where("r is not null").groupBy("ticker").agg(F.max_by("i", F.struct(F.abs("r"), "i")).alias("m"))
    return r.join(m, "ticker").where("i between m - 6 and m + 6").select("ticker", (F.col("i") - F.col("m")).alias("off"), rnd("r", 8).alias("r"))


@query("rank_first_per_key", sql(RETURNS, "SELECT ticker, day, k::INT AS k FROM (SELECT ticker, day, row_number() OVER (PARTITION BY ticker ORDER BY r, day) AS k FROM rt WHERE r IS NOT NULL) WHERE k <= 5"))
def _(spark, sf):
    w = Window.partitionBy("ticker").orderBy("r", "day")
    return returns(spark, sf).where("r is not null").withColumn("k", F.row_number().over(w)).where("k <= 5").select("ticker", "day", "k")
