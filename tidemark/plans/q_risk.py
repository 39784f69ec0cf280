"""Risk tables: tags, conditioners and factors, from the chain's own shocks, cells and books."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.common import rnd
from tidemark.plans.base import market_long, returns, sql
from tidemark.plans.q_series import CELLS, Z, cells, friday
from tidemark.plans.q_shocks import SERIES, recursive, shocked
from tidemark.plans.q_strategy import CARRY, carry, quotes_once
from tidemark.plans.registry import query
from tidemark.sources import files

#: changes of a cell beyond this many deviations are news
NEWS = 3.0


@query("news_tags", recursive(SERIES + CELLS[len(Z):], f"SELECT CAST(day AS DATE) AS day, 'shock:' || theme AS tag FROM so WHERE confirmed UNION ALL SELECT CAST(day AS DATE), zone || '/' || theme FROM ce WHERE abs(round(d_vw, 9)) > {NEWS}"))
def _(spark, sf):
    """Days of confirmed shocks and of large changes of a cell, with what they were."""
    shock = shocked(spark, sf).where("confirmed").select("day", F.concat(F.lit("shock:"), "theme").alias("tag"))
    news = cells(spark, sf).where(F.abs(F.round("d_vw", 9)) > NEWS).select("day", F.concat_ws("/", "zone", "theme").alias("tag"))
    return shock.unionByName(news)


CONDITIONS = """rt AS (SELECT ticker, day, ln(value) AS s, (ln(value) - lag(ln(value)) OVER (PARTITION BY ticker ORDER BY day)) AS dl, value FROM (SELECT CAST(o_orderdate AS DATE) AS day, o_orderpriority AS ticker, avg(o_totalprice) AS value FROM orders GROUP BY 1, 2)),
kd AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS j FROM (SELECT DISTINCT day FROM rt)),
kl AS (SELECT kd.day, last_value(rt.value IGNORE NULLS) OVER (ORDER BY kd.day) AS level FROM kd LEFT JOIN rt ON rt.day = kd.day AND rt.ticker = '1-URGENT'),
km AS (SELECT me, sign(round(ln(v) - lag(ln(v)) OVER (ORDER BY me), 12)) AS month_sign FROM (SELECT last_day(day) AS me, arg_max(value, day) AS v FROM rt WHERE ticker = '5-LOW' GROUP BY 1)),
kw AS (SELECT we, abs(x) > 1.5::DOUBLE * stddev_samp(x) OVER () AS big FROM (SELECT (day + CAST((12 - isodow(day)) % 7 AS INT))::DATE AS we, sum(dl) AS x FROM rt WHERE ticker = '2-HIGH' GROUP BY 1)),
ks AS (SELECT j, bool_or(confirmed) AS shock FROM (SELECT confirmed, (CAST(day AS DATE) - min(CAST(day AS DATE)) OVER ())::INT AS j FROM so) GROUP BY 1),
kp AS (SELECT day, avg(m) AS spread FROM (SELECT ticker, day, quantile_cont(value, 0.5) OVER (PARTITION BY ticker ORDER BY day ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS m FROM rt) GROUP BY 1)"""


@query("conditioners", recursive(SERIES + ", " + CONDITIONS, "SELECT kd.day, round(lag(level) OVER o, 4) + 0.0 AS level, month_sign + 0.0 AS month_sign, coalesce(big, false) AS big_week, coalesce(shock, false) AS shock_day, round(lag(spread) OVER o, 4) + 0.0 AS spread FROM kd JOIN kl ON kl.day = kd.day LEFT JOIN km ON km.me = last_day(kd.day) LEFT JOIN kw ON kw.we = (kd.day + CAST((12 - isodow(kd.day)) % 7 AS INT))::DATE LEFT JOIN ks ON ks.j = kd.j LEFT JOIN kp ON kp.day = kd.day WINDOW o AS (ORDER BY kd.day)"))
def _(spark, sf):
    """For each market day: the level of a series the day before, the sign of another's change in the month, a week beyond 1.5 deviations,
    a day with a confirmed shock of any theme, and the mean spread the day before.

    Month and week values are back-filled over their days.  The shocks' calendar lies beside the market's by the ordinal of its days.
    """
    m = files.written(market_long(spark, sf).select("ticker", "day", "value"), "market")
    of = lambda t: m.where(F.col("ticker") == t)
    every = Window.orderBy("day")  # a row a day, here and below
    days = m.select("day").distinct().withColumn("j", F.row_number().over(every) - 1)
    level = days.join(of("1-URGENT").select("day", "value"), "day", "left").select("day", "j", F.last("value", True).over(every).alias("__level"))
    ends = of("5-LOW").groupBy(F.last_day("day").alias("me")).agg(F.max_by("value", "day").alias("v"))
    months = ends.select("me", F.signum(F.round(F.log("v") - F.lag(F.log("v")).over(Window.orderBy("me")), 12)).alias("s"))
    change = F.log("value") - F.lag(F.log("value")).over(every)
    weeks = of("2-HIGH").select(friday("day").alias("we"), change.alias("x")).groupBy("we").agg(F.sum("x").alias("x"))
    weeks = weeks.select("we", (F.abs("x") > 1.5 * F.stddev_samp("x").over(Window.partitionBy())).alias("big"))
    s = shocked(spark, sf).select("day", "confirmed")
    shocks = s.withColumn("j", F.datediff("day", F.min("day").over(Window.partitionBy()))).groupBy("j").agg(F.bool_or("confirmed").alias("shock"))
    median = F.percentile("value", 0.5).over(Window.partitionBy("ticker").orderBy("day").rowsBetween(-19, 0))
    spread = m.withColumn("m", median).groupBy("day").agg(F.avg("m").alias("__spread"))
    out = level.withColumn("me", F.last_day("day")).withColumn("we", friday("day")).join(months, "me", "left").join(weeks, "we", "left").join(shocks, "j", "left").join(spread, "day", "left")
    return out.select(
        "day", rnd(F.lag("__level").over(every), 4).alias("level"), (F.col("s") + F.lit(0.0)).alias("month_sign"), F.coalesce("big", F.lit(False)).alias("big_week"),
        F.coalesce("shock", F.lit(False)).alias("shock_day"), rnd(F.lag("__spread").over(every), 4).alias("spread"),
    )


FACTORS = CARRY + """, fw AS (SELECT rx.ticker, rx.day, rx.rx, lag(coalesce(ch.w, 0)) OVER (PARTITION BY rx.ticker ORDER BY rx.day) AS w FROM rx LEFT JOIN ch ON ch.ticker = rx.ticker AND ch.day = rx.day),
fc AS (SELECT day, sum(coalesce(w, 0) * coalesce(rx, 0)) AS carry FROM fw GROUP BY 1)"""


@query("factor_table", sql(FACTORS, "SELECT rt.ticker, rt.day, round(ln(rt.value) - lag(ln(rt.value)) OVER w, 7) + 0.0 AS dlog, round(rt.value - lag(rt.value) OVER w, 6) + 0.0 AS d, round(carry, 7) + 0.0 AS carry FROM rt JOIN fc ON fc.day = rt.day WINDOW w AS (PARTITION BY rt.ticker ORDER BY rt.day)"))
def _(spark, sf):
    """Log and simple changes of each series, and the gross return of the carry book on the day."""
    w = Window.partitionBy("ticker").orderBy("day")
    once = quotes_once(spark, sf)
    q = once.select("ticker", "day", "rx").join(carry(spark, sf, once).select("ticker", "day", "w"), ["ticker", "day"], "left")
    pnl = q.withColumn("p", F.coalesce(F.lag(F.coalesce("w", F.lit(0.0))).over(w), F.lit(0.0)) * F.coalesce("rx", F.lit(0.0)))
    book = pnl.groupBy("day").agg(rnd(F.sum("p"), 7).alias("carry"))
    m = returns(spark, sf).select("ticker", "day", rnd(F.log("value") - F.lag(F.log("value")).over(w), 7).alias("dlog"), rnd(F.col("value") - F.lag("value").over(w)).alias("d"))
    return m.join(book, "day").select("ticker", "day", "dlog", "d", "carry")
