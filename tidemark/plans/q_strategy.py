"""Queries over excess returns, covariances and the books built on them."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.common import rnd
from tidemark.functions.ewm import alpha_of, with_ewm_mean
from tidemark.operators import book, market
from tidemark.plans.base import RETURNS, returns, sql
from tidemark.plans.registry import query
from tidemark.sources.files import written

TARGET = 0.10


def quotes(spark, sf):
    """(ticker, day, n, value, s, carry, stale, rx)"""
    w = Window.partitionBy("ticker").orderBy("day")
    q = returns(spark, sf).select(
        "ticker", "day", "n", "value", (F.col("s") / 100).alias("s"), ((F.col("n") % 5) * 0.01).alias("carry"),
        F.coalesce(F.datediff("day", F.lag("day").over(w)) > 3, F.lit(False)).alias("stale"),
    )
    return market.excess_returns(q, "ticker", "day", "s", "carry", "stale")


def quotes_once(spark, sf):
    """The quotes as a written table, for books that read them several times."""
    return written(quotes(spark, sf), "quotes")


RX = (
    RETURNS
    + """,
rx AS (SELECT ticker, day, n, value, (n % 5) * 0.01::DOUBLE AS carry, CASE WHEN NOT coalesce(day - lag(day) OVER w > 3, false)
  THEN s / 100 - lag(s) OVER w / 100 + lag((n % 5) * 0.01::DOUBLE) OVER w / 252 END AS rx FROM rt WINDOW w AS (PARTITION BY ticker ORDER BY day)),
rxi AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY day) AS i FROM rx)"""
)
COV = (
    RX
    + """,
dd AS (SELECT d.day, t.ticker, coalesce(rx.rx, 0) AS x, row_number() OVER (PARTITION BY t.ticker ORDER BY d.day) AS j FROM (SELECT DISTINCT day FROM rx) d CROSS JOIN (SELECT DISTINCT ticker FROM rx) t LEFT JOIN rx ON rx.day = d.day AND rx.ticker = t.ticker),
pp AS (SELECT p.ticker AS a, q.ticker AS b, p.day, p.j, p.x * q.x AS x FROM dd p JOIN dd q ON p.day = q.day AND p.ticker <= q.ticker),
cov AS (SELECT m.a, m.b, m.day, sum(n.x * CASE WHEN n.j = 1 THEN pow(1 - 2 / 61.0::DOUBLE, m.j - 1) ELSE 2 / 61.0::DOUBLE * pow(1 - 2 / 61.0::DOUBLE, m.j - n.j) END) AS c
  FROM pp m JOIN pp n ON n.a = m.a AND n.b = m.b AND n.j <= m.j WHERE m.j >= 20 GROUP BY 1, 2, 3)"""
)


def scale_sql(w):
    """CTE k_<w> (day, k) over the weights ``w`` (ticker, day, w)."""
    return f"""k_{w} AS (SELECT d.day, CASE WHEN v.v > 0 THEN 0.1::DOUBLE / sqrt(252 * v.v) WHEN g.day IS NOT NULL THEN 0 END AS k FROM (SELECT DISTINCT day FROM {w}) d
  LEFT JOIN (SELECT cov.day, sum(c * p.w * q.w * CASE WHEN a = b THEN 1 ELSE 2 END) AS v FROM cov JOIN {w} p ON p.day = cov.day AND p.ticker = a JOIN {w} q ON q.day = cov.day AND q.ticker = b GROUP BY 1) v ON v.day = d.day
  LEFT JOIN (SELECT DISTINCT day FROM cov) g ON g.day = d.day)"""


def signed(spark, sf):
    return quotes(spark, sf).where("rx is not null").select("ticker", "day", (F.signum("rx") * (1 + F.col("n") % 3) * 0.2).alias("w"))


SIGNED = "sw AS (SELECT ticker, day, sign(rx) * (1 + n % 3) * 0.2 AS w FROM rx WHERE rx IS NOT NULL)"


@query("fx_excess_return", sql(RX, "SELECT ticker, day, round(rx, 8) + 0.0 AS rx FROM rx"))
def _(spark, sf):
    return quotes(spark, sf).select("ticker", "day", rnd("rx", 8).alias("rx"))


@query("ewma_cov", sql(COV, "SELECT a, b, day, round(c, 10) + 0.0 AS c FROM cov"))
def _(spark, sf):
    return market.ewma_cov(quotes(spark, sf)).select("a", "b", "day", rnd("c", 10).alias("c"))


@query("vol_target_scale", sql(COV + ", " + SIGNED + ", " + scale_sql("sw"), "SELECT day, round(coalesce(k, 0), 5) + 0.0 AS k FROM k_sw"))
def _(spark, sf):
    k = market.target_scale(signed(spark, sf), market.ewma_cov(quotes(spark, sf)), TARGET)
    return k.select("day", rnd(F.coalesce("k", F.lit(0.0)), 5).alias("k"))


CARRY = (
    COV
    + """,
cv AS (SELECT *, CASE WHEN count(rx) OVER w >= 40 THEN stddev_samp(rx) OVER w * sqrt(252) END AS vol FROM rx WINDOW w AS (PARTITION BY ticker ORDER BY day ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)),
me AS (SELECT max(day) AS day FROM rx GROUP BY last_day(day)),
cr AS (SELECT cv.*, row_number() OVER (PARTITION BY cv.day ORDER BY carry DESC, ticker DESC) AS up, row_number() OVER (PARTITION BY cv.day ORDER BY carry, ticker) AS dn, count(*) OVER (PARTITION BY cv.day) AS c FROM cv JOIN me ON me.day = cv.day WHERE vol IS NOT NULL),
cl AS (SELECT *, CASE WHEN up <= greatest(c // 3, 1) THEN 1 WHEN dn <= greatest(c // 3, 1) THEN -1 END AS leg FROM cr WHERE c >= 2),
cw AS (SELECT ticker, day, leg * (1 / vol) / sum(1 / vol) OVER (PARTITION BY day, leg) AS w FROM cl WHERE leg IS NOT NULL),
"""
    + scale_sql("cw")
    + """,
cs AS (SELECT cw.ticker, cw.day, cw.w * coalesce(k, 1) AS w FROM cw JOIN k_cw ON k_cw.day = cw.day),
hd AS (SELECT d.day, max(r.day) AS reb FROM (SELECT DISTINCT day FROM rx) d JOIN (SELECT DISTINCT day FROM cs) r ON r.day <= d.day GROUP BY 1),
ch AS (SELECT hd.day, cs.ticker, cs.w FROM hd JOIN cs ON cs.day = hd.reb)"""
)


def carry(spark, sf, quoted=None):
    quoted = quotes_once(spark, sf) if quoted is None else quoted
    q = market.rolling_vol(quoted, "ticker", "day", "rx")
    legs = market.carry_legs(q.join(market.month_ends(q), "day"))
    return market.held(market.scaled(written(legs, "legs"), market.ewma_cov(quoted), TARGET, keep_unscaled=True), q)


@query("carry_weights", sql(CARRY, "SELECT ticker, day, round(w, 6) + 0.0 AS w FROM ch"))
def _(spark, sf):
    return carry(spark, sf).select("ticker", "day", rnd("w").alias("w"))


TILT = """tr0 AS (SELECT *, CASE WHEN ticker < '3' THEN 1 WHEN ticker >= '4' THEN -1 END AS side FROM cv),
tr1 AS (SELECT *, count(vol) OVER (PARTITION BY day) AS known FROM tr0 WHERE side IS NOT NULL),
tw AS (SELECT ticker, day, side * (1 / vol) / sum(1 / vol) OVER (PARTITION BY day, side) AS w FROM tr1 WHERE known = 4),
""" + scale_sql("tw") + """,
ts AS (SELECT tw.ticker, tw.day, tw.w * k AS w FROM tw JOIN k_tw ON k_tw.day = tw.day WHERE k IS NOT NULL)"""


def tilt(spark, sf, quoted=None):
    quoted = quotes_once(spark, sf) if quoted is None else quoted
    q = market.rolling_vol(quoted, "ticker", "day", "rx")
    side = F.when(F.col("ticker") < "3", 1).when(F.col("ticker") >= "4", -1)
    return market.scaled(written(market.list_tilt(q, side), "legs"), market.ewma_cov(quoted), TARGET, keep_unscaled=False)


@query("tilt_weights", sql(CARRY + ", " + TILT, "SELECT ticker, day, round(w, 6) + 0.0 AS w FROM ts"))
def _(spark, sf):
    return tilt(spark, sf).select("ticker", "day", rnd("w").alias("w"))


EXPOSURE = """ex0 AS (SELECT day, avg(rx) AS m, row_number() OVER (ORDER BY day) AS i FROM rx WHERE rx IS NOT NULL GROUP BY day),
ex1 AS (SELECT *, (m - avg(m) OVER w) / stddev_samp(m) OVER w AS z, i - last_value(CASE WHEN m > 0.004 AND day(day) % 2 = 1 THEN i END IGNORE NULLS) OVER w AS since_a,
  i - last_value(CASE WHEN m > 0.004 AND day(day) % 2 = 0 THEN i END IGNORE NULLS) OVER w AS since_b FROM ex0 WINDOW w AS (ORDER BY day)),
ex2 AS (SELECT *, CASE WHEN i <= 60 OR z IS NULL THEN 1.0::DOUBLE WHEN round(z, 9) > 2 THEN 0 WHEN round(z, 9) > 1 THEN 0.5 ELSE 1 END AS step FROM ex1),
ex AS (SELECT day, step * CASE WHEN since_a IS NULL OR since_a >= 10 THEN 1.0::DOUBLE ELSE 0.25::DOUBLE + 0.75::DOUBLE * since_a / 10 END AS mult,
  step - step * CASE WHEN since_b IS NULL OR since_b >= 10 THEN 1.0::DOUBLE ELSE 0.25::DOUBLE + 0.75::DOUBLE * since_b / 10 END AS add FROM ex2)"""


def exposure(spark, sf, quoted=None):
    """(day, mult, add): one row a day, so its windows are over the days only."""
    m = (quotes(spark, sf) if quoted is None else quoted).where("rx is not null").groupBy("day").agg(F.avg("rx").alias("m"))
    w = Window.orderBy("day")
    m = m.withColumn("i", F.row_number().over(w))
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    z = F.round((F.col("m") - F.avg("m").over(so_far)) / F.stddev_samp("m").over(so_far), 9)
    odd = F.dayofmonth("day") % 2 == 1
    since = lambda hit: F.col("i") - F.last(F.when((F.col("m") > 0.004) & hit, F.col("i")), True).over(w)
    m = m.withColumn("z", z).withColumn("a", since(odd)).withColumn("b", since(~odd))
    step = F.when((F.col("i") <= 60) | F.col("z").isNull(), 1.0).when(F.col("z") > 2, 0.0).when(F.col("z") > 1, 0.5).otherwise(1.0)
    m = m.withColumn("step", step)
    mult = F.col("step") * book.timing_exposure("a", 0.25, 10)
    return m.select("day", mult.alias("mult"), (F.col("step") - F.col("step") * book.timing_exposure("b", 0.25, 10)).alias("add"))


@query("overlay_combine", sql(CARRY + ", " + TILT + ", " + EXPOSURE, """, tk AS (SELECT DISTINCT ticker FROM rx), el AS (SELECT ticker, day, CASE WHEN ticker >= '4' THEN coalesce(lag(mult) OVER w, 1) ELSE mult END AS mult, CASE WHEN ticker >= '4' THEN coalesce(lag(add) OVER w, 0) ELSE add END AS add FROM ex CROSS JOIN tk WINDOW w AS (PARTITION BY ticker ORDER BY day))
SELECT el.ticker, el.day, round(coalesce(ch.w, 0) * mult + coalesce(ts.w, 0) * add, 6) + 0.0 AS w FROM el LEFT JOIN ch ON ch.ticker = el.ticker AND ch.day = el.day LEFT JOIN ts ON ts.ticker = el.ticker AND ts.day = el.day WHERE ch.w IS NOT NULL OR ts.w IS NOT NULL""").replace(")\n, tk", "), tk"))
def _(spark, sf):
    q = quotes_once(spark, sf)
    lags = q.select("ticker").distinct().select("ticker", F.when(F.col("ticker") >= "4", 1).otherwise(0).alias("lag"))
    return market.overlay(carry(spark, sf, q), tilt(spark, sf, q), exposure(spark, sf, q), lags).select("ticker", "day", rnd("w").alias("w"))


VAR = """va AS (SELECT a.ticker, a.day, count(b.rx) AS seen, (sum(b.rx * b.rx * pow(1 - 2 / 61.0::DOUBLE, a.i - b.i)) / sum(CASE WHEN b.rx IS NOT NULL THEN pow(1 - 2 / 61.0::DOUBLE, a.i - b.i) END)
    - pow(sum(b.rx * pow(1 - 2 / 61.0::DOUBLE, a.i - b.i)) / sum(CASE WHEN b.rx IS NOT NULL THEN pow(1 - 2 / 61.0::DOUBLE, a.i - b.i) END), 2))
    * pow(sum(CASE WHEN b.rx IS NOT NULL THEN pow(1 - 2 / 61.0::DOUBLE, a.i - b.i) END), 2)
    / nullif(pow(sum(CASE WHEN b.rx IS NOT NULL THEN pow(1 - 2 / 61.0::DOUBLE, a.i - b.i) END), 2) - sum(CASE WHEN b.rx IS NOT NULL THEN pow(1 - 2 / 61.0::DOUBLE, 2 * (a.i - b.i)) END), 0) AS v
  FROM rxi a JOIN rxi b ON a.ticker = b.ticker AND b.i <= a.i GROUP BY 1, 2),
em AS (SELECT a.ticker, a.day, sum(coalesce(b.rx, 0) * pow(0.5::DOUBLE, (a.i - b.i) / 5.0::DOUBLE)) / sum(pow(0.5::DOUBLE, (a.i - b.i) / 5.0::DOUBLE)) AS f FROM rxi a JOIN rxi b ON a.ticker = b.ticker AND b.i <= a.i GROUP BY 1, 2)"""


def forecast(spark, sf):
    return with_ewm_mean(quotes(spark, sf), "f", F.coalesce("rx", F.lit(0.0)), alpha_of(halflife=5), ["ticker"], "day")


@query("raw_position", sql(RX + ", " + VAR, ", y AS (SELECT ticker, day, f - avg(f) OVER (PARTITION BY day) AS y FROM em) SELECT y.ticker, y.day, round(CASE WHEN seen >= 20 AND v > 0 AND abs(y) > 1e-9 THEN y / v ELSE 0 END, 3) + 0.0 AS pos FROM y JOIN va ON va.ticker = y.ticker AND va.day = y.day").replace(")\n, y AS", "), y AS"))
def _(spark, sf):
    return market.raw_positions(forecast(spark, sf), "f", "rx", demean=True).select("ticker", "day", rnd("pos", 3).alias("pos"))


@query("momentum_benchmark", sql(RX + ", " + VAR, ", bs AS (SELECT day, sign(round(sum(avg(rx)) OVER (ORDER BY day ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 9)) AS s FROM rx WHERE rx IS NOT NULL GROUP BY day) SELECT va.ticker, va.day, round(CASE WHEN seen >= 20 AND v > 0 THEN s / v ELSE 0 END, 0) + 0.0 AS pos FROM va JOIN bs ON bs.day = va.day").replace(")\n, bs", "), bs"))
def _(spark, sf):
    q = quotes(spark, sf)
    basket = q.where("rx is not null").groupBy("day").agg(F.avg("rx").alias("m"))
    recent = F.sum("m").over(Window.orderBy("day").rowsBetween(-9, 0))  # a row a day
    f = basket.select("day", F.signum(F.round(recent, 9)).alias("f"))
    p = market.raw_positions(q.join(f, "day", "left"), "f", "rx").join(f.select("day"), "day")
    return p.select("ticker", "day", rnd("pos", 0).alias("pos"))
