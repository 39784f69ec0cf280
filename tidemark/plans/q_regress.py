"""Regression queries: betas with Newey-West errors, panel slopes by model and horizon, gates, non-overlapping samples."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.common import rnd
from tidemark.operators import regress
from tidemark.plans.base import RETURNS, returns, sql, table
from tidemark.plans.q_book import STACK, stacked
from tidemark.plans.registry import query


def by_ticker():
    return Window.partitionBy("ticker").orderBy("day")


def after(ctes, select):
    """SQL whose ``select`` starts with further CTEs."""
    return "WITH " + ctes + select


PAIRS = ", x AS (SELECT b.ticker, b.day, a.r AS x, b.r AS y FROM rt a JOIN rt b ON a.day = b.day AND a.ticker = '1-URGENT' AND b.ticker > a.ticker WHERE a.r IS NOT NULL AND b.r IS NOT NULL)"


def against_first(spark, sf):
    r = returns(spark, sf).where("r is not null").select("ticker", "day", "r")
    a = r.where("ticker = '1-URGENT'").select("day", F.col("r").alias("x"))
    return r.where("ticker > '1-URGENT'").withColumnRenamed("r", "y").join(a, "day")


@query("beta_hac", after(RETURNS, PAIRS + ", f AS (SELECT *, regr_slope(y, x) OVER (PARTITION BY ticker) AS b, regr_intercept(y, x) OVER (PARTITION BY ticker) AS a, avg(x) OVER (PARTITION BY ticker) AS mx FROM x), u AS (SELECT *, (x - mx) * (y - a - b * x) AS u FROM f), l AS (SELECT *, u * u + 2 * (1 - 1 / 6.0::DOUBLE) * u * coalesce(lag(u, 1) OVER w, 0) + 2 * (1 - 2 / 6.0::DOUBLE) * u * coalesce(lag(u, 2) OVER w, 0) + 2 * (1 - 3 / 6.0::DOUBLE) * u * coalesce(lag(u, 3) OVER w, 0) + 2 * (1 - 4 / 6.0::DOUBLE) * u * coalesce(lag(u, 4) OVER w, 0) + 2 * (1 - 5 / 6.0::DOUBLE) * u * coalesce(lag(u, 5) OVER w, 0) AS m FROM u WINDOW w AS (PARTITION BY ticker ORDER BY day)) SELECT ticker, round(any_value(b), 6) + 0.0 AS beta, count(*) AS n, round(any_value(b) / (sqrt(sum(m)) / sum((x - mx) * (x - mx))), 5) + 0.0 AS t, round(corr(y, x), 6) + 0.0 AS corr FROM l GROUP BY 1 HAVING count(*) >= 30"))
def _(spark, sf):
    j = against_first(spark, sf)
    fit = regress.newey_west(j, ["ticker"], "day", "y", "x", 5).where("n >= 30")
    corr = j.groupBy("ticker").agg(F.corr("y", "x").alias("corr"))
    return fit.join(corr, "ticker").select("ticker", rnd("beta").alias("beta"), "n", rnd("t", 5).alias("t"), rnd("corr").alias("corr"))


@query("nw_auto", after(STACK, """, f AS (SELECT ticker, count(*) AS n, regr_slope(y, x1) AS b, regr_intercept(y, x1) AS a, corr(y, x1) AS c, regr_r2(y, x1) AS r2, sum(x1) AS sx, sum(x1 * x1) AS sxx, CAST(floor(4 * pow(count(*) / 100.0::DOUBLE, 2 / 9.0::DOUBLE)) AS INT) AS lags FROM st GROUP BY 1),
e AS (SELECT st.ticker, row_number() OVER (PARTITION BY st.ticker ORDER BY day) AS i, y - a - b * x1 AS e, x1 * (y - a - b * x1) AS g, lags FROM st JOIN f ON f.ticker = st.ticker),
s AS (SELECT p.ticker, sum(k * p.e * q.e) AS s00, sum(k / 2 * (p.e * q.g + p.g * q.e)) AS s01, sum(k * p.g * q.g) AS s11 FROM (SELECT p.*, l.l, CASE WHEN l.l = 0 THEN 1.0::DOUBLE ELSE 2 * (1 - l.l / (lags + 1.0::DOUBLE)) END AS k FROM e p, unnest(generate_series(0, 30)) l(l) WHERE l.l <= p.lags) p JOIN e q ON q.ticker = p.ticker AND q.i = p.i - p.l GROUP BY 1)
SELECT f.ticker, n, lags, round(b, 6) + 0.0 AS beta, round(b * (n * sxx - sx * sx) / sqrt(sx * sx * s00 - 2 * sx * n * s01 + n * n * s11), 4) + 0.0 AS t, round(a, 8) + 0.0 AS alpha, round(a * (n * sxx - sx * sx) / sqrt(sxx * sxx * s00 - 2 * sxx * sx * s01 + sx * sx * s11), 4) + 0.0 AS t_alpha, round(c, 6) + 0.0 AS corr, round(r2, 6) + 0.0 AS r2 FROM f JOIN s ON s.ticker = f.ticker"""))
def _(spark, sf):
    f = regress.newey_west_auto(stacked(spark, sf), ["ticker"], "day", "y", "x1")
    digits = {"beta": 6, "t": 4, "alpha": 8, "t_alpha": 4, "corr": 6, "r2": 6}
    return f.select("ticker", "n", "lags", *[rnd(c, d).alias(c) for c, d in digits.items()])


@query("downside_beta", after(RETURNS, PAIRS + ", c AS (SELECT *, avg(x) OVER (PARTITION BY ticker) - stddev_samp(x) OVER (PARTITION BY ticker) AS cut FROM x) SELECT ticker, round(covar_samp(y, x) / var_samp(x), 6) + 0.0 AS beta, CASE WHEN count(*) FILTER (x < cut) > 10 THEN round(covar_samp(y, x) FILTER (x < cut) / var_samp(x) FILTER (x < cut), 6) + 0.0 END AS downside, count(*) FILTER (x < cut) AS n_down, round(avg(y) FILTER (x < cut) * 10000, 4) + 0.0 AS mean_bp FROM c GROUP BY 1"))
def _(spark, sf):
    by = Window.partitionBy("ticker")
    j = against_first(spark, sf).withColumn("low", F.col("x") < F.avg("x").over(by) - F.stddev_samp("x").over(by))
    y, x, low = F.when(F.col("low"), F.col("y")), F.when(F.col("low"), F.col("x")), F.count_if("low")
    return j.groupBy("ticker").agg(
        rnd(F.covar_samp("y", "x") / F.var_samp("x")).alias("beta"),
        F.when(low > 10, rnd(F.covar_samp(y, x) / F.var_samp(x))).alias("downside"),
        low.alias("n_down"),
        rnd(F.avg(y) * 10000, 4).alias("mean_bp"),
    )


#: rows whose five next days are not all before the cut are kept out of the first period
CUT = "1998-01-01"


@query("ols_nonoverlap", after(RETURNS, f""", ri AS (SELECT ticker, day, r AS x, row_number() OVER w AS i, sum(r) OVER f AS y, count(r) OVER f AS c, max(day) OVER f AS ends FROM rt WINDOW w AS (PARTITION BY ticker ORDER BY day), f AS (PARTITION BY ticker ORDER BY day ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)),
p AS (SELECT ticker, (i % 5)::INT AS o, CASE WHEN day < DATE '{CUT}' THEN 'first' ELSE 'second' END AS period, x, y FROM ri WHERE c = 5 AND x IS NOT NULL AND (day >= DATE '{CUT}' OR ends < DATE '{CUT}'))
SELECT ticker, period, o, count(*) AS n, round(regr_slope(y, x), 6) + 0.0 AS beta, round(regr_slope(y, x) / sqrt((regr_syy(y, x) - regr_slope(y, x) * regr_sxy(y, x)) / (count(*) - 2) / regr_sxx(y, x)), 4) + 0.0 AS t FROM p GROUP BY 1, 2, 3 HAVING count(*) >= 4 AND regr_sxx(y, x) > 0"""))
def _(spark, sf):
    ahead = by_ticker().rowsBetween(1, 5)
    cut = F.lit(CUT).cast("date")
    r = returns(spark, sf).select(
        "ticker", "day", F.col("r").alias("x"), (F.row_number().over(by_ticker()) % 5).alias("o"),
        F.sum("r").over(ahead).alias("y"), F.count("r").over(ahead).alias("c"), F.max("day").over(ahead).alias("ends"),
    )
    r = r.where((F.col("c") == 5) & F.col("x").isNotNull() & ((F.col("day") >= cut) | (F.col("ends") < cut)))
    period = F.when(F.col("day") < cut, "first").otherwise("second")
    g = r.groupBy("ticker", period.alias("period"), "o").agg(
        F.count("*").alias("n"), F.regr_slope("y", "x").alias("b"), F.regr_sxx("y", "x").alias("sxx"),
        (F.regr_syy("y", "x") - F.regr_slope("y", "x") * F.regr_sxy("y", "x")).alias("rss"),
    ).where("n >= 4 and sxx > 0")
    return g.select("ticker", "period", "o", "n", rnd("b").alias("beta"), rnd(F.col("b") / F.sqrt(F.col("rss") / (F.col("n") - 2) / F.col("sxx")), 4).alias("t"))


@query("drop_collinear", """SELECT 'l_quantity' AS kept FROM lineitem HAVING var_samp(l_quantity) > 0
UNION ALL SELECT 'twice' FROM lineitem HAVING var_samp(l_quantity * 2) > 0 AND abs(corr(l_quantity * 2, l_quantity)) < 1 - 1e-9
UNION ALL SELECT 'zero' FROM lineitem HAVING var_samp(l_quantity * 0) > 0
UNION ALL SELECT 'l_tax' FROM lineitem HAVING var_samp(l_tax) > 0 AND abs(corr(l_tax, l_quantity)) < 1 - 1e-9""")
def _(spark, sf):
    """Two numbers a pair of columns come to the driver when the query is built."""
    l = table(spark, sf, "lineitem").select("l_quantity", (F.col("l_quantity") * 2).alias("twice"), (F.col("l_quantity") * 0).alias("zero"), "l_tax")
    names = ["l_quantity", "twice", "zero", "l_tax"]
    centred = l.crossJoin(l.agg(*[F.avg(c).alias(f"m_{c}") for c in names])).select(*[(F.col(c) - F.col(f"m_{c}")).alias(c) for c in names])
    g, _, _ = regress.gram(centred, "l_tax", names)
    return spark.createDataFrame([(names[i],) for i in regress.independent(g)], "kept string")


DK2 = STACK + """,
d0 AS (SELECT ticker, day, y, x1, y * 0 + x2 AS x2, abs(x1) AS x3 FROM st),
d AS (SELECT ticker, day, x1 - avg(x1) OVER (PARTITION BY ticker) AS a, x3 - avg(x3) OVER (PARTITION BY ticker) AS b, y - avg(y) OVER (PARTITION BY ticker) AS y FROM d0),
m AS (SELECT sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a * y) AS ay, sum(b * y) AS by_, sum(a * a) * sum(b * b) - sum(a * b) * sum(a * b) AS det, count(*) AS n FROM d),
c AS (SELECT *, (ay * bb - by_ * ab) / det AS b1, (by_ * aa - ay * ab) / det AS b2 FROM m),
h AS (SELECT day, sum(a * (y - b1 * a - b2 * b)) AS ha, sum(b * (y - b1 * a - b2 * b)) AS hb, row_number() OVER (ORDER BY day) AS i FROM d, c GROUP BY day),
v AS (SELECT sum(k * p.ha * q.ha) AS saa, sum(k / 2 * (p.ha * q.hb + p.hb * q.ha)) AS sab, sum(k * p.hb * q.hb) AS sbb FROM h p JOIN h q ON q.i BETWEEN p.i - 5 AND p.i, LATERAL (SELECT CASE WHEN p.i = q.i THEN 1.0::DOUBLE ELSE 2 * (1 - (p.i - q.i) / 6.0::DOUBLE) END AS k)),
t AS (SELECT 'x1' AS regressor, b1 AS coef, b1 / (sqrt(bb * bb * saa - 2 * bb * ab * sab + ab * ab * sbb) / det) AS t, n FROM c, v UNION ALL SELECT 'x3', b2, b2 / (sqrt(ab * ab * saa - 2 * ab * aa * sab + aa * aa * sbb) / det), n FROM c, v)"""


def pooled(spark, sf):
    """Rows of the pooled model with both regressors; k x k moments come to the driver when the query is built."""
    s = stacked(spark, sf).withColumn("x3", F.abs("x1"))
    rows = regress.panel_fit(s, "ticker", "day", "y", ["x1", "x3"], lags=5)
    return spark.createDataFrame([(r["regressor"], r["coef"], r["t"], r["n"]) for r in rows], "regressor string, coef double, t double, n long")


@query("gate", sql(DK2, "SELECT regressor, round(coef, 6) + 0.0 AS coef, round(t, 4) + 0.0 AS t, n, coef > 0 AND t > 0.25 AS passes FROM t"))
def _(spark, sf):
    p = pooled(spark, sf)
    return p.select("regressor", rnd("coef").alias("coef"), rnd("t", 4).alias("t"), "n", ((F.col("coef") > 0) & (F.col("t") > 0.25)).alias("passes"))


@query("wald_equal")
def _(spark, sf):
    """One number a pair of tickers comes to the driver when the query is built."""
    w = regress.wald_equal_slopes(stacked(spark, sf), "ticker", "day", "y", "x1")
    return spark.createDataFrame([(w["n"], w["wald"], w["p"])], "n_pairs int, wald double, p double")


def slopes_sql(source, keys):
    """CTE chain from ``source`` (keys, ticker, day, y, x, lags) to ``pt``: coef, t and n by key, within tickers, Driscoll-Kraay."""
    k = ", ".join(keys)
    on = lambda a, b: " AND ".join(f"{a}.{c} = {b}.{c}" for c in keys)
    return f"""pa AS (SELECT {k}, day, lags, y - avg(y) OVER (PARTITION BY {k}, ticker) AS y, x - avg(x) OVER (PARTITION BY {k}, ticker) AS x FROM {source} WHERE y IS NOT NULL AND x IS NOT NULL),
pb AS (SELECT {k}, sum(x * y) / sum(x * x) AS b, sum(x * x) AS xx, count(*) AS n, max(lags) AS lags FROM pa GROUP BY ALL HAVING sum(x * x) > 1e-18),
ph0 AS (SELECT {", ".join("pa." + c for c in keys)}, pa.day, sum(x * (y - b * x)) AS sc, max(pb.lags) AS lags FROM pa JOIN pb ON {on("pa", "pb")} GROUP BY {", ".join("pa." + c for c in keys)}, pa.day),
ph AS (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY day) AS i FROM ph0),
pv AS (SELECT {", ".join("p." + c for c in keys)}, sum(p.sc * q.sc * CASE WHEN p.i = q.i THEN 1 ELSE 2 * (1 - (p.i - q.i) / (p.lags + 1.0::DOUBLE)) END) AS s FROM ph p JOIN ph q ON {on("p", "q")} AND q.i <= p.i AND q.i >= p.i - p.lags GROUP BY {", ".join("p." + c for c in keys)}),
pt AS (SELECT {", ".join("pb." + c for c in keys)}, b AS coef, b / nullif(sqrt(s) / xx, 0) AS t, n FROM pb JOIN pv ON {on("pb", "pv")})"""


WEEKEND = RETURNS + """,
wf AS (SELECT ticker, day, s / 100 AS s, r, n, lead(day) OVER w AS d1, lead(s) OVER w / 100 AS s1, lead(day, 2) OVER w AS d2, lead(s, 2) OVER w / 100 AS s2 FROM rt WINDOW w AS (PARTITION BY ticker ORDER BY day)),
ws AS (SELECT v.v AS variant, p.p AS reopen, ticker, day, CASE p.p WHEN 'first' THEN s1 - s ELSE s2 - s END AS y, CASE v.v WHEN 'return' THEN r ELSE n - 1.0::DOUBLE END AS x, 4 AS lags
  FROM wf CROSS JOIN (VALUES ('return'), ('count')) v(v) CROSS JOIN (VALUES ('first'), ('second')) p(p) WHERE isodow(day) = 5 AND CASE p.p WHEN 'first' THEN d1 - day ELSE d2 - day END BETWEEN 2 AND 4)"""


@query("weekend_regression", sql(WEEKEND + ", " + slopes_sql("ws", ["variant", "reopen"]), "SELECT variant, reopen, round(coef, 6) + 0.0 AS coef, round(t, 4) + 0.0 AS t, n FROM pt"))
def _(spark, sf):
    w = by_ticker()
    s = F.col("s") / 100
    f = returns(spark, sf).select(
        "ticker", "day", s.alias("s"), "r", "n", F.lead("day").over(w).alias("d1"), F.lead(s).over(w).alias("s1"), F.lead("day", 2).over(w).alias("d2"), F.lead(s, 2).over(w).alias("s2")
    ).where(F.weekday("day") == 4)
    models = F.broadcast(spark.createDataFrame([(v, p) for v in ("return", "count") for p in ("first", "second")], "variant string, reopen string"))
    first = F.col("reopen") == "first"
    rows = f.crossJoin(models).where(F.datediff(F.when(first, F.col("d1")).otherwise(F.col("d2")), "day").between(2, 4))
    rows = rows.withColumn("y", F.when(first, F.col("s1")).otherwise(F.col("s2")) - F.col("s"))
    rows = rows.withColumn("x", F.when(F.col("variant") == "return", F.col("r")).otherwise(F.col("n") - 1.0)).withColumn("lags", F.lit(4))
    p = regress.panel_slopes(rows, ["variant", "reopen"], "ticker", "day", "y", "x", "lags")
    return p.select("variant", "reopen", rnd("coef").alias("coef"), rnd("t", 4).alias("t"), "n")


SWEEP = RETURNS + """,
si AS (SELECT ticker, day, r, CAST(n AS DOUBLE) AS c, r - lag(r) OVER w AS dr, sum(r) OVER h1 AS y1, count(r) OVER h1 AS c1, sum(r) OVER h5 AS y5, count(r) OVER h5 AS c5, sum(r) OVER h20 AS y20, count(r) OVER h20 AS c20 FROM rt
  WINDOW w AS (PARTITION BY ticker ORDER BY day), h1 AS (PARTITION BY ticker ORDER BY day ROWS BETWEEN 1 FOLLOWING AND 1 FOLLOWING), h5 AS (PARTITION BY ticker ORDER BY day ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING), h20 AS (PARTITION BY ticker ORDER BY day ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING)),
ss AS (SELECT 'predictive' AS model, 1 AS h, ticker, day, CASE WHEN c1 = 1 THEN y1 END AS y, r AS x, 5 AS lags FROM si UNION ALL SELECT 'predictive', 5, ticker, day, CASE WHEN c5 = 5 THEN y5 END, r, 5 FROM si
  UNION ALL SELECT 'predictive', 20, ticker, day, CASE WHEN c20 = 20 THEN y20 END, r, 20 FROM si UNION ALL SELECT 'contemporaneous', 0, ticker, day, r, c, 5 FROM si UNION ALL SELECT 'interaction', 1, ticker, day, CASE WHEN c1 = 1 THEN y1 END, r * c, 5 FROM si)"""


@query("diagnostic_sweep", sql(SWEEP + ", " + slopes_sql("ss", ["model", "h"]), "SELECT model, h::INT AS h, round(coef, 6) + 0.0 AS coef, round(t, 4) + 0.0 AS t, n FROM pt"))
def _(spark, sf):
    def ahead(h):
        w = by_ticker().rowsBetween(1, h)
        return F.when(F.count("r").over(w) == h, F.sum("r").over(w))

    r = returns(spark, sf).select("ticker", "day", "r", F.col("n").cast("double").alias("c"), *[ahead(h).alias(f"y{h}") for h in (1, 5, 20)])
    models = [("predictive", h, F.col(f"y{h}"), F.col("r"), max(h, 5)) for h in (1, 5, 20)]
    models += [("contemporaneous", 0, F.col("r"), F.col("c"), 5), ("interaction", 1, F.col("y1"), F.col("r") * F.col("c"), 5)]
    one = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.lit(h).alias("h"), y.alias("y"), x.alias("x"), F.lit(l).alias("lags")) for m, h, y, x, l in models]))
    rows = r.select("ticker", "day", one.alias("m")).select("ticker", "day", "m.*")
    p = regress.panel_slopes(rows, ["model", "h"], "ticker", "day", "y", "x", "lags")
    return p.select("model", "h", rnd("coef").alias("coef"), rnd("t", 4).alias("t"), "n")
