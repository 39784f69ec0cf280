"""Robustness queries: every variant is a run, and all runs of a study go through the pipeline as one job."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.common import rnd
from tidemark.operators import book, shocks, stats, study
from tidemark.operators.grid import eligible
from tidemark.plans.base import returns, sql
from tidemark.plans.q_book import STAT, stat_out
from tidemark.plans.q_series import CHANGED, Z, changed, z_rows
from tidemark.plans.q_shocks import signal_sql
from tidemark.plans.q_strategy import RX, quotes
from tidemark.plans.registry import query
from tidemark.sources.files import written

RUNS = [("actual", "actual", 0.0, 5.0), ("reversed", "sign", -1.0, 5.0), ("equal", "equal", 0.0, 5.0), ("random", "random", 0.0, 5.0)]
RUNS += [(f"volume:{v}", "volume", float(v), 5.0) for v in (30, 60)] + [(f"halflife:{h}", "actual", 0.0, float(h)) for h in (2, 10)]
N_EVENTS, N_SHUFFLES, LONGEST = 10, 100, 10.0
USED = (0, 2, 4)

BASKET = "rt AS (SELECT o_orderpriority AS ticker, CAST(o_orderdate AS DATE) AS day, ln(avg(o_totalprice)) AS s FROM orders GROUP BY 1, 2), rs AS (SELECT day, (s - lag(s) OVER (PARTITION BY ticker ORDER BY day)) / 100 AS r FROM rt), mk2 AS (SELECT day, avg(r) AS m, row_number() OVER (ORDER BY day) - 1 AS j FROM rs WHERE r IS NOT NULL GROUP BY day)"


def values_sql(runs):
    return ", ".join(f"('{r}', '{k}', {p}::DOUBLE, {h}::DOUBLE)" for r, k, p, h in runs)


def study_sql(runs, events=True, min_events=1, prefix=Z):
    """CTE chain to ``sg`` (run, day, i, d, z) over the runs."""
    top = f" UNION ALL SELECT 'without:' || event_no, 'without', CAST(event_no AS DOUBLE), 5.0::DOUBLE FROM (SELECT event_no FROM zz WHERE theme IN (0, 2, 4) GROUP BY 1 ORDER BY round(sum(vol1d), 6) DESC, event_no LIMIT {N_EVENTS})" if events else ""
    return prefix + f""",
rn AS (SELECT * FROM (VALUES {values_sql(runs)}) t(run, kind, p, h){top}),
rr AS (SELECT rn.run, rn.h, contract_id, event_no, day, CASE WHEN kind = 'sign' THEN z * p WHEN kind = 'random' THEN z * CASE WHEN CAST('0x' || substr(md5('placebo|' || run || '|' || contract_id), 1, 8) AS BIGINT) % 2 = 0 THEN 1.0::DOUBLE ELSE -1 END ELSE z END AS z, CASE WHEN kind = 'equal' THEN 1 ELSE vol7d END AS w
  FROM zz CROSS JOIN rn WHERE CASE WHEN kind = 'random' THEN theme NOT IN (0, 2, 4) ELSE theme IN (0, 2, 4) END AND (kind <> 'volume' OR vol7d >= p) AND (kind <> 'without' OR event_no <> p)),
rc AS (SELECT run, day, sum(z * w) / nullif(sum(w), 0) AS d, count(DISTINCT contract_id) AS n_contracts FROM rr WHERE z IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT event_no) >= {min_events}),
rd AS (SELECT CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM zz),
re AS (SELECT rn.run, rn.h, rd.day, coalesce(d, 0) AS d, coalesce(n_contracts, 0) AS n_contracts, row_number() OVER (PARTITION BY rn.run ORDER BY rd.day) AS i FROM rn CROSS JOIN rd LEFT JOIN rc ON rc.run = rn.run AND rc.day = rd.day),
""" + signal_sql("re", ["run"], "a.h")


SHUFFLED = f""", sb AS (SELECT s.seed, day, z, date_trunc('month', day) AS m FROM sg, unnest(generate_series(1, {N_SHUFFLES})) s(seed) WHERE run = 'actual'),
s1 AS (SELECT *, row_number() OVER (PARTITION BY seed, m ORDER BY day) AS k, row_number() OVER (PARTITION BY seed, m ORDER BY CAST('0x' || substr(md5('deal|' || seed || '|' || CAST(day AS VARCHAR)), 1, 8) AS BIGINT), day) AS q FROM sb),
al AS (SELECT run, day, z FROM sg UNION ALL SELECT 'shuffle:' || a.seed, a.day, b.z FROM s1 a JOIN s1 b ON b.seed = a.seed AND b.m = a.m AND b.q = a.k)"""


def returns_sql(hold=1, source="al"):
    return f""", {BASKET}, po AS (SELECT *, last_value(CASE WHEN (j - 1) % {hold} = 0 THEN z END IGNORE NULLS) OVER (PARTITION BY run ORDER BY j) AS pos FROM (SELECT run, day, z, row_number() OVER (PARTITION BY run ORDER BY day) AS j FROM {source})),
pr AS (SELECT run, pos * m AS r FROM po JOIN mk2 ON mk2.j = po.j),
sh AS (SELECT run, count(r) AS n, avg(r) / nullif(stddev_samp(r), 0) * sqrt(252) AS sharpe FROM pr GROUP BY 1)"""


def sums_of(spark, sf, runs):
    """Sums by event and day, written once for all uses of a study."""
    rows = z_rows(spark, sf).select("contract_id", "event_no", "theme", "day", "z", "vol7d", "vol1d")
    return written(study.event_days(rows, runs, F.col("theme").isin(*USED)), "event-days")


def signals(sums, runs, events=True, min_events=1):
    removed = study.top_events(sums, N_EVENTS) if events else ()
    return written(study.run_signals(sums, runs, LONGEST, min_events, removed), "run-signals")


def basket(spark, sf):
    return returns(spark, sf).where("r is not null").groupBy("day").agg(F.avg("r").alias("m"))


@query("placebo_run", sql(study_sql(RUNS) + SHUFFLED + returns_sql(), "SELECT run, n, round(sharpe, 4) + 0.0 AS sharpe FROM sh"))
def _(spark, sf):
    s = study.with_shuffles(signals(sums_of(spark, sf, RUNS), RUNS), N_SHUFFLES)
    return study.sharpe_by_run(study.run_returns(s, basket(spark, sf))).select("run", "n", rnd("sharpe", 4).alias("sharpe"))


@query("placebo_summary", sql(study_sql(RUNS) + SHUFFLED + returns_sql(), ", k AS (SELECT CASE WHEN run LIKE '%:%' THEN split_part(run, ':', 1) ELSE run END AS test, sharpe FROM sh WHERE sharpe IS NOT NULL), a AS (SELECT sharpe AS actual FROM sh WHERE run = 'actual') SELECT test, count(*) AS n, round(avg(sharpe), 4) + 0.0 AS mean, round(min(sharpe), 4) + 0.0 AS lo, round(max(sharpe), 4) + 0.0 AS hi, round(avg(CASE WHEN sharpe < actual THEN 1.0::DOUBLE ELSE 0 END), 6) AS beaten FROM k, a WHERE test <> 'actual' GROUP BY 1").replace(")\n, k", "), k"))
def _(spark, sf):
    s = study.with_shuffles(signals(sums_of(spark, sf, RUNS), RUNS), N_SHUFFLES)
    sh = study.sharpe_by_run(study.run_returns(s, basket(spark, sf))).where("sharpe is not null")
    actual = F.max(F.when(F.col("run") == "actual", F.col("sharpe"))).over(Window.partitionBy())  # a row a run
    k = sh.withColumn("actual", actual).withColumn("test", F.substring_index("run", ":", 1)).where("test <> 'actual'")
    return k.groupBy("test").agg(
        F.count("*").alias("n"), rnd(F.avg("sharpe"), 4).alias("mean"), rnd(F.min("sharpe"), 4).alias("lo"), rnd(F.max("sharpe"), 4).alias("hi"),
        F.round(F.avg(F.when(F.col("sharpe") < F.col("actual"), 1.0).otherwise(0.0)), 6).alias("beaten"),
    )


@query("leave_one_event_out", sql(study_sql([RUNS[0]]) + returns_sql(source="sg"), "SELECT run, n, round(sharpe, 4) + 0.0 AS sharpe FROM sh"))
def _(spark, sf):
    s = signals(sums_of(spark, sf, RUNS[:1]), RUNS[:1])
    return study.sharpe_by_run(study.run_returns(s, basket(spark, sf))).select("run", "n", rnd("sharpe", 4).alias("sharpe"))


LATER = [r for r in RUNS if r[0] in ("actual", "reversed", "random")]


@query("posthoc_placebos", sql(study_sql(LATER, events=False) + SHUFFLED + returns_sql(hold=5), "SELECT 'weekly' AS strategy, run, n, round(sharpe, 4) + 0.0 AS sharpe FROM sh")
       + " UNION ALL SELECT * FROM (" + sql(study_sql(LATER, events=False, min_events=3) + SHUFFLED + returns_sql(), "SELECT 'three events' AS strategy, run, n, round(sharpe, 4) + 0.0 AS sharpe FROM sh") + ")")
def _(spark, sf):
    out, sums = [], sums_of(spark, sf, LATER)
    for name, hold, events in (("weekly", 5, 1), ("three events", 1, 3)):
        s = study.with_shuffles(signals(sums, LATER, events=False, min_events=events), N_SHUFFLES)
        out.append(study.sharpe_by_run(study.run_returns(s, basket(spark, sf), hold)).select(F.lit(name).alias("strategy"), "run", "n", rnd("sharpe", 4).alias("sharpe")))
    return out[0].unionByName(out[1])


HALVES = [(f"halflife:{h}", "actual", 0.0, float(h)) for h in (2, 5, 10)]


@query("halflife_grid", sql(study_sql(HALVES, events=False), "SELECT run, CAST(day AS DATE) AS day, round(z, 4) + 0.0 AS z FROM sg"))
def _(spark, sf):
    return signals(sums_of(spark, sf, HALVES), HALVES, events=False).select("run", "day", rnd("z", 4).alias("z"))


COUNTER = Z + """,
kf AS (SELECT r.run, theme, day, sum(z * vol7d * CASE WHEN r.run = 'zero' THEN 0 ELSE 1 END) / nullif(sum(vol7d), 0) AS d, count(DISTINCT contract_id) AS n_contracts FROM zz CROSS JOIN (VALUES ('full'), ('subset'), ('zero')) r(run) WHERE z IS NOT NULL AND (r.run <> 'subset' OR NOT is_deadline) GROUP BY 1, 2, 3),
kg AS (SELECT run, theme, CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM kf GROUP BY run, theme),
kh AS (SELECT kg.run, kg.theme, kg.day, coalesce(d, 0) AS d, coalesce(n_contracts, 0) AS n_contracts, row_number() OVER (PARTITION BY kg.run, kg.theme ORDER BY kg.day) AS i FROM kg LEFT JOIN kf ON kf.run = kg.run AND kf.theme = kg.theme AND kf.day = kg.day),
""" + signal_sql("kh", ["run", "theme"])


@query("counterfactual_cell", sql(COUNTER, "SELECT run, theme, CAST(day AS DATE) AS day, round(d, 5) + 0.0 AS d, round(z, 4) + 0.0 AS z FROM sg"))
def _(spark, sf):
    zz = z_rows(spark, sf).where("z is not null").withColumn("run", F.explode(F.array(*[F.lit(r) for r in ("full", "subset", "zero")])))
    zz = zz.where((F.col("run") != "subset") | ~F.col("is_deadline")).withColumn("z", F.when(F.col("run") == "zero", 0.0).otherwise(F.col("z")))
    s = shocks.theme_series(zz.withColumn("z_early", F.col("z")), ["run", "theme"], [], F.lit(False))
    return shocks.cell_signal(s, ["run", "theme"]).select("run", "theme", "day", rnd("d", 5).alias("d"), rnd("z", 4).alias("z"))


@query("threshold_panels", sql(CHANGED, "SELECT v::INT AS threshold, u AS units, theme, CAST(day AS DATE) AS day, count(*) AS n, round(sum(sign * dv * vol7d) / nullif(sum(CASE WHEN dv IS NOT NULL THEN vol7d END), 0), 6) + 0.0 AS d FROM ch CROSS JOIN (VALUES (10), (50), (250)) t(v) CROSS JOIN (VALUES ('all'), ('prob')) g(u) WHERE coalesce(px BETWEEN 0.02 AND 0.98 AND vol7d >= v AND ttr_days BETWEEN 3 AND 365, false) AND (u = 'all' OR unit = u) GROUP BY 1, 2, 3, 4"))
def _(spark, sf):
    grid = F.broadcast(spark.createDataFrame([(v, u) for v in (10, 50, 250) for u in ("all", "prob")], "threshold int, units string"))
    rows = changed(spark, sf).crossJoin(grid).where(eligible(F.col("threshold")) & ((F.col("units") == "all") | (F.col("unit") == F.col("units"))))
    d = F.sum(F.col("sign") * F.col("dv") * F.col("vol7d")) / F.expr("nullif(sum(case when dv is not null then vol7d end), 0)")
    return rows.groupBy("threshold", "units", "theme", "day").agg(F.count("*").alias("n"), rnd(d).alias("d"))


VARIANTS = [("all", "0", "9", 1.0), ("capped", "0", "9", 0.3), ("top", "0", "4", 1.0), ("low", "3", "9", 0.4)]
UNIVERSE = RX + """,
uv AS (SELECT * FROM (VALUES ('all', '0', '9', 1.0::DOUBLE), ('capped', '0', '9', 0.3), ('top', '0', '4', 1.0), ('low', '3', '9', 0.4)) t(v, lo, hi, cap)),
u0 AS (SELECT v, cap, ticker, day, rx, sign(rx) * (1 + n % 3) * 0.2 AS w FROM rx JOIN uv ON ticker BETWEEN lo AND hi WHERE rx IS NOT NULL),
u1 AS (SELECT *, cap * sum(abs(w)) OVER (PARTITION BY v, day) AS lim FROM u0),
u2 AS (SELECT *, greatest(-lim, least(lim, w)) AS w1 FROM u1),
u3 AS (SELECT *, sum(abs(w1)) OVER (PARTITION BY v, day) AS g FROM u2),
u4 AS (SELECT v, ticker, day, rx, w1 * CASE WHEN g > 1.0 THEN 1.0 / g ELSE 1 END AS w FROM u3),
u5 AS (SELECT v, day, coalesce(lag(w) OVER (PARTITION BY v, ticker ORDER BY day) * rx, 0) AS pnl FROM u4),
u6 AS (SELECT v, day, sum(pnl) AS r FROM u5 GROUP BY 1, 2)"""


@query("universe_variants", sql(UNIVERSE, f"SELECT v, {STAT} FROM u6 GROUP BY 1"))
def _(spark, sf):
    v = F.broadcast(spark.createDataFrame(VARIANTS, "v string, lo string, hi string, cap double"))
    q = quotes(spark, sf).where("rx is not null").join(v, F.col("ticker").between(F.col("lo"), F.col("hi")))
    q = q.withColumn("w", F.signum("rx") * (1 + F.col("n") % 3) * 0.2)
    capped = book.cap_weights(q, ["v", "day"], F.col("cap"), 1.0).select("v", "ticker", "day", "rx", F.col("capped").alias("w"))
    p = book.position_pnl(capped, ["v", "ticker"], "day", r="rx")
    return stat_out(stats.perf_stats(p.groupBy("v", "day").agg(F.sum("pnl").alias("r")), ["v"]), "v")


GRID = """gb AS (SELECT day, avg(rx) AS m, row_number() OVER (ORDER BY day) AS i FROM rx WHERE rx IS NOT NULL GROUP BY day),
gs AS (SELECT *, stddev_samp(m) OVER (ORDER BY i ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING) AS sd FROM gb),
gg AS (SELECT k, t, n, day, i, m, i - last_value(CASE WHEN abs(m) > k * sd THEN i END IGNORE NULLS) OVER (PARTITION BY k, t, n ORDER BY i) AS since FROM gs CROSS JOIN (VALUES (1.0::DOUBLE), (1.5), (2.0)) a(k) CROSS JOIN (VALUES (0.0::DOUBLE), (0.25), (0.5)) b(t) CROSS JOIN (VALUES (5), (10), (20)) c(n)),
ge AS (SELECT *, CASE WHEN since IS NULL OR since >= n THEN 1.0::DOUBLE ELSE t + (1 - t) * since / n END AS e FROM gg),
gr AS (SELECT k, t, n, lag(e) OVER (PARTITION BY k, t, n ORDER BY i) * m AS r FROM ge)"""


@query("param_grid", sql(RX + ", " + GRID, "SELECT k, t, n::INT AS days, count(r) AS n, round(avg(r) / stddev_samp(r) * sqrt(252), 5) + 0.0 AS sharpe, round(product(1 + r) - 1, 6) + 0.0 AS total_return FROM gr WHERE r IS NOT NULL GROUP BY 1, 2, gr.n"))
def _(spark, sf):
    m = quotes(spark, sf).where("rx is not null").groupBy("day").agg(F.avg("rx").alias("m"))
    w = Window.orderBy("day")  # a row a day
    m = m.withColumn("i", F.row_number().over(w)).withColumn("sd", F.stddev_samp("m").over(w.rowsBetween(-60, -1)))
    grid = [(k, t, d) for k in (1.0, 1.5, 2.0) for t in (0.0, 0.25, 0.5) for d in (5, 10, 20)]
    g = m.crossJoin(F.broadcast(spark.createDataFrame(grid, "k double, t double, days int")))
    by = Window.partitionBy("k", "t", "days").orderBy("i")
    since = F.col("i") - F.last(F.when(F.abs("m") > F.col("k") * F.col("sd"), F.col("i")), True).over(by)
    g = g.withColumn("since", since).withColumn("e", book.timing_exposure("since", F.col("t"), F.col("days")))
    r = g.withColumn("r", F.lag("e").over(by) * F.col("m"))
    return stats.perf_stats(r, ["k", "t", "days"]).select("k", "t", "days", "n", rnd("sharpe", 5).alias("sharpe"), rnd("total_return").alias("total_return"))


PHASE = """pi AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY day) AS k, sign(round(sum(rx) OVER (PARTITION BY ticker ORDER BY day ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 9)) AS f FROM rx),
ph AS (SELECT o, ticker, day, rx, k, last_value(CASE WHEN k % 20 = o THEN f END IGNORE NULLS) OVER (PARTITION BY o, ticker ORDER BY k) AS pos FROM pi, unnest(generate_series(0, 19)) t(o)),
pq AS (SELECT o, day, lag(pos) OVER (PARTITION BY o, ticker ORDER BY k) * rx AS pnl FROM ph),
pr AS (SELECT o, day, sum(pnl) AS r FROM pq WHERE pnl IS NOT NULL GROUP BY 1, 2)"""


@query("phase_scan", sql(RX + ", " + PHASE, "SELECT o::INT AS o, count(*) AS n, round(avg(r) / stddev_samp(r) * sqrt(252), 5) + 0.0 AS sharpe FROM pr GROUP BY 1"))
def _(spark, sf):
    w = Window.partitionBy("ticker").orderBy("day")
    q = quotes(spark, sf).withColumn("k", F.row_number().over(w)).withColumn("f", F.signum(F.round(F.sum("rx").over(w.rowsBetween(-9, 0)), 9)))
    q = q.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(19))))
    by = Window.partitionBy("o", "ticker").orderBy("k")
    q = q.withColumn("pos", F.last(F.when(F.col("k") % 20 == F.col("o"), F.col("f")), True).over(by))
    q = q.withColumn("pnl", F.lag("pos").over(by) * F.col("rx")).where("pnl is not null")
    r = q.groupBy("o", "day").agg(F.sum("pnl").alias("r"))
    return stats.perf_stats(r, ["o"]).select("o", "n", rnd("sharpe", 5).alias("sharpe"))
