"""Performance tables, correlations, label scores, partition rules, weekend and hourly indices, file layouts."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.common import clip, hazard, rnd
from tidemark.operators import asof, grid, labels, stats
from tidemark.plans.base import DAYS, RAW, RETURNS, days, raw_tape, returns, sql, table, trades
from tidemark.plans.q_book import PNL, STAT, pl
from tidemark.plans.q_joins import WIN, windows
from tidemark.plans.q_more import scratch
from tidemark.plans.q_series import Z, z_rows
from tidemark.plans.registry import query
from tidemark.sources import files

# -- performance ----------------------------------------------------------------------------------

FULL = {
    "total_return": 6, "ann_mean": 6, "ann_vol": 6, "sharpe": 5, "sortino": 5, "hit_rate": 6, "skew": 4, "kurt": 4, "t_mean": 5,
    "max_drawdown": 6, "calmar": 4, "turnover": 4, "holding_days": 4, "gross": 6, "cost_drag": 8,
}


def perf_sql(source, keys):
    """Full statistics of ``source`` (keys, ticker, day, r, dw, g, cost)."""
    k = ", ".join(keys)
    on = " AND ".join(f"a.{c} = b.{c}" for c in keys)
    return f""", fa AS (SELECT {k}, day, product(1 + r) OVER w AS wealth FROM {source} WHERE r IS NOT NULL WINDOW w AS (PARTITION BY {k} ORDER BY day)),
fb AS (SELECT *, wealth / max(wealth) OVER (PARTITION BY {k} ORDER BY day) - 1 AS dd FROM fa),
fc AS (SELECT *, sum(CASE WHEN dd >= -1e-12 THEN 1 ELSE 0 END) OVER (PARTITION BY {k} ORDER BY day) AS e FROM fb),
fd AS (SELECT {k}, e, min(day) AS peak, min(dd) AS depth FROM fc GROUP BY {k}, e),
fe AS (SELECT *, lead(peak) OVER (PARTITION BY {k} ORDER BY e) AS recovery FROM fd),
ff AS (SELECT {k}, max(day) AS last FROM fb GROUP BY {k}),
fg AS (SELECT {", ".join("a." + c for c in keys)}, depth, (coalesce(recovery, last) - peak)::INT AS duration, row_number() OVER (PARTITION BY {", ".join("a." + c for c in keys)} ORDER BY round(depth, 12), peak) AS k FROM fe a JOIN ff b ON {on} WHERE depth < -1e-12),
fh AS (SELECT {k}, {STAT}, round(avg(dw) * 252, 4) + 0.0 AS turnover, round(avg(g) / nullif(avg(dw), 0), 4) + 0.0 AS holding_days, round(avg(g), 6) + 0.0 AS gross, round(avg(cost) * 252, 8) + 0.0 AS cost_drag, avg(r) * 252 AS mu FROM {source} WHERE r IS NOT NULL GROUP BY {k})
SELECT a.* EXCLUDE (mu), round(coalesce(depth, 0), 6) + 0.0 AS max_drawdown, coalesce(duration, 0) AS duration, round(mu / -depth, 4) + 0.0 AS calmar FROM fh a LEFT JOIN fg b ON {on} AND b.k = 1"""


def perf_out(df, *keys):
    return df.select(*keys, "n", "duration", *[rnd(c, d).alias(c) for c, d in FULL.items()])


BOOK_ROWS = PNL + ", pb AS (SELECT ticker, day, pnl - dw * 0.0002 AS r, dw, abs(w) AS g, dw * 0.0002 AS cost FROM pl)"


def book_rows(spark, sf):
    return pl(spark, sf).select("ticker", "day", (F.col("pnl") - F.col("cost")).alias("r"), "dw", F.abs("w").alias("g"), "cost")


@query("perf_stats", "WITH " + BOOK_ROWS + perf_sql("pb", ["ticker"]))
def _(spark, sf):
    return perf_out(stats.perf_table(book_rows(spark, sf), ["ticker"], "day"), "ticker")


@query("split_stats", "WITH " + BOOK_ROWS + ", " + WIN + ", ps AS (SELECT pb.*, name FROM pb JOIN w ON day BETWEEN a AND b)" + perf_sql("ps", ["ticker", "name"]))
def _(spark, sf):
    r = book_rows(spark, sf).join(windows(spark), F.col("day").between(F.col("a"), F.col("b"))).drop("a", "b")
    return perf_out(stats.perf_table(r, ["ticker", "name"], "day"), "ticker", "name")


@query("subperiod_stats", "WITH " + BOOK_ROWS + ", py AS (SELECT *, year(day)::INT AS y FROM pb)" + perf_sql("py", ["ticker", "y"]))
def _(spark, sf):
    r = book_rows(spark, sf).withColumn("y", F.year("day"))
    return perf_out(stats.perf_table(r, ["ticker", "y"], "day"), "ticker", "y")


@query("no_trade_band", "WITH RECURSIVE " + PNL + ", bi AS (SELECT ticker, day, w::DOUBLE AS w, row_number() OVER (PARTITION BY ticker ORDER BY day) AS i FROM bk), rec AS (SELECT ticker, day, w, i, w AS held FROM bi WHERE i = 1 UNION ALL SELECT b.ticker, b.day, b.w, b.i, CASE WHEN r.held = 0 OR b.w = 0 OR abs(b.w - r.held) > 0.1::DOUBLE * abs(r.held) THEN b.w ELSE r.held END FROM rec r JOIN bi b ON b.ticker = r.ticker AND b.i = r.i + 1) SELECT ticker, day, w, held FROM rec")
def _(spark, sf):
    from tidemark.operators import book
    from tidemark.plans.q_book import bk

    return book.no_trade_band(bk(spark, sf), ["ticker"], "day", "w", 0.1).select("ticker", "day", "w", "held")


PAIR = RETURNS + """, q0 AS (SELECT ticker, day, r FROM rt WHERE r IS NOT NULL), q1 AS (SELECT b.ticker, b.day, a.r AS x, b.r AS y FROM q0 a JOIN q0 b ON a.day = b.day AND a.ticker = '1-URGENT' AND b.ticker > a.ticker),
q2 AS (SELECT *, product(1 + x) OVER w AS wx, product(1 + y) OVER w AS wy FROM q1 WINDOW w AS (PARTITION BY ticker ORDER BY day)),
q3 AS (SELECT *, wx / max(wx) OVER w - 1 AS dx, wy / max(wy) OVER w - 1 AS dy FROM q2 WINDOW w AS (PARTITION BY ticker ORDER BY day)),
q4 AS (SELECT ticker, (day + CAST((12 - isodow(day)) % 7 AS INT))::DATE AS week, sum(x) AS x, sum(y) AS y FROM q1 GROUP BY 1, 2)"""


@query("correlations", sql(PAIR, "SELECT d.ticker, d.c, d.n, d.drawdown, w.weekly FROM (SELECT ticker, round(corr(x, y), 6) + 0.0 AS c, count(*) AS n, round(corr(dx, dy), 6) + 0.0 AS drawdown FROM q3 GROUP BY 1) d JOIN (SELECT ticker, round(corr(x, y), 6) + 0.0 AS weekly FROM q4 GROUP BY 1) w ON w.ticker = d.ticker"))
def _(spark, sf):
    r = returns(spark, sf).where("r is not null").select("ticker", "day", "r")
    a = r.where("ticker = '1-URGENT'").select("day", F.col("r").alias("x"))
    j = r.where("ticker > '1-URGENT'").withColumnRenamed("r", "y").join(a, "day")
    both = stats.drawdowns(stats.drawdowns(j, ["ticker"], "day", "x").drop("wealth").withColumnRenamed("dd", "dx"), ["ticker"], "day", "y")
    daily = both.groupBy("ticker").agg(rnd(F.corr("x", "y")).alias("c"), F.count("*").alias("n"), rnd(F.corr("dx", "dd")).alias("drawdown"))
    week = j.groupBy("ticker", F.next_day(F.date_sub("day", 1), "Fri").alias("week")).agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    return daily.join(week.groupBy("ticker").agg(rnd(F.corr("x", "y")).alias("weekly")), "ticker")


@query("signal_correlations", sql(RETURNS, "SELECT ticker, CASE WHEN day < DATE '1998-01-01' THEN 'first' ELSE 'second' END AS period, round(corr(sg, r), 6) + 0.0 AS same, round(corr(sg, nx), 6) + 0.0 AS next, round(corr(sg, pv), 6) + 0.0 AS prev, round(corr(sg, p5), 6) + 0.0 AS past5, round(corr(sign(r), r), 6) + 0.0 AS sign_same FROM (SELECT *, CAST(n AS DOUBLE) AS sg, lead(r) OVER w AS nx, lag(r) OVER w AS pv, CASE WHEN count(r) OVER (PARTITION BY ticker ORDER BY day ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) = 5 THEN sum(r) OVER (PARTITION BY ticker ORDER BY day ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) END AS p5 FROM rt WINDOW w AS (PARTITION BY ticker ORDER BY day)) GROUP BY 1, 2"))
def _(spark, sf):
    w = Window.partitionBy("ticker").orderBy("day")
    five = w.rowsBetween(-4, 0)
    r = returns(spark, sf).withColumn("s", F.col("n").cast("double")).withColumn("nx", F.lead("r").over(w)).withColumn("pv", F.lag("r").over(w))
    r = r.withColumn("p5", F.when(F.count("r").over(five) == 5, F.sum("r").over(five))).withColumn("sg", F.signum("r"))
    r = r.withColumn("period", F.when(F.col("day") < F.lit("1998-01-01").cast("date"), "first").otherwise("second"))
    pair = lambda a, c: rnd(F.corr(F.when(F.col(c).isNotNull(), F.col(a)), c))
    return r.groupBy("ticker", "period").agg(
        pair("s", "r").alias("same"), pair("s", "nx").alias("next"), pair("s", "pv").alias("prev"), pair("s", "p5").alias("past5"), pair("sg", "r").alias("sign_same")
    )


# the month in which platform click gains most on view, and the event that moved most in the 35 days before its end
KEY = Z + """, km AS (SELECT last_day(day) AS me, sum(CASE WHEN platform = 'click' THEN z WHEN platform = 'view' THEN -z ELSE 0 END) AS g FROM zz WHERE z IS NOT NULL GROUP BY 1),
kb AS (SELECT me, g FROM km ORDER BY round(g, 9) DESC, me LIMIT 1),
ke AS (SELECT event_no, sum(z) AS s FROM zz, kb WHERE z > 0 AND day > me - 35 AND day <= me GROUP BY 1), kt AS (SELECT event_no FROM ke ORDER BY round(s, 9) DESC, event_no LIMIT 1)"""


@query("key_month", sql(KEY, "SELECT kb.me AS month, round(kb.g, 5) + 0.0 AS gain, kt.event_no, (SELECT string_agg(DISTINCT contract_id, ',' ORDER BY contract_id) FROM zz, kb k2, kt t2 WHERE zz.event_no = t2.event_no AND z > 0 AND day > k2.me - 35 AND day <= k2.me) AS contracts FROM kb, kt"))
def _(spark, sf):
    zz = z_rows(spark, sf).where("z is not null").select("platform", "event_no", "contract_id", "day", "z")
    gain = F.when(F.col("platform") == "click", F.col("z")).when(F.col("platform") == "view", -F.col("z")).otherwise(0.0)
    m = zz.groupBy(F.last_day("day").alias("month")).agg(F.sum(gain).alias("g"))
    best = m.orderBy(F.round("g", 9).desc(), "month").limit(1)
    up = zz.where("z > 0").join(F.broadcast(best), (F.col("day") > F.date_sub("month", 35)) & (F.col("day") <= F.col("month")))  # one row
    e = up.groupBy("month", "g", "event_no").agg(F.sum("z").alias("s"), F.array_join(F.array_sort(F.collect_set("contract_id")), ",").alias("contracts"))
    return e.orderBy(F.round("s", 9).desc(), "event_no").limit(1).select("month", rnd("g", 5).alias("gain"), "event_no", "contracts")


# -- labels ---------------------------------------------------------------------------------------

WORDS = {"red": "RD", "blue": "BL", "ring": "RG", "bolt": "BT", "small": "SM"}
SCORE = r"""sa AS (SELECT p_partkey AS id, CASE WHEN regexp_matches(p_name, 'bolt|ring') THEN 'fix' WHEN regexp_matches(p_name, 'widget') THEN 'part' ELSE 'other' END AS theme,
  CASE WHEN p_size > 30 THEN 1 WHEN p_size > 10 THEN -1 ELSE 0 END AS direction FROM part),
sw AS (SELECT DISTINCT p_partkey AS id, CASE w WHEN 'red' THEN 'RD' WHEN 'blue' THEN 'BL' WHEN 'ring' THEN 'RG' WHEN 'bolt' THEN 'BT' WHEN 'small' THEN 'SM' END AS z FROM (SELECT p_partkey, unnest(string_split(lower(p_name), ' ')) AS w FROM part)),
sz AS (SELECT id, coalesce(string_agg(z, '|' ORDER BY z), '') AS zones FROM sw GROUP BY 1),
st AS (SELECT sa.id, theme, direction, zones, CASE WHEN sa.id % 7 = 0 THEN 'other' ELSE theme END AS theme1, CASE WHEN sa.id % 5 = 0 THEN 'XX' ELSE zones END AS zones1, CASE WHEN sa.id % 11 = 0 THEN -direction WHEN sa.id % 13 = 0 THEN 0 ELSE direction END AS direction1 FROM sa JOIN sz ON sz.id = sa.id)"""


@query("accuracy_score", sql(SCORE, "SELECT theme1 AS label, count(*) AS n, round(avg((theme = theme1)::INT::DOUBLE), 6) AS theme, round(avg((zones = zones1)::INT::DOUBLE) FILTER (theme1 <> 'other'), 6) AS zone, round(avg((direction = direction1)::INT::DOUBLE) FILTER (theme1 <> 'other'), 6) AS direction, count(*) FILTER (theme1 <> 'other' AND direction * direction1 = -1) AS sign_errors FROM st GROUP BY ROLLUP (theme1)"))
def _(spark, sf):
    theme, _, _ = labels.first_match("p_name", [("1", "fix", "bolt|ring"), ("2", "part", "widget")])
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), "p_name", F.coalesce(theme, F.lit("other")).alias("theme"), F.when(F.col("p_size") > 30, 1).when(F.col("p_size") > 10, -1).otherwise(0).alias("direction"))
    zones = labels.places(table(spark, sf, "part"), "p_partkey", "p_name", spark.createDataFrame(list(WORDS.items()), "word string, place string"))
    p = p.join(zones.select(F.col("p_partkey").alias("id"), F.col("places").alias("zones")), "id")
    truth = p.select(
        "id", F.when(F.col("id") % 7 == 0, "other").otherwise(F.col("theme")).alias("true_theme"), F.when(F.col("id") % 5 == 0, F.array(F.lit("XX"))).otherwise(F.col("zones")).alias("true_zones"),
        F.when(F.col("id") % 11 == 0, -F.col("direction")).when(F.col("id") % 13 == 0, 0).otherwise(F.col("direction")).alias("true_direction"),
    )
    return labels.scores(p.join(truth, "id"), other="other")


@query("parse_decision_bp", r"SELECT page_id, CASE regexp_extract(url, '#([a-z]+)$', 1) WHEN 'top' THEN -25 WHEN 'end' THEN 25 ELSE CASE WHEN regexp_matches(url, 'page=[0-9]+.*ref') THEN 25 * CAST(regexp_extract(url, 'page=([0-9]+)', 1) AS INT) WHEN regexp_matches(url, 'page=[0-9]+') THEN -25 * CAST(regexp_extract(url, 'page=([0-9]+)', 1) AS INT) WHEN regexp_matches(url, 'utm_') THEN 0 END END::INT AS bp FROM pages")
def _(spark, sf):
    rules = [(r"page=([0-9]+).*ref", 25), (r"page=([0-9]+)", -25), ("utm_", 0)]
    bp = labels.decision_bp(F.col("url"), r"#([a-z]+)$", {"top": -25, "end": 25}, rules)
    return table(spark, sf, "pages").select("page_id", bp.cast("int").alias("bp"))


FAMILIES = """pf AS (SELECT p_partkey, p_brand, CASE WHEN p_size % 2 = 0 THEN p_size::DOUBLE END AS bp, floor(p_retailprice) AS lvl, CASE WHEN p_size > 25 THEN 1 ELSE -1 END AS direction FROM part),
pu AS (SELECT p_brand, 1 AS pri, 'bp' AS unit, bp AS v, p_partkey FROM pf WHERE bp IS NOT NULL UNION ALL SELECT p_brand, 2, 'level', lvl, p_partkey FROM pf WHERE lvl IS NOT NULL),
pg AS (SELECT p_brand, pri, unit FROM pu GROUP BY 1, 2, 3 HAVING count(*) >= 2 AND count(DISTINCT v) >= 2),
ph AS (SELECT p_brand, arg_min(unit, pri) AS unit, min(pri) AS pri FROM pg GROUP BY 1),
pw AS (SELECT p_brand, pri, quantile_cont(gap, 0.5) AS width FROM (SELECT p_brand, pri, lead(v) OVER (PARTITION BY p_brand, pri ORDER BY v) - v AS gap FROM (SELECT DISTINCT p_brand, pri, v FROM pu)) GROUP BY 1, 2)"""


@query("mark_partitions", sql(FAMILIES, "SELECT pf.p_partkey, x.v IS NOT NULL AS partition, CASE WHEN x.v IS NOT NULL THEN ph.unit END AS unit, x.v AS bucket, CASE WHEN x.v IS NOT NULL THEN 0 ELSE direction END AS direction FROM pf LEFT JOIN ph ON ph.p_brand = pf.p_brand LEFT JOIN LATERAL (SELECT CASE WHEN ph.pri = 1 AND bp IS NOT NULL THEN bp WHEN ph.pri = 1 THEN lvl + direction * pw.width / 2 WHEN ph.pri = 2 THEN lvl END AS v FROM (SELECT 1) LEFT JOIN pw ON pw.p_brand = ph.p_brand AND pw.pri = ph.pri) x ON true"))
def _(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_brand", F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("double")).alias("bp"), F.floor("p_retailprice").cast("double").alias("lvl"), F.when(F.col("p_size") > 25, 1).otherwise(-1).alias("direction"))
    out = labels.mark_families(p, "p_brand", [("bp", "bp", "lvl"), ("level", "lvl", None)], "direction")
    return out.select("p_partkey", "partition", "unit", "bucket", "direction")


def first_sql(col, pairs, default):
    return "CASE " + " ".join(f"WHEN regexp_matches({col}, '{p}') THEN '{n}'" for n, p in pairs) + f" ELSE '{default}' END"


THEMES = [("paging", "page="), ("tracked", "utm_|ref="), ("anchor", "#")]
ZONES = [("EN", "/en/"), ("DE", "/de/"), ("FR", "/fr/"), ("ES", "/es/")]
LABEL = f"""la AS (SELECT page_id, url, {first_sql('url', THEMES, 'none')} AS theme, {first_sql('url', ZONES, 'OTHER')} AS zone, CASE WHEN regexp_matches(url, '#top') THEN -1 WHEN regexp_matches(url, 'page=') THEN 1 ELSE 0 END::INT AS direction,
  CAST(nullif(regexp_extract(url, 'page=([0-9]+)', 1), '') AS DOUBLE) AS cnt, CAST(nullif(regexp_extract(url, '/([0-9]+)', 1), '') AS DOUBLE) AS level, regexp_extract(url, '//([^/]+)/', 1) AS event FROM pages),
lu AS (SELECT event, 1 AS pri, 'count' AS unit, cnt AS v FROM la WHERE cnt IS NOT NULL UNION ALL SELECT event, 2, 'level', level FROM la WHERE level IS NOT NULL),
lp AS (SELECT event, arg_min(unit, pri) AS unit, min(pri) AS pri FROM (SELECT event, pri, unit FROM lu GROUP BY 1, 2, 3 HAVING count(*) >= 2 AND count(DISTINCT v) >= 2) GROUP BY 1),
lb AS (SELECT la.*, CASE lp.pri WHEN 1 THEN cnt WHEN 2 THEN level END AS bucket, lp.unit AS u FROM la LEFT JOIN lp ON lp.event = la.event)"""


@query("label_table", sql(LABEL, "SELECT page_id, 'v1' AS version, theme, zone, CASE WHEN zone IN ('EN') THEN 'ISLES' WHEN zone IN ('DE', 'FR') THEN 'CORE' ELSE 'REST' END AS region, bucket IS NOT NULL AS partition, CASE WHEN bucket IS NOT NULL THEN u END AS unit, bucket, CASE WHEN bucket IS NOT NULL THEN 0 ELSE direction END AS direction, CASE WHEN bucket IS NOT NULL THEN 'partition-bucket' WHEN direction <> 0 THEN 'direction' ELSE 'none' END AS direction_rule FROM lb"))
def _(spark, sf):
    theme, _, _ = labels.first_match("url", [(n, n, p) for n, p in THEMES])
    zone, _, _ = labels.first_match("url", [(n, n, p) for n, p in ZONES])
    rows = table(spark, sf, "pages").select("page_id", "url").withColumns(
        {
            "theme": F.coalesce(theme, F.lit("none")), "zone": F.coalesce(zone, F.lit("OTHER")), "direction": labels.direction("url", "page=", "#top"),
            "cnt": labels.number_in("url", "page=([0-9]+)"), "level": labels.number_in("url", "/([0-9]+)"), "event": F.regexp_extract("url", "//([^/]+)/", 1),
        }
    )
    rows = rows.withColumn("region", labels.first_region(F.array("zone"), [("ISLES", ["EN"]), ("CORE", ["DE", "FR"])], "REST"))
    out = labels.mark_families(rows, "event", [("count", "cnt", None), ("level", "level", None)], "direction")
    rule = F.when(F.col("partition"), "partition-bucket").when(F.col("direction") != 0, "direction").otherwise("none")
    return out.select("page_id", F.lit("v1").alias("version"), "theme", "zone", "region", "partition", "unit", "bucket", "direction", rule.alias("direction_rule"))


# -- eligibility, weekend and hourly indices ------------------------------------------------------


@query("eligible_flag", sql(DAYS, """, eb AS (SELECT event_no, platform, day, count(px) AS n_buckets, sum(px) AS px_sum FROM cd WHERE partition GROUP BY 1, 2, 3)
SELECT contract_id, CAST(cd.day AS DATE) AS day, CASE WHEN cd.partition THEN coalesce(px IS NOT NULL AND vol7d >= 20 AND ttr_days BETWEEN 3 AND 365 AND n_buckets >= 2 AND px_sum BETWEEN 0.5 AND 1.5, false) ELSE eligible END AS eligible FROM cd LEFT JOIN eb ON cd.partition AND eb.event_no = cd.event_no AND eb.platform = cd.platform AND eb.day = cd.day""").replace(")\n, eb", "), eb"))
def _(spark, sf):
    d = grid.with_buckets(days(spark, sf), ["platform", "event_no"])
    return d.select("contract_id", "day", F.when(F.col("partition"), grid.eligible_partition(20.0)).otherwise(F.col("eligible")).alias("eligible"))


@query("coverage_top_pivot", sql(DAYS, ", c AS (SELECT zone || '/' || theme AS cell, date_trunc('month', day)::DATE AS month, count(DISTINCT day) AS n FROM cd WHERE eligible GROUP BY 1, 2), t AS (SELECT cell FROM c GROUP BY 1 ORDER BY sum(n) DESC, cell LIMIT 30) SELECT t.cell, m.month, coalesce(n, 0) AS n_days FROM t CROSS JOIN (SELECT DISTINCT month FROM c) m LEFT JOIN c ON c.cell = t.cell AND c.month = m.month").replace(")\n, c", "), c"))
def _(spark, sf):
    """The 30 cells with most days and every month of the data, 0 where there is none."""
    month = F.trunc("day", "month").alias("month")
    c = days(spark, sf).where("eligible").groupBy(F.concat_ws("/", "zone", "theme").alias("cell"), month).agg(F.count_distinct("day").alias("n"))
    c = files.written(c, "cells")
    top = F.broadcast(c.groupBy("cell").agg(F.sum("n").alias("all")).orderBy(F.desc("all"), "cell").limit(30).select("cell"))
    grid_ = top.crossJoin(c.select("month").distinct())  # 30 cells and a row a month
    return grid_.join(c, ["cell", "month"], "left").select("cell", "month", F.coalesce("n", F.lit(0)).alias("n_days"))


WEEKEND = Z + """,
wk AS (SELECT zz.contract_id, zz.platform, zz.platform_id, CAST(zz.day AS DATE) AS friday, px AS px_fri, is_deadline, sign, sd, ttr_days, CAST(zz.day AS TIMESTAMP) + INTERVAL 21 HOUR AS t1, CAST(zz.day AS TIMESTAMP) + INTERVAL 69 HOUR AS t2 FROM zz WHERE eligible AND isodow(zz.day) = 5),
wa AS (SELECT wk.*, arg_max(tr.px, (tr.ts, tr.event_id)) FILTER (tr.ts < t1) AS pa, max(tr.ts) FILTER (tr.ts < t1) AS ta, arg_max(tr.px, (tr.ts, tr.event_id)) FILTER (tr.ts < t2) AS pb, max(tr.ts) FILTER (tr.ts < t2) AS tb FROM wk LEFT JOIN tr ON tr.platform = wk.platform AND tr.platform_id = wk.platform_id GROUP BY ALL),
wb AS (SELECT *, CASE WHEN ta >= t1 - INTERVAL 1 DAY THEN pa ELSE px_fri END AS p1, CASE WHEN tb >= t1 THEN pb END AS pw FROM wa),
wc AS (SELECT *, CASE WHEN is_deadline THEN -ln(1 - greatest(0.001::DOUBLE, least(0.999::DOUBLE, p1))) / (greatest(ttr_days, 3.0::DOUBLE) / 365.25::DOUBLE) ELSE p1 END AS v1,
  CASE WHEN is_deadline THEN -ln(1 - greatest(0.001::DOUBLE, least(0.999::DOUBLE, coalesce(pw, p1)))) / (greatest(ttr_days - 2, 3.0::DOUBLE) / 365.25::DOUBLE) ELSE coalesce(pw, p1) END AS v2 FROM wb)"""


@query("weekend_change", sql(WEEKEND, "SELECT contract_id, friday, round(v2 - v1, 6) + 0.0 AS change, round(CASE WHEN sd > 0 THEN greatest(-5.0::DOUBLE, least(5.0::DOUBLE, sign * (v2 - v1) / sd)) END, 4) + 0.0 AS z, pw IS NOT NULL AS moved FROM wc"))
def _(spark, sf):
    f = z_rows(spark, sf).where(F.col("eligible") & (F.weekday("day") == 4)).select(
        "contract_id", "platform", "platform_id", F.col("day").alias("friday"), F.col("px").alias("px_fri"), "is_deadline", "sign", "sd", "ttr_days",
        (F.col("day").cast("timestamp") + F.expr("INTERVAL 21 HOUR")).alias("t1"), (F.col("day").cast("timestamp") + F.expr("INTERVAL 69 HOUR")).alias("t2"),
    )
    t = trades(spark, sf).groupBy("platform", "platform_id", "ts").agg(F.max_by("px", "event_id").alias("p"))
    key = ["platform", "platform_id"]
    a = asof.asof_join(f, t, key, "t1", "ts", ["p"], "lt").withColumnsRenamed({"p": "pa", "ts_found": "ta"})
    b = asof.asof_join(a, t, key, "t2", "ts", ["p"], "lt").withColumnsRenamed({"p": "pb", "ts_found": "tb"})
    b = b.withColumn("p1", F.when(F.col("ta") >= F.col("t1") - F.expr("INTERVAL 1 DAY"), F.col("pa")).otherwise(F.col("px_fri")))
    b = b.withColumn("pw", F.when(F.col("tb") >= F.col("t1"), F.col("pb"))).withColumn("p2", F.coalesce("pw", "p1"))
    years = lambda d: F.greatest(F.col("ttr_days") - d, F.lit(3.0)) / 365.25
    value = lambda p, d: F.when(F.col("is_deadline"), hazard(p, years(d))).otherwise(F.col(p))
    b = b.withColumn("dv", value("p2", 2) - value("p1", 0))
    z = F.when(F.col("sd") > 0, clip(F.col("sign") * F.col("dv") / F.col("sd"), -5, 5))
    return b.select("contract_id", "friday", rnd("dv").alias("change"), rnd(z, 4).alias("z"), F.col("pw").isNotNull().alias("moved"))


HOURLY = Z + """,
hl AS (SELECT platform, platform_id, date_trunc('hour', ts) + INTERVAL 1 HOUR AS h, arg_max(px, (ts, event_id)) AS p FROM tr GROUP BY 1, 2, 3),
hd AS (SELECT *, lag(p) OVER (PARTITION BY platform, platform_id, CAST(h AS DATE) ORDER BY h) AS p0 FROM hl),
hz AS (SELECT zz.zone, zz.theme, zz.contract_id, hd.h, zz.vol7d, zz.sd, zz.sign, CASE WHEN is_deadline THEN (-ln(1 - greatest(0.001::DOUBLE, least(0.999::DOUBLE, p))) + ln(1 - greatest(0.001::DOUBLE, least(0.999::DOUBLE, p0)))) / (greatest(ttr_days, 3.0::DOUBLE) / 365.25::DOUBLE) ELSE p - p0 END AS d
  FROM hd JOIN zz ON zz.platform = hd.platform AND zz.platform_id = hd.platform_id AND zz.day = CAST(hd.h AS DATE) WHERE p0 IS NOT NULL AND eligible),
hy AS (SELECT *, CASE WHEN sd > 0 THEN greatest(-5.0::DOUBLE, least(5.0::DOUBLE, sign * d / (sd / sqrt(24)))) END AS z FROM hz)"""


@query("hourly_index", sql(HOURLY, "SELECT zone, theme, h, round(sum(z * vol7d) / nullif(sum(vol7d), 0), 4) + 0.0 AS d, count(DISTINCT contract_id) AS n_contracts FROM hy WHERE z IS NOT NULL GROUP BY 1, 2, 3"))
def _(spark, sf):
    from tidemark.operators.tape import hourly_last

    h = hourly_last(trades(spark, sf)).select("platform", "platform_id", F.col("hour_end").alias("h"), F.col("px").alias("p"))
    w = Window.partitionBy("platform", "platform_id", F.to_date("h")).orderBy("h")
    h = h.withColumn("p0", F.lag("p").over(w)).where("p0 is not null").withColumn("day", F.to_date("h"))
    c = z_rows(spark, sf).where("eligible").select("platform", "platform_id", "day", "zone", "theme", "contract_id", "vol7d", "sd", "sign", "is_deadline", "ttr_days")
    x = h.join(c, ["platform", "platform_id", "day"])
    years = F.greatest(F.col("ttr_days"), F.lit(3.0)) / 365.25
    d = F.when(F.col("is_deadline"), hazard("p", years) - hazard("p0", years)).otherwise(F.col("p") - F.col("p0"))
    x = x.withColumn("z", F.when(F.col("sd") > 0, clip(F.col("sign") * d / (F.col("sd") / F.sqrt(F.lit(24.0))), -5, 5))).where("z is not null")
    total = F.sum("vol7d")
    return x.groupBy("zone", "theme", "h").agg(rnd(F.sum(F.col("z") * F.col("vol7d")) / F.when(total != 0, total), 4).alias("d"), F.count_distinct("contract_id").alias("n_contracts"))


# -- files ----------------------------------------------------------------------------------------


@query("scan_tape", sql(RAW, "SELECT event_id, platform AS venue, CAST(ts AS DATE) AS date, platform_id, ts FROM raw WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-13'"))
def _(spark, sf):
    root = scratch(spark)
    t = raw_tape(spark, sf).select("event_id", F.col("platform").alias("venue"), "platform_id", "ts", F.to_date("ts").alias("date"))
    files.write_tape(t, root)
    return files.read_tape(spark, root, "2024-01-05", "2024-01-12").select("event_id", "venue", "date", "platform_id", "ts")


@query("scan_mixed_long", "SELECT CAST(l_shipdate AS DATE) AS date, lower(l_returnflag) AS ticker, 'last' AS field, round(avg(l_extendedprice), 7) + 0.0 AS value FROM lineitem GROUP BY 1, 2 UNION ALL SELECT CAST(o_orderdate AS DATE), lower(o_orderpriority), 'last', round(avg(o_totalprice), 7) + 0.0 FROM orders GROUP BY 1, 2")
def _(spark, sf):
    root = scratch(spark)

    def long(t, d, k, v):
        g = table(spark, sf, t).groupBy(F.to_date(d).alias("Date"), F.lower(k).alias("Ticker")).agg(rnd(F.avg(v), 7).alias("Value"))
        return g.select("Date", "Ticker", F.lit("last").alias("FIELD"), "Value")

    long("lineitem", "l_shipdate", "l_returnflag", "l_extendedprice").write.option("header", True).csv(f"{root}/csv")
    long("orders", "o_orderdate", "o_orderpriority", "o_totalprice").write.parquet(f"{root}/parquet")
    return files.read_long(spark, f"{root}/csv", f"{root}/parquet")


@query("scan_json_dict", "SELECT CAST(n_nationkey AS VARCHAR) AS key, n_name AS name, n_regionkey AS region FROM nation")
def _(spark, sf):
    path = scratch(spark)
    one = F.struct(F.col("n_nationkey").cast("string"), F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")))
    text = F.to_json(F.map_from_entries(F.collect_list(one)))
    table(spark, sf, "nation").agg(text.alias("value")).write.text(path)  # one lookup file, as the reader expects
    return files.read_json_dict(spark, path, "name string, region long")


@query("candle_normalise", sql(RAW, ", c AS (SELECT platform, date_trunc('hour', ts) AS h, 1000 * min(price) AS b, 1000 * max(price) AS a, sum(size) AS v FROM raw GROUP BY 1, 2), s AS (SELECT platform, pow(10, round(log10(median(a) / 0.5))) AS f FROM c GROUP BY 1) SELECT c.platform, h + INTERVAL 1 HOUR AS hour_end, round(CASE WHEN c.platform IN ('click', 'view') THEN f / a ELSE b / f END, 6) + 0.0 AS bid, round(CASE WHEN c.platform IN ('click', 'view') THEN f / b ELSE a / f END, 6) + 0.0 AS ask, round(CASE WHEN c.platform IN ('click', 'view') THEN (f / a + f / b) / 2 ELSE (a / f + b / f) / 2 END, 6) + 0.0 AS mid FROM c JOIN s ON s.platform = c.platform WHERE v > 0").replace(")\n, c", "), c"))
def _(spark, sf):
    from tidemark.operators.tape import normalise_candles

    c = raw_tape(spark, sf).groupBy("platform", F.date_trunc("hour", "ts").alias("h")).agg((1000 * F.min("price")).alias("bid"), (1000 * F.max("price")).alias("ask"), F.sum("size").alias("volume"))
    out = normalise_candles(c, "platform", "h", 0.5, F.col("platform").isin("click", "view"))
    return out.select("platform", "hour_end", rnd("bid").alias("bid"), rnd("ask").alias("ask"), rnd("mid").alias("mid"))
