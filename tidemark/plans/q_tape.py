"""Queries over the tape: scans, projections, flags, market-day panel, dense grid."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.common import clip, hash_int, hash_key, rnd
from tidemark.operators import bitmaps, grid, tape
from tidemark.operators.asof import asof_join
from tidemark.plans.base import (
    CUTOFF, DAYS, MARKET, MARKETS, PANEL, RAW, TRADES, days, market_long, markets, panel, raw_tape, sql, table, trades,
)
from tidemark.plans.registry import query
from tidemark.sources import files

PANEL_OUT = """platform, platform_id, CAST(snap_date AS DATE) AS snap_date, round(px_last, 6) + 0.0 AS px_last, round(px_vwap_1h, 6) + 0.0 AS px_vwap_1h,
  last_ts, round(px_early, 6) + 0.0 AS px_early, early_ts, round(volume_usd, 4) + 0.0 AS volume_usd, round(volume_late_usd, 4) + 0.0 AS volume_late_usd, n_trades"""


def panel_out(p):
    return p.select(
        "platform", "platform_id", "snap_date", rnd("px_last").alias("px_last"), rnd("px_vwap_1h").alias("px_vwap_1h"), "last_ts",
        rnd("px_early").alias("px_early"), "early_ts", rnd("volume_usd", 4).alias("volume_usd"),
        rnd("volume_late_usd", 4).alias("volume_late_usd"), "n_trades",
    )


@query("market_day_panel", sql(PANEL, f"SELECT {PANEL_OUT} FROM pn"))
def _(spark, sf):
    return panel_out(panel(spark, sf))


@query("union_cutoff", sql(RAW, f"SELECT CAST(ts AS DATE) AS day, count(*) AS n, count(DISTINCT event_id) AS n_ids FROM (SELECT * FROM raw WHERE ts < TIMESTAMP '{CUTOFF}' UNION ALL SELECT * FROM raw WHERE ts >= TIMESTAMP '{CUTOFF}') GROUP BY 1"))
def _(spark, sf):
    both = tape.archive_and_live(raw_tape(spark, sf), raw_tape(spark, sf), CUTOFF)
    return both.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("n_ids"))


@query("scan_columns", "SELECT o_custkey, o_totalprice FROM orders")
def _(spark, sf):
    return table(spark, sf, "orders").select("o_custkey", "o_totalprice")


@query("pick_series", sql(MARKET, "SELECT day, value FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY n DESC, value DESC) AS k FROM ml WHERE field = 'last' AND ticker < '3') WHERE k = 1"))
def _(spark, sf):
    w = Window.partitionBy("day").orderBy(F.desc("n"), F.desc("value"))
    return market_long(spark, sf).where("field = 'last' and ticker < '3'").withColumn("k", F.row_number().over(w)).where("k = 1").select("day", "value")


@query("business_days", sql(MARKET, "SELECT CAST(d AS DATE) AS day FROM (SELECT unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS d FROM ml) WHERE isodow(d) < 6"))
def _(spark, sf):
    span = market_long(spark, sf).agg(F.min("day").alias("a"), F.max("day").alias("b"))
    return grid.dense_days(span, "a", "b").where(F.weekday("day") < 5).select("day")


@query("calendar_days", sql(PANEL, "SELECT CAST(unnest(generate_series(min(snap_date), max(snap_date), INTERVAL 1 DAY)) AS DATE) AS day FROM pn"))
def _(spark, sf):
    span = panel(spark, sf).agg(F.min("snap_date").alias("a"), F.max("snap_date").alias("b"))
    return grid.dense_days(span, "a", "b").select("day")


@query("yes_price", sql(TRADES, "SELECT event_id, round(px, 6) + 0.0 AS px FROM tr"))
def _(spark, sf):
    return trades(spark, sf).select("event_id", rnd("px").alias("px"))


@query("abs_notional", sql(TRADES, "SELECT platform, round(sum(usd), 4) + 0.0 AS usd FROM tr GROUP BY platform"))
def _(spark, sf):
    return trades(spark, sf).groupBy("platform").agg(rnd(F.sum("usd"), 4).alias("usd"))


@query("snapshot_date", sql(TRADES, "SELECT event_id, CAST(snap_date AS DATE) AS snap_date FROM tr"))
def _(spark, sf):
    return trades(spark, sf).select("event_id", "snap_date")


@query("last_hour_flag", sql(TRADES, "SELECT event_id, late FROM tr"))
def _(spark, sf):
    return trades(spark, sf).select("event_id", "late")


@query("early_flag", sql(TRADES, "SELECT event_id, early FROM tr"))
def _(spark, sf):
    return trades(spark, sf).select("event_id", "early")


@query("alive_filter", sql(MARKETS, "SELECT contract_id FROM mk WHERE created <= DATE '2024-01-20' AND coalesce(closes, DATE '2100-01-01') >= DATE '2024-01-31' AND NOT starts_with(contract_id, 'error')"))
def _(spark, sf):
    m = markets(spark, sf)
    alive = (F.col("created") <= F.lit("2024-01-20").cast("date")) & (F.coalesce("closes", F.lit("2100-01-01").cast("date")) >= F.lit("2024-01-31").cast("date"))
    return m.where(alive & ~F.col("contract_id").startswith("error")).select("contract_id")


@query("vocab_prefilter", r"SELECT page_id FROM pages WHERE regexp_matches(url, '(?i)(page|ref|/en/)') AND NOT regexp_matches(url, '(?i)(example\.org|#top)')")
def _(spark, sf):
    u = F.col("url")
    return table(spark, sf, "pages").where(u.rlike(r"(?i)(page|ref|/en/)") & ~u.rlike(r"(?i)(example\.org|#top)")).select("page_id")


@query("stale_flag", sql(DAYS, "SELECT contract_id, CAST(day AS DATE) AS day, stale FROM cd"))
def _(spark, sf):
    return days(spark, sf).select("contract_id", "day", "stale")


@query("hazard_rate", sql(DAYS, "SELECT contract_id, CAST(day AS DATE) AS day, round(value, 6) + 0.0 AS value FROM cd WHERE is_deadline AND px IS NOT NULL"))
def _(spark, sf):
    return days(spark, sf).where("is_deadline and px is not null").select("contract_id", "day", rnd("value").alias("value"))


@query("deadline_flag", r"SELECT page_id, regexp_matches(url, '(?i)\b(by|before|page=\d+)\b') AS is_deadline FROM pages")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.col("url").rlike(r"(?i)\b(by|before|page=\d+)\b").alias("is_deadline"))


@query("winsorise", "SELECT l_orderkey, l_linenumber, greatest(10.0, least(40.0, l_quantity)) + 0.0 AS q FROM lineitem")
def _(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", clip("l_quantity", 10, 40).alias("q"))


@query("weekday_filter", sql(TRADES, "SELECT CAST(isodow(ts) - 1 AS INT) AS wd, count(*) AS n FROM tr WHERE isodow(ts) IN (5, 6, 7, 1) GROUP BY 1"))
def _(spark, sf):
    return trades(spark, sf).groupBy(F.weekday("ts").alias("wd")).agg(F.count("*").alias("n")).where("wd in (4, 5, 6, 0)")


@query("period_split", sql(MARKET, """, p AS (SELECT * FROM (VALUES ('in', DATE '1995-01-01', DATE '1998-12-31'), ('out', DATE '1999-01-01', DATE '2002-12-31'), ('full', DATE '1995-01-01', DATE '2002-12-31')) t(period, a, b))
SELECT period, ticker, count(*) AS n FROM ml JOIN p ON day BETWEEN a AND b GROUP BY ALL""").replace(")\n, p AS", "), p AS"))
def _(spark, sf):
    p = spark.createDataFrame([("in", "1995-01-01", "1998-12-31"), ("out", "1999-01-01", "2002-12-31"), ("full", "1995-01-01", "2002-12-31")], "period string, a string, b string")
    return market_long(spark, sf).join(F.broadcast(p), F.expr("day between date(a) and date(b)")).groupBy("period", "ticker").agg(F.count("*").alias("n"))


@query("invert_log", sql(MARKET, "SELECT day, ticker, round(ln(CASE WHEN ticker < '3' THEN 1 / value ELSE value END), 6) + 0.0 AS s FROM ml"))
def _(spark, sf):
    v = F.when(F.col("ticker") < "3", 1 / F.col("value")).otherwise(F.col("value"))
    return market_long(spark, sf).select("day", "ticker", rnd(F.log(v)).alias("s"))


@query("valid_from", sql(MARKET, "SELECT ticker, count(*) AS n, min(day) AS first_day FROM ml WHERE day >= CASE WHEN ticker < '3' THEN DATE '1997-01-01' ELSE DATE '1995-06-01' END GROUP BY ticker"))
def _(spark, sf):
    start = F.when(F.col("ticker") < "3", F.lit("1997-01-01")).otherwise(F.lit("1995-06-01")).cast("date")
    return market_long(spark, sf).where(F.col("day") >= start).groupBy("ticker").agg(F.count("*").alias("n"), F.min("day").alias("first_day"))


QUOTES = "q AS (SELECT CAST(l_shipdate AS DATE) AS day, l_returnflag AS ccy, avg(l_extendedprice) AS mid, avg(l_discount) / 100 AS d, avg(l_tax) AS i FROM lineitem GROUP BY 1, 2)"


def quotes(spark, sf):
    return table(spark, sf, "lineitem").groupBy(F.to_date("l_shipdate").alias("day"), F.col("l_returnflag").alias("ccy")).agg(
        F.avg("l_extendedprice").alias("mid"), (F.avg("l_discount") / 100).alias("d"), F.avg("l_tax").alias("i")
    )


@query("fwd_from_points", sql(QUOTES, "SELECT day, ccy, round(CASE WHEN ccy = 'A' THEN mid + d * 10000 / 100 ELSE (mid * (1 - d) + mid * (1 + d)) / 2 END, 6) + 0.0 AS fwd FROM q"))
def _(spark, sf):
    f = F.coalesce(F.when(F.col("ccy") == "A", F.expr("mid + d * 10000 / 100")), F.expr("(mid * (1 - d) + mid * (1 + d)) / 2"))
    return quotes(spark, sf).select("day", "ccy", rnd(f, 6).alias("fwd"))


# a month's rate is known from the first day of the second month after it on
RATES = QUOTES + """, mr AS (SELECT ccy, date_trunc('month', day)::DATE + INTERVAL 2 MONTH AS known, avg(i) AS i FROM q GROUP BY 1, 2),
fr AS (SELECT q.day, q.ccy, q.mid, arg_max(mr.i, mr.known) AS i FROM q JOIN mr ON mr.ccy = q.ccy AND mr.known <= q.day GROUP BY 1, 2, 3)"""


@query("cip_forward", sql(RATES, "SELECT q.day, q.ccy, round(q.mid * exp(-(q.i - u.i) / 12), 4) + 0.0 AS fwd FROM fr q JOIN fr u ON u.day = q.day AND u.ccy = 'N' WHERE q.ccy <> 'N'"))
def _(spark, sf):
    q = quotes(spark, sf)
    known = F.add_months(F.trunc("day", "month"), 2).alias("known")
    rates = q.groupBy("ccy", known).agg(F.avg("i").alias("i"))
    r = asof_join(q.select("day", "ccy", "mid"), rates, ["ccy"], "day", "known", ["i"], "le").where("i is not null")
    us = r.where("ccy = 'N'").select("day", F.col("i").alias("i_us"))
    return r.where("ccy <> 'N'").join(us, "day").select("day", "ccy", rnd(F.expr("mid * exp(-(i - i_us) / 12)"), 4).alias("fwd"))


@query("half_spread", sql(QUOTES, "SELECT day, ccy, round(coalesce(abs((mid * (1 + d) - mid * (1 - d)) / nullif(2 * mid, 0)), 0.0002), 8) + 0.0 AS half_spread FROM q"))
def _(spark, sf):
    h = F.coalesce(F.abs(F.expr("(mid * (1 + d) - mid * (1 - d)) / nullif(2 * mid, 0)")), F.lit(0.0002))
    return quotes(spark, sf).select("day", "ccy", rnd(h, 8).alias("half_spread"))


@query("cross_rate", sql(QUOTES, "SELECT a.day, round(a.mid / b.mid, 6) + 0.0 AS rate FROM q a JOIN q b ON a.day = b.day AND a.ccy = 'A' AND b.ccy = 'R'"))
def _(spark, sf):
    q = quotes(spark, sf).select("day", "ccy", "mid")
    return q.where("ccy = 'A'").join(q.where("ccy = 'R'").select("day", F.col("mid").alias("b")), "day").select("day", rnd(F.col("mid") / F.col("b")).alias("rate"))


@query("melt_long", sql(QUOTES, "SELECT day, ccy, field, round(value, 6) + 0.0 AS value FROM (SELECT day, ccy, unnest(['mid', 'd', 'i']) AS field, unnest([mid, d, i]) AS value FROM q) WHERE value IS NOT NULL"))
def _(spark, sf):
    return quotes(spark, sf).unpivot(["day", "ccy"], ["mid", "d", "i"], "field", "value").dropna().withColumn("value", rnd("value"))


@query("contract_key", sql(MARKETS, "SELECT platform, platform_id, CASE WHEN partition THEN platform || ':event:' || event_no ELSE contract_id END AS key FROM mk"))
def _(spark, sf):
    k = F.when(F.col("partition"), F.concat_ws(":", "platform", F.lit("event"), "event_no")).otherwise(F.col("contract_id"))
    return markets(spark, sf).select("platform", "platform_id", k.alias("key"))


@query("placebo_pick", sql(MARKETS, "SELECT contract_id, CASE WHEN CAST('0x' || substr(md5('s7|' || contract_id), 1, 8) AS BIGINT) % 2 = 0 THEN 1 ELSE -1 END AS sign FROM mk WHERE theme = 2 ORDER BY md5('p7|' || contract_id) LIMIT 20"))
def _(spark, sf):
    sign = F.when(hash_int("s7", "contract_id") % 2 == 0, 1).otherwise(-1)
    return markets(spark, sf).where("theme = 2").orderBy(hash_key("p7", "contract_id")).limit(20).select("contract_id", sign.alias("sign"))


@query("universe_screen", "SELECT n_name AS ticker FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_regionkey % 2 = 0)")
def _(spark, sf):
    ok = table(spark, sf, "region").where("r_regionkey % 2 = 0").select(F.col("r_regionkey").alias("n_regionkey"))
    return table(spark, sf, "nation").join(ok, "n_regionkey", "left_semi").select(F.col("n_name").alias("ticker"))


@query("event_exclude", sql(MARKETS, "SELECT contract_id FROM mk WHERE event_no NOT IN (SELECT event_no FROM mk GROUP BY event_no ORDER BY count(*) DESC, event_no LIMIT 3)"))
def _(spark, sf):
    m = markets(spark, sf)
    top = m.groupBy("event_no").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "event_no").limit(3).select("event_no")
    return m.join(top, "event_no", "left_anti").select("contract_id")


@query("mask_values", sql(DAYS, "SELECT contract_id, CAST(day AS DATE) AS day, CASE WHEN eligible THEN round(value, 6) + 0.0 END AS value, CASE WHEN eligible THEN round(vol7d, 4) + 0.0 END AS vol7d FROM cd"))
def _(spark, sf):
    return days(spark, sf).select("contract_id", "day", *[F.when(F.col("eligible"), rnd(c, k)).alias(c) for c, k in (("value", 6), ("vol7d", 4))])


@query("exec_lag", sql(MARKET, "SELECT ticker, day, CASE WHEN ticker < '3' THEN lag(value, 1) OVER w ELSE value END AS value FROM ml WINDOW w AS (PARTITION BY ticker ORDER BY day)"))
def _(spark, sf):
    w = Window.partitionBy("ticker").orderBy("day")
    v = F.when(F.col("ticker") < "3", F.lag("value").over(w)).otherwise(F.col("value"))
    return market_long(spark, sf).select("ticker", "day", v.alias("value"))


@query("variant_cells", sql(MARKETS, "SELECT zone, theme FROM (SELECT DISTINCT zone, theme FROM mk WHERE zone <> 'error' EXCEPT SELECT DISTINCT zone, theme FROM mk WHERE theme = 4) UNION SELECT 'error' AS zone, 0 AS theme"))
def _(spark, sf):
    cells = markets(spark, sf).select("zone", "theme").distinct()
    spill = cells.where("zone = 'error' and theme = 0")
    return cells.where("zone <> 'error'").join(cells.where("theme = 4"), ["zone", "theme"], "left_anti").unionByName(spill).distinct()


@query("contract_days", sql(DAYS, "SELECT contract_id, CAST(day AS DATE) AS day, round(px, 6) + 0.0 AS px, round(vol1d, 4) + 0.0 AS vol1d, round(vol7d, 4) + 0.0 AS vol7d, ttr_days FROM cd"))
def _(spark, sf):
    return days(spark, sf).select("contract_id", "day", rnd("px").alias("px"), rnd("vol1d", 4).alias("vol1d"), rnd("vol7d", 4).alias("vol7d"), "ttr_days")


# -- aggregations over the tape and the grid ------------------------------------------------------


@query("last_price", sql(PANEL, "SELECT platform, platform_id, CAST(snap_date AS DATE) AS snap_date, round(px_last, 6) + 0.0 AS px_last FROM pn"))
def _(spark, sf):
    t = trades(spark, sf)
    return t.groupBy("platform", "platform_id", "snap_date").agg(rnd(tape.last_by("px", "ts", "event_id")).alias("px_last"))


@query("last_price_filtered", sql(PANEL, "SELECT platform, platform_id, CAST(snap_date AS DATE) AS snap_date, round(px_early, 6) + 0.0 AS px_early, early_ts FROM pn"))
def _(spark, sf):
    return trades(spark, sf).groupBy("platform", "platform_id", "snap_date").agg(
        rnd(tape.last_by("px", "ts", "event_id", where=F.col("early"))).alias("px_early"), F.max(F.when(F.col("early"), F.col("ts"))).alias("early_ts")
    )


@query("vwap_filtered", sql(TRADES, "SELECT platform, CAST(snap_date AS DATE) AS snap_date, round(sum(px * usd) FILTER (late) / nullif(sum(usd) FILTER (late), 0), 6) + 0.0 AS vwap FROM tr GROUP BY 1, 2"))
def _(spark, sf):
    return trades(spark, sf).groupBy("platform", "snap_date").agg(rnd(tape.vwap("px", "usd", F.col("late"))).alias("vwap"))


@query("hourly_last", sql(TRADES, "SELECT platform, platform_id, date_trunc('hour', ts) + INTERVAL 1 HOUR AS hour_end, round(arg_max(px, (ts, event_id)), 6) + 0.0 AS px FROM tr GROUP BY ALL"))
def _(spark, sf):
    return tape.hourly_last(trades(spark, sf)).select("platform", "platform_id", "hour_end", rnd("px").alias("px"))


@query("partition_ev", sql(DAYS, "SELECT event_no AS event_key, CAST(day AS DATE) AS day, round(sum(px * bucket_value) / nullif(sum(px), 0), 6) + 0.0 AS value, count(px) AS n_buckets, max(last_ts) AS last_ts, round(sum(vol1d), 4) + 0.0 AS vol1d FROM cd GROUP BY 1, 2"))
def _(spark, sf):
    rows = days(spark, sf).withColumn("event_key", F.col("event_no"))
    return grid.partition_ev(rows).select("event_key", "day", rnd("value").alias("value"), "n_buckets", "last_ts", rnd("vol1d", 4).alias("vol1d"))


@query("any_max_bool", sql(DAYS, "SELECT event_no, min(theme) AS theme, max(closes) AS closes, bool_or(eligible) AS ever FROM cd GROUP BY 1"))
def _(spark, sf):
    return days(spark, sf).groupBy("event_no").agg(F.min("theme").alias("theme"), F.max("closes").alias("closes"), F.bool_or("eligible").alias("ever"))


@query("coverage_quarter", sql(DAYS, "SELECT zone, theme, date_trunc('quarter', day)::DATE AS quarter, count(DISTINCT contract_id) AS n_contracts, count(DISTINCT event_no) AS n_events, count(DISTINCT day) AS n_days, round(sum(vol1d), 4) + 0.0 AS volume FROM cd WHERE eligible AND isodow(day) < 6 GROUP BY ALL"))
def _(spark, sf):
    m = bitmaps.with_code(markets(spark, sf), ["event_no"], "event_code")
    m = bitmaps.with_code(m, ["contract_id"], "contract_code", near=["event_no"])
    d = days(spark, sf, m).where(F.col("eligible") & (F.weekday("day") < 5)).withColumn("month", F.trunc("day", "month"))
    codes = {"n_contracts": F.col("contract_code"), "n_events": F.col("event_code"), "n_days": day_code("day")}
    months = files.written(bitmaps.bitmaps(d, ["zone", "theme", "month"], codes, {"volume": F.col("vol1d")}), "month-bitmaps")
    quarter = F.to_date(F.date_trunc("quarter", "month"))
    quarters = bitmaps.merged(months.withColumn("quarter", quarter), ["zone", "theme", "quarter"], list(codes), ["volume"])
    out = bitmaps.counted(quarters, ["zone", "theme", "quarter"], list(codes), ["volume"])
    return out.withColumn("volume", rnd("volume", 4))


def day_code(day):
    """Days since the first year, from 1."""
    return F.unix_date(day) + 719163


COVER = "SELECT zone, theme, count(DISTINCT day) FILTER (day < DATE '2024-01-16') AS n_train, count(DISTINCT day) FILTER (day >= DATE '2024-01-16') AS n_test FROM cd WHERE eligible GROUP BY 1, 2"


def cover(spark, sf):
    first = F.col("day") < F.lit("2024-01-16").cast("date")
    codes = {"n_train": F.when(first, day_code("day")), "n_test": F.when(~first, day_code("day"))}
    parts = files.written(bitmaps.bitmaps(days(spark, sf).where("eligible"), ["zone", "theme"], codes), "cell-bitmaps")
    return bitmaps.counted(parts, ["zone", "theme"], list(codes))


@query("coverage_cells", sql(DAYS, f"SELECT *, round(n_train / 15.0::DOUBLE, 6) AS share, n_train / 15.0::DOUBLE >= 0.60 AS keep FROM ({COVER})"))
def _(spark, sf):
    return cover(spark, sf).withColumn("share", F.round(F.col("n_train") / 15.0, 6)).withColumn("keep", F.col("n_train") / 15.0 >= 0.60)


@query("platform_summary", sql(PANEL, "SELECT platform, count(DISTINCT platform_id) AS n_markets, count(*) AS n_rows, round(sum(volume_usd), 4) + 0.0 AS volume FROM pn GROUP BY 1"))
def _(spark, sf):
    return panel(spark, sf).groupBy("platform").agg(F.count_distinct("platform_id").alias("n_markets"), F.count("*").alias("n_rows"), rnd(F.sum("volume_usd"), 4).alias("volume"))


@query("panel_summary", sql(DAYS, "SELECT theme, count(DISTINCT contract_id) AS n_contracts, count(*) AS n_rows, count(*) FILTER (eligible) AS n_eligible FROM cd GROUP BY 1"))
def _(spark, sf):
    return days(spark, sf).groupBy("theme").agg(F.count_distinct("contract_id").alias("n_contracts"), F.count("*").alias("n_rows"), F.count_if("eligible").alias("n_eligible"))


@query("class_summary", sql(MARKETS, "SELECT theme, platform, count(*) AS n, count(DISTINCT event_no) AS n_events, count(*) FILTER (sign > 0) AS n_usable FROM mk GROUP BY ALL"))
def _(spark, sf):
    return markets(spark, sf).groupBy("theme", "platform").agg(F.count("*").alias("n"), F.count_distinct("event_no").alias("n_events"), F.count_if(F.col("sign") > 0).alias("n_usable"))


@query("unit_counts", sql(DAYS, "SELECT CASE WHEN is_deadline THEN 'hazard' ELSE 'prob' END AS unit, zone, count(*) AS n FROM (SELECT DISTINCT contract_id, is_deadline, zone FROM cd WHERE eligible) GROUP BY ALL"))
def _(spark, sf):
    unit = F.when(F.col("is_deadline"), "hazard").otherwise("prob")
    return days(spark, sf).where("eligible").select("contract_id", unit.alias("unit"), "zone").distinct().groupBy("unit", "zone").agg(F.count("*").alias("n"))


@query("volume_by_year_pivot", "WITH s AS (SELECT l_returnflag, year(l_shipdate)::INT AS y, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2) SELECT f.l_returnflag, y.y, coalesce(v, 0)::DOUBLE AS volume FROM (SELECT DISTINCT l_returnflag FROM s) f CROSS JOIN (SELECT DISTINCT y FROM s) y LEFT JOIN s ON s.l_returnflag = f.l_returnflag AND s.y = y.y")
def _(spark, sf):
    """Every flag and every year of the data, 0 where there is nothing; wide by ``pivot`` over the years found, then long again."""
    s = files.written(table(spark, sf, "lineitem").groupBy("l_returnflag", F.year("l_shipdate").alias("y")).agg(F.sum("l_quantity").cast("double").alias("v")), "years")
    years = sorted(r["y"] for r in s.select("y").distinct().collect())  # a row a year
    wide = s.groupBy("l_returnflag").pivot("y", years).agg(F.sum("v")).fillna(0)
    return wide.unpivot(["l_returnflag"], [F.col(f"`{y}`") for y in years], "y", "volume").withColumn("y", F.col("y").cast("int"))


@query("quarter_platform_volume", "SELECT date_trunc('quarter', o_orderdate)::DATE AS quarter, round(coalesce(sum(o_totalprice) FILTER (o_orderstatus = 'O'), 0), 2) + 0.0 AS o, round(coalesce(sum(o_totalprice) FILTER (o_orderstatus = 'F'), 0), 2) + 0.0 AS f, round(coalesce(sum(o_totalprice) FILTER (o_orderstatus = 'P'), 0), 2) + 0.0 AS p FROM orders GROUP BY 1")
def _(spark, sf):
    q = table(spark, sf, "orders").withColumn("quarter", F.to_date(F.date_trunc("quarter", "o_orderdate")))
    p = q.groupBy("quarter").pivot("o_orderstatus", ["O", "F", "P"]).agg(F.sum("o_totalprice")).fillna(0)
    return p.select("quarter", rnd("O", 2).alias("o"), rnd("F", 2).alias("f"), rnd("P", 2).alias("p"))
