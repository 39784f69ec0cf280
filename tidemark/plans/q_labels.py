"""Queries for labelling, panels of labels, streaming twins and remaining table operators."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.common import rnd
from tidemark.operators import book, gazetteer, labels, rules, sampling
from tidemark.plans.base import MARKET, PANEL, RAW, RETURNS, TRADES, market_long, raw_tape, returns, sql, table
from tidemark.plans.q_series import CELLS, Z, cells, z_rows
from tidemark.plans.registry import query
from tidemark.sources import files
from tidemark.streaming import tape as stream

RULES = [("v1", "veto", "(?i)free trial"), ("r1", "paging", r"page=\d+"), ("r2", "tracked", "ref="), ("r3", "english", "/en/"), ("r4", "secure", "^https")]


def case_sql(col, pick):
    return "CASE " + " ".join(f"WHEN regexp_matches({col}, '{p}') THEN {pick(i, n, p)}" for i, n, p in RULES) + " END"


@query("label_first_match", f"SELECT page_id, {case_sql('url', lambda i, n, p: repr(n))} AS label, {case_sql('url', lambda i, n, p: repr(i))} AS rule, {case_sql('url', lambda i, n, p: f'regexp_extract(url, {p!r})' if chr(92) not in p else 'regexp_extract(url, ' + chr(39) + p + chr(39) + ')')} AS found FROM pages")
def _(spark, sf):
    a, b, c = labels.first_match("url", RULES)
    return table(spark, sf, "pages").select("page_id", a.alias("label"), b.alias("rule"), c.alias("found"))


#: stand-in texts are a part's type and name; phrases of up to three words are places, themes are key % 5
PHRASES = [("red", "RD"), ("blue", "BL"), ("ring", "RG"), ("bolt", "BT"), ("small", "SM"), ("red ring", "RR"), ("blue bolt", "BB"), ("economy small", "ES"), ("economy red ring", "ER")]
ZONES = {"RD": "R", "RR": "R", "ER": "R", "BL": "B", "BB": "B", "SM": "EA", "ES": "EA"}
MEMBERS = {"SM": "SM", "ES": "ES"}
BANKS = [(r"\bgizmo\b", "GZ"), (r"\bhot (rod|gear)\b", "HR")]
AREA = r"\b(plate|large widget)\b"
REGIONS = [("COLOUR", ["RR", "BL"]), ("SIZE", ["SM", "ES"])]
SPOKEN = r"\b(hot|widget)\b"


def case_of(col, table):
    return f"CASE {col} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " END"


# texts have three words, so three places can start a phrase; each is taken if no phrase before it reaches over it
PLACES = (
    "gz AS (SELECT * FROM (VALUES " + ", ".join(f"('{p}', '{c}')" for p, c in PHRASES) + ") t(phrase, place)), "
    + "tx AS (SELECT p_partkey, p_partkey % 5 AS theme, lower(p_type || ' ' || p_name) AS text, string_split(lower(p_type || ' ' || p_name), ' ') AS w FROM part), "
    + "gr AS (SELECT p_partkey, a.a AS pos, n.n AS n, array_to_string(list_slice(w, a.a, a.a + n.n - 1), ' ') AS phrase FROM tx, (VALUES (1), (2), (3)) a(a), (VALUES (1), (2), (3)) n(n) WHERE a.a + n.n - 1 <= len(w)), "
    + "ht AS (SELECT p_partkey, pos, max(n) AS n, arg_max(place, n) AS place FROM gr JOIN gz ON gz.phrase = gr.phrase GROUP BY 1, 2), "
    + "hh AS (SELECT tx.*, a.place AS c1, coalesce(a.n, 0) AS e1, CASE WHEN coalesce(a.n, 0) <= 1 THEN b.place END AS c2, greatest(coalesce(a.n, 0), CASE WHEN coalesce(a.n, 0) <= 1 AND b.n IS NOT NULL THEN 1 + b.n ELSE 0 END) AS e2, c.place AS c30 FROM tx LEFT JOIN ht a ON a.p_partkey = tx.p_partkey AND a.pos = 1 LEFT JOIN ht b ON b.p_partkey = tx.p_partkey AND b.pos = 2 LEFT JOIN ht c ON c.p_partkey = tx.p_partkey AND c.pos = 3), "
    + "hp AS (SELECT *, CASE WHEN e2 <= 2 THEN c30 END AS c3 FROM hh)"
)
RESOLVED = PLACES + (
    f", za AS (SELECT *, CASE WHEN regexp_matches(text, '{AREA}') THEN 'EA' END AS z0, {case_of('c1', ZONES)} AS z1, {case_of('c2', ZONES)} AS z2, {case_of('c3', ZONES)} AS z3, "
    + f"coalesce({case_of('c1', MEMBERS)}, {case_of('c2', MEMBERS)}, {case_of('c3', MEMBERS)}) AS member, CASE WHEN theme = 0 THEN CASE WHEN regexp_matches(text, '{BANKS[0][0]}') THEN 'GZ' WHEN regexp_matches(text, '{BANKS[1][0]}') THEN 'HR' END END AS bank FROM hp), "
    + "zb AS (SELECT * REPLACE (CASE WHEN theme <> 1 OR z0 IN ('R', 'EA') THEN z0 END AS z0, CASE WHEN theme <> 1 OR z1 IN ('R', 'EA') THEN z1 END AS z1, CASE WHEN theme <> 1 OR z2 IN ('R', 'EA') THEN z2 END AS z2, CASE WHEN theme <> 1 OR z3 IN ('R', 'EA') THEN z3 END AS z3) FROM za), "
    + "zc AS (SELECT *, concat_ws('|', z0, CASE WHEN z1 IS DISTINCT FROM z0 THEN z1 END, CASE WHEN z2 IS DISTINCT FROM z0 AND z2 IS DISTINCT FROM z1 THEN z2 END, CASE WHEN z3 IS DISTINCT FROM z0 AND z3 IS DISTINCT FROM z1 AND z3 IS DISTINCT FROM z2 THEN z3 END) AS zs FROM zb)"
)


def part_texts(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", (F.col("p_partkey") % 5).cast("int").alias("theme"), F.lower(F.concat_ws(" ", "p_type", "p_name")).alias("text"))
    return gazetteer.with_places(p, "p_partkey", "text", spark.createDataFrame(PHRASES, "phrase string, place string"), 3)


@query("resolve_zone", sql(RESOLVED, "SELECT p_partkey, CASE WHEN bank IS NOT NULL THEN bank WHEN theme = 1 THEN concat_ws('|', 'GLOBAL', nullif(zs, '')) WHEN zs = '' AND c1 IS NULL AND c2 IS NULL AND c3 IS NULL THEN 'US' WHEN theme = 4 THEN concat_ws('|', 'US', nullif(zs, '')) ELSE zs END AS zones, CASE WHEN bank IS NULL THEN member END AS member FROM zc"))
def _(spark, sf):
    text, places, theme = F.col("text"), F.col("places"), F.col("theme")
    area = AREA.replace("\\", "\\")
    banks = [(p.replace("\\", "\\"), z) for p, z in BANKS]
    zones = gazetteer.resolve_zones(text, places, theme, BANKS, 0, [(AREA, "EA")], ZONES, 1, ["R", "EA"], "US", [0, 2, 3, 4], 4)
    bank = F.coalesce((theme == 0) & F.exists(F.array(*[text.rlike(p) for p, _ in BANKS]), lambda x: x), F.lit(False))
    return part_texts(spark, sf).select("p_partkey", F.array_join(zones, "|").alias("zones"), F.when(~bank, gazetteer.first_member(places, MEMBERS)).alias("member"))


@query("geo_region", sql(PLACES, f"SELECT p_partkey, region, region IN ('COLOUR', 'WARM') AS oil FROM (SELECT p_partkey, CASE WHEN list_has_any([c1, c2, c3], ['RR', 'BL']) THEN 'COLOUR' WHEN list_has_any([c1, c2, c3], ['SM', 'ES']) THEN 'SIZE' WHEN regexp_matches(text, '{SPOKEN}') THEN 'WARM' ELSE 'OTHER' END AS region FROM hp WHERE theme = 1)"))
def _(spark, sf):
    region = gazetteer.region_of(F.col("text"), F.col("places"), REGIONS, [("WARM", SPOKEN.replace("\\", "\\"))])
    return part_texts(spark, sf).where("theme = 1").select("p_partkey", region.alias("region")).withColumn("oil", F.col("region").isin("COLOUR", "WARM"))


@query("direction_sign", "SELECT page_id, CASE WHEN regexp_matches(url, '#top') THEN -1 WHEN regexp_matches(url, 'page=') THEN 1 ELSE 0 END::INT AS d FROM pages")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", labels.direction("url", "page=", "#top").alias("d"))


STANCES = [(1, "^red", "economy|small", 1), (2, "bolt$", ".", -1), (3, "ring", "promo", 1), (4, "(hot|large) gear", "[a-z]", 0), (5, "gizmo", "standard", -1), (6, "^.*plate", "econ", 1)]


@query("stance_lookup", "SELECT p_partkey, min(k)::INT AS rule, arg_min(s, k)::INT AS s FROM part JOIN (VALUES " + ", ".join(f"({k}, '{p}', '{c}', {v})" for k, p, c, v in STANCES) + ") t(k, pattern, context, s) ON regexp_matches(p_name, pattern, 'i') AND regexp_matches(p_type, context, 'i') GROUP BY 1")
def _(spark, sf):
    stances = spark.createDataFrame(STANCES, "no int, pattern string, context string, s int")
    return rules.first_rule(table(spark, sf, "part"), "p_partkey", "p_name", "p_type", stances, "s")


@query("parse_count", r"SELECT page_id, CAST(nullif(regexp_extract(url, 'page=(\d+)', 1), '') AS INT) AS n FROM pages")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", labels.count_in("url", r"page=(\d+)").alias("n"))


@query("parse_bracket", r"SELECT page_id, (CAST(nullif(regexp_extract(url, '/(\d+)\?page=(\d+)', 1), '') AS DOUBLE) + CAST(nullif(regexp_extract(url, '/(\d+)\?page=(\d+)', 2), '') AS DOUBLE)) / 2 AS mid FROM pages")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", labels.bracket("url", r"/(\d+)\?page=(\d+)").alias("mid"))


@query("parse_threshold", r"SELECT page_id, x, CASE WHEN NOT regexp_matches(url, 'page=') THEN x * 100 END AS level_bp FROM (SELECT page_id, url, CAST(nullif(regexp_extract(url, '/(\d+)', 1), '') AS DOUBLE) AS x FROM pages)")
def _(spark, sf):
    """The first number, and as a level in hundredths where no rule for counts applies."""
    x = labels.number_in("url", r"/(\d+)")
    return table(spark, sf, "pages").select("page_id", x.alias("x"), F.when(~F.col("url").rlike("page="), x * 100).alias("level_bp"))


@query("subtype_label", "SELECT coalesce(CASE WHEN regexp_matches(p_name, '^(red|blue)') THEN 'colour' WHEN regexp_matches(p_name, '^small') THEN 'size' END, 'plain') AS subtype, count(*) AS n FROM part GROUP BY 1")
def _(spark, sf):
    s, _, _ = labels.first_match("p_name", [("1", "colour", "^(red|blue)"), ("2", "size", "^small")])
    return table(spark, sf, "part").groupBy(F.coalesce(s, F.lit("plain")).alias("subtype")).agg(F.count("*").alias("n"))


REVIEW = [("top", "#top", -1, "."), ("first page", "page=1", 1, "ref="), ("second page", "page=2", 1, "/(en|de)/"), ("no sign", "ref=", 0, "^http:")]


@query("sign_review", "SELECT page_id, url, d, name AS review FROM (SELECT page_id, url, CASE WHEN regexp_matches(url, '#top') THEN -1 WHEN regexp_matches(url, 'page=') THEN 1 ELSE 0 END::INT AS d FROM pages) JOIN (VALUES " + ", ".join(f"('{n}', '{p}', {d}, '{c}')" for n, p, d, c in REVIEW) + ") t(name, pattern, sign, cond) ON regexp_matches(url, pattern) AND d = sign AND regexp_matches(url, cond)")
def _(spark, sf):
    """Rows that match a review's pattern, have its sign and meet its condition; once for each review."""
    u = F.col("url")
    p = table(spark, sf, "pages").select("page_id", "url", labels.direction("url", "page=", "#top").alias("d"))
    hits = F.array(*[F.when(u.rlike(pattern) & (F.col("d") == sign) & u.rlike(cond), F.lit(n)) for n, pattern, sign, cond in REVIEW])
    return p.select("page_id", "url", "d", F.explode(F.array_compact(hits)).alias("review"))


SAMPLE = """cu AS (SELECT c_mktsegment AS stratum, c_nationkey AS event, c_custkey AS market, c_acctbal AS vol FROM customer),
ev AS (SELECT stratum, event, md5('sheet-event|' || event) AS h FROM (SELECT DISTINCT stratum, event FROM cu WHERE event IN (SELECT event FROM cu GROUP BY 1 HAVING sum(vol) >= 10000))),
tk AS (SELECT stratum, event FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY h, event) AS k FROM ev) WHERE k <= 6),
mk1 AS (SELECT event, market FROM (SELECT event, market, row_number() OVER (PARTITION BY event ORDER BY md5('sheet-market|' || market), market) AS k FROM cu) WHERE k = 1)"""


@query("stratified_sample", sql(SAMPLE, "SELECT row_number() OVER (ORDER BY md5('sheet-item|' || stratum || '|' || tk.event), stratum, tk.event)::INT AS item, stratum, tk.event, market FROM tk JOIN mk1 ON mk1.event = tk.event"))
def _(spark, sf):
    """Segments are strata, nations events and customers markets."""
    rows = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("stratum"), F.col("c_nationkey").alias("event"), F.col("c_custkey").alias("market"), F.col("c_acctbal").alias("vol"))
    return sampling.stratified_sample(rows, "stratum", "event", "market", "vol", 10000, 6, "sheet")


@query("subtype_profile", sql(Z, "SELECT theme, count(DISTINCT contract_id) AS n, count(*) AS n_rows, round(sum(vol1d), 3) + 0.0 AS volume, round(sum(abs(z)), 3) + 0.0 AS moves, round(sum(z), 3) + 0.0 AS signed, round(sum(abs(z)) / (SELECT sum(abs(z)) FROM zz), 5) + 0.0 AS share, round(sum(z) / (SELECT sum(abs(z)) FROM zz), 5) + 0.0 AS signed_share FROM zz WHERE z IS NOT NULL GROUP BY 1"))
def _(spark, sf):
    g = z_rows(spark, sf).where("z is not null").groupBy("theme").agg(
        F.count_distinct("contract_id").alias("n"), F.count("*").alias("n_rows"), rnd(F.sum("vol1d"), 3).alias("volume"), F.sum(F.abs("z")).alias("m"), F.sum("z").alias("s")
    )
    every = F.sum("m").over(Window.partitionBy())  # a row a theme
    return g.select("theme", "n", "n_rows", "volume", rnd("m", 3).alias("moves"), rnd("s", 3).alias("signed"), rnd(F.col("m") / every, 5).alias("share"), rnd(F.col("s") / every, 5).alias("signed_share"))


@query("share_by_year", sql(RETURNS, "SELECT year(day)::INT AS y, round(sum(abs(r)) FILTER (n > 1) / sum(abs(r)), 6) + 0.0 AS share FROM rt GROUP BY 1"))
def _(spark, sf):
    return returns(spark, sf).groupBy(F.year("day").alias("y")).agg(rnd(F.sum(F.when(F.col("n") > 1, F.abs("r"))) / F.sum(F.abs("r"))).alias("share"))


@query("decisive_bucket_pnl", sql(RETURNS, "SELECT b, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share, round(sum(r), 6) + 0.0 AS pnl, round(sum(r) / sum(count(*)) OVER () * 252, 6) + 0.0 AS contribution, round(avg((r > 0)::INT::DOUBLE), 6) AS hit FROM (SELECT r, lag(CASE WHEN n > 2 THEN 'busy' ELSE 'quiet' END) OVER (PARTITION BY ticker ORDER BY day) AS b FROM rt) WHERE b IS NOT NULL AND r IS NOT NULL GROUP BY 1"))
def _(spark, sf):
    """By the label of the day before: share of days, P&L, what it adds to the annual mean, hit rate."""
    w = Window.partitionBy("ticker").orderBy("day")
    r = returns(spark, sf).withColumn("b", F.lag(F.when(F.col("n") > 2, "busy").otherwise("quiet")).over(w))
    g = r.where("b is not null and r is not null").groupBy("b").agg(F.count("*").alias("n"), F.sum("r").alias("s"), F.round(F.avg((F.col("r") > 0).cast("double")), 6).alias("hit"))
    every = F.sum("n").over(Window.partitionBy())  # a row a bucket
    return g.select("b", "n", F.round(F.col("n") / every, 6).alias("share"), rnd("s").alias("pnl"), rnd(F.col("s") / every * 252).alias("contribution"), "hit")


@query("leave_one_out_marginal", sql(RETURNS, ", t AS (SELECT ticker, avg(r) AS m, count(r) AS n FROM rt GROUP BY 1) SELECT ticker, round((SELECT sum(m * n) / sum(n) FROM t) * 252 - (SELECT sum(m * n) / sum(n) FROM t u WHERE u.ticker <> t.ticker) * 252, 6) + 0.0 AS marginal FROM t").replace(")\n, t", "), t"))
def _(spark, sf):
    t = returns(spark, sf).groupBy("ticker").agg(F.sum("r").alias("s"), F.count("r").alias("n"))
    every = Window.partitionBy()
    s, n = F.sum("s").over(every), F.sum("n").over(every)
    return t.select("ticker", rnd((s / n - (s - F.col("s")) / (n - F.col("n"))) * 252).alias("marginal"))


@query("unit_index_change", sql(Z, "SELECT zone, CAST(day AS DATE) AS day, round(sum(z * vol7d) FILTER (unit = 'hazard') / nullif(sum(vol7d), 0), 5) + 0.0 AS hazard, round(sum(z * vol7d) FILTER (unit = 'prob') / nullif(sum(vol7d), 0), 5) + 0.0 AS prob FROM zz WHERE z IS NOT NULL GROUP BY 1, 2"))
def _(spark, sf):
    total = F.expr("nullif(sum(vol7d), 0)")
    part = lambda u: rnd(F.sum(F.when(F.col("unit") == u, F.col("z") * F.col("vol7d"))) / total, 5).alias(u)
    return z_rows(spark, sf).where("z is not null").groupBy("zone", "day").agg(part("hazard"), part("prob"))


@query("exposure_summary", sql(RETURNS, ", ri AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY day) AS i FROM rt), es AS (SELECT *, i - last_value(CASE WHEN abs(r) > 0.02 THEN i END IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY day) AS g FROM ri), ee AS (SELECT *, CASE WHEN g IS NULL OR g >= 4 THEN 1.0::DOUBLE ELSE 0.25::DOUBLE + 0.75::DOUBLE * g / 4 END AS e FROM es) SELECT ticker, round(avg(e), 6) + 0.0 AS mean_w, count(*) FILTER (e < 1) AS n_reduced, count(*) FILTER (abs(r) > 0.02) AS n_shocks FROM ee GROUP BY 1").replace(")\n, ri", "), ri"))
def _(spark, sf):
    """Mean exposure, days on which it is reduced, and days with a shock."""
    w = Window.partitionBy("ticker").orderBy("day")
    shock = F.coalesce(F.abs("r") > 0.02, F.lit(False))
    r = returns(spark, sf).withColumn("i", F.row_number().over(w)).withColumn("shock", shock)
    r = r.withColumn("g", F.col("i") - F.last(F.when(F.col("shock"), F.col("i")), True).over(w)).withColumn("e", book.timing_exposure("g", 0.25, 4))
    return r.groupBy("ticker").agg(rnd(F.avg("e")).alias("mean_w"), F.count_if(F.col("e") < 1).alias("n_reduced"), F.count_if("shock").alias("n_shocks"))


@query("forecast_sum", sql(CELLS, "SELECT CAST(day AS DATE) AS day, round(sum(d_vw * (theme + 1) / 10.0::DOUBLE), 4) + 0.0 AS y FROM ce GROUP BY 1"))
def _(spark, sf):
    coef = F.broadcast(spark.createDataFrame([(t, (t + 1) / 10) for t in range(5)], "theme int, coef double"))
    return cells(spark, sf).join(coef, "theme").groupBy("day").agg(rnd(F.sum(F.col("d_vw") * F.col("coef")), 4).alias("y"))


@query("decisive_term", sql(CELLS, "SELECT zone, theme, CAST(day AS DATE) AS day, CASE WHEN abs(d_vw) >= abs(d_ew) THEN 'vw' ELSE 'ew' END AS term FROM ce WHERE abs(abs(d_vw) - abs(d_ew)) > 1e-9"))
def _(spark, sf):
    c = cells(spark, sf).where(F.abs(F.abs("d_vw") - F.abs("d_ew")) > 1e-9)
    return c.select("zone", "theme", "day", F.when(F.abs("d_vw") >= F.abs("d_ew"), "vw").otherwise("ew").alias("term"))


@query("equal_weight_variant", sql(CELLS, "SELECT zone, theme, CAST(day AS DATE) AS day, round(d_ew, 5) + 0.0 AS d FROM ce"))
def _(spark, sf):
    return cells(spark, sf).select("zone", "theme", "day", rnd("d_ew", 5).alias("d"))


@query("basket_hourly", sql(RAW, ", h AS (SELECT platform, date_trunc('hour', ts) AS h, avg(price) AS p FROM raw GROUP BY 1, 2), c AS (SELECT *, ln(p) - lag(ln(p)) OVER (PARTITION BY platform ORDER BY h) AS d FROM h) SELECT h, round(-avg(d), 7) + 0.0 AS b FROM c WHERE d IS NOT NULL GROUP BY 1 HAVING count(*) = 5").replace(")\n, h", "), h"))
def _(spark, sf):
    h = raw_tape(spark, sf).groupBy("platform", F.date_trunc("hour", "ts").alias("h")).agg(F.avg("price").alias("p"))
    c = h.withColumn("d", F.log("p") - F.lag(F.log("p")).over(Window.partitionBy("platform").orderBy("h"))).where("d is not null")
    return c.groupBy("h").agg(rnd(-F.avg("d"), 7).alias("b"), F.count("*").alias("n")).where("n = 5").drop("n")


# -- streaming twins: the stream's result is the batch result -------------------------------------


def _source(spark, sf):
    events = spark.readStream.schema(table(spark, sf, "events").schema).parquet(f"{sf}/events.parquet*")
    return events.select(
        F.col("event_type").alias("platform"), F.col("user_id").cast("string").alias("platform_id"), F.col("ts").cast("timestamp").alias("ts"), "event_id",
        (F.lit(0.01) + F.lit(0.98) * F.col("value") / (F.col("value") + 50)).alias("price"), F.col("value").alias("size"), (F.col("event_id") % 2 == 0).alias("is_yes"),
    )


def _paths(spark):
    root = files.shared_path(spark, "stream")
    return root + "/out", root + "/state"


@query("stream_hourly_last", sql(TRADES, "SELECT platform, platform_id, date_trunc('hour', ts) + INTERVAL 1 HOUR AS hour_end, round(arg_max(px, (ts, event_id)), 6) + 0.0 AS px FROM tr WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 2 HOUR FROM tr) GROUP BY ALL"))
def _(spark, sf):
    out = stream.run_once(stream.hourly_last(_source(spark, sf)), "append", *_paths(spark))
    return out.select("platform", "platform_id", "hour_end", rnd("px").alias("px"))


@query("stream_snapshot_panel", sql(PANEL, "SELECT platform, platform_id, CAST(snap_date AS DATE) AS day, round(px_last, 6) + 0.0 AS px_last, last_ts, round(volume_usd, 4) + 0.0 AS volume_usd, n_trades, 0::BIGINT AS n_late FROM pn"))
def _(spark, sf):
    out, late = stream.run_counted(stream.snapshot_panel(_source(spark, sf)), "complete", *_paths(spark))
    return out.select("platform", "platform_id", F.to_date("snap_ts").alias("day"), rnd("px_last").alias("px_last"), "last_ts", rnd("volume_usd", 4).alias("volume_usd"), "n_trades", F.lit(late).alias("n_late"))


@query("stream_dedupe", "SELECT event_id FROM events")
def _(spark, sf):
    s = _source(spark, sf)
    return stream.run_once(stream.dedupe(s.unionByName(s)), "append", *_paths(spark)).select("event_id")


@query("stream_stale_state", sql(TRADES, "SELECT platform, platform_id, round(arg_max(px, (ts, event_id)), 6) + 0.0 AS px, max(ts) AS last_ts, max(ts) + INTERVAL 48 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM tr) AS stale FROM tr GROUP BY 1, 2"))
def _(spark, sf):
    out = stream.run_once(stream.stale_state(_source(spark, sf), hours=48, late="1 hour"), "append", *_paths(spark))
    last = out.groupBy("platform", "platform_id").agg(F.max_by("px", F.struct("last_ts", "stale")).alias("px"), F.max("last_ts").alias("last_ts"), F.max_by("stale", F.struct("last_ts", "stale")).alias("stale"))
    return last.select("platform", "platform_id", rnd("px").alias("px"), "last_ts", "stale")
