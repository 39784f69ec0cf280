"""Queries over theme series: shocks and their confirmation, cell signals, components and audit tables."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.common import rnd
from tidemark.operators import shocks
from tidemark.plans.base import sql
from tidemark.plans.q_series import INDEX, Z, index, z_rows
from tidemark.plans.registry import query

K, MIN_VOLUME, PAIR = 1.0, 50.0, ("click", "view")

EARLY = Z + """,
ze0 AS (SELECT *, CASE WHEN gap <= 7 THEN (value_early - lag(value) OVER (PARTITION BY contract_id ORDER BY day)) / sqrt(gap) END AS dve FROM zz),
ze AS (SELECT *, CASE WHEN sd > 0 AND dve IS NOT NULL THEN greatest(-5.0::DOUBLE, least(5.0::DOUBLE, sign * dve / sd)) END AS z_early FROM ze0)"""
SERIES = EARLY + """,
tc AS (SELECT theme, day, sum(z * vol7d) / nullif(sum(vol7d), 0) AS d, sum(z_early * vol7d) / nullif(sum(vol7d) FILTER (z_early IS NOT NULL), 0) AS d_early, sum(vol1d) AS volume_usd,
  count(DISTINCT contract_id) AS n_contracts, coalesce(sum(z * vol7d) FILTER (is_deadline), 0) / nullif(sum(vol7d), 0) AS part,
  sum(z * vol7d) FILTER (platform = 'click') / nullif(sum(vol7d) FILTER (platform = 'click'), 0) AS d_click,
  sum(z * vol7d) FILTER (platform = 'view') / nullif(sum(vol7d) FILTER (platform = 'view'), 0) AS d_view FROM ze WHERE z IS NOT NULL GROUP BY 1, 2),
td AS (SELECT theme, CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM tc GROUP BY theme),
ts0 AS (SELECT td.theme, td.day, coalesce(d, 0) AS d, coalesce(d_early, 0) AS d_early, coalesce(volume_usd, 0) AS volume_usd, coalesce(n_contracts, 0) AS n_contracts, coalesce(part, 0) AS part, d_click, d_view,
  row_number() OVER (PARTITION BY td.theme ORDER BY td.day) AS i FROM td LEFT JOIN tc ON tc.theme = td.theme AND tc.day = td.day),
tv AS (SELECT a.theme, a.i, CASE WHEN count(*) FILTER (b.n_contracts > 0) >= 20 THEN sum(CASE WHEN b.n_contracts > 0 THEN b.d * b.d * pow(1 - 2 / 61.0::DOUBLE, a.i - b.i) END) / sum(CASE WHEN b.n_contracts > 0 THEN pow(1 - 2 / 61.0::DOUBLE, a.i - b.i) END) END AS v
  FROM ts0 a JOIN ts0 b ON a.theme = b.theme AND b.i <= a.i GROUP BY 1, 2),
ts AS (SELECT ts0.*, sqrt(last_value(tv.v IGNORE NULLS) OVER (PARTITION BY ts0.theme ORDER BY ts0.i)) AS sigma FROM ts0 LEFT JOIN tv ON tv.theme = ts0.theme AND tv.i = ts0.i - 1),
sk0 AS (SELECT *, coalesce(d > sigma, false) AS shock_raw, volume_usd >= 50 AND coalesce(d_click > 0 AND d_view > 0, true) AS ok FROM ts),
sk AS (SELECT *, shock_raw AND ok AND coalesce(d_early > 0.5 * sigma, false) AS c0,
  coalesce(lag(shock_raw) OVER w AND lag(ok) OVER w, false) AND coalesce(lag(d) OVER w + d > sigma, false) AS n, lag(part) OVER w AS part0, lag(d) OVER w AS d0 FROM sk0 WINDOW w AS (PARTITION BY theme ORDER BY i)),
rec AS (SELECT theme, i, c0 AS confirmed FROM sk WHERE i = 1 UNION ALL
  SELECT s.theme, s.i, s.c0 OR (s.n AND NOT r.confirmed) FROM rec r JOIN sk s ON s.theme = r.theme AND s.i = r.i + 1),
so AS (SELECT sk.*, rec.confirmed, CASE WHEN rec.confirmed THEN CASE WHEN shock_raw AND d > 0 THEN part / d ELSE (part + coalesce(part0, 0)) / nullif(d + coalesce(d0, 0), 0) END END AS share FROM sk JOIN rec ON rec.theme = sk.theme AND rec.i = sk.i)"""


def series(spark, sf):
    return shocks.theme_series(shocks.with_early_z(z_rows(spark, sf)), ["theme"], PAIR, F.col("is_deadline"))


def shocked(spark, sf):
    return shocks.with_shocks(shocks.with_sigma(series(spark, sf), ["theme"]), ["theme"], K, MIN_VOLUME, PAIR)


def recursive(ctes, select):
    return "WITH RECURSIVE " + ctes + "\n" + select


@query("shock_flag", recursive(SERIES, "SELECT theme, CAST(day AS DATE) AS day, round(d, 5) + 0.0 AS d, round(sigma, 5) + 0.0 AS sigma, shock_raw FROM so"))
def _(spark, sf):
    return shocked(spark, sf).select("theme", "day", rnd("d", 5).alias("d"), rnd("sigma", 5).alias("sigma"), "shock_raw")


@query("shock_confirm", recursive(SERIES, "SELECT theme, CAST(day AS DATE) AS day, confirmed FROM so"))
def _(spark, sf):
    return shocked(spark, sf).select("theme", "day", "confirmed")


@query("subset_share_of_shock", recursive(SERIES, "SELECT theme, CAST(day AS DATE) AS day, round(share, 5) + 0.0 AS share, coalesce(round(share, 9) > 0.5, false) AS mostly FROM so"))
def _(spark, sf):
    return shocked(spark, sf).select("theme", "day", rnd("share", 5).alias("share"), "mostly")


def signal_sql(source, keys, h="5.0::DOUBLE", name="sg"):
    """CTE chain: (keys, day, i, d, n_contracts) to ``name`` with s, sd and z."""
    on = " AND ".join(f"a.{k} = b.{k}" for k in keys)
    cols = ", ".join(f"a.{k}" for k in keys)
    part = ", ".join(keys)
    return f"""{name}0 AS (SELECT {cols}, a.day, a.i, any_value(a.d) AS d, any_value(a.n_contracts) AS n_contracts, sum(CASE WHEN b.n_contracts > 0 THEN b.d ELSE 0 END * pow(0.5::DOUBLE, (a.i - b.i) / {h})) / sum(pow(0.5::DOUBLE, (a.i - b.i) / {h})) AS s FROM {source} a JOIN {source} b ON {on} AND b.i <= a.i GROUP BY {cols}, a.day, a.i),
{name}1 AS (SELECT *, count(*) FILTER (n_contracts > 0) OVER w AS before FROM {name}0 WINDOW w AS (PARTITION BY {part} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
{name}2 AS (SELECT *, CASE WHEN count(*) FILTER (before > 0) OVER w >= 20 THEN stddev_samp(s) FILTER (before > 0) OVER w END AS sd FROM {name}1 WINDOW w AS (PARTITION BY {part} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
{name} AS (SELECT *, CASE WHEN before >= 20 AND sd > 0 THEN s / sd ELSE 0 END AS z FROM {name}2)"""


CELL = INDEX + ", ixi AS (SELECT zone, theme, day, d_vw AS d, n_contracts, row_number() OVER (PARTITION BY zone, theme ORDER BY day) AS i FROM ix), " + signal_sql("ixi", ["zone", "theme"])


def signals(spark, sf):
    return shocks.cell_signal(index(spark, sf).withColumn("d", F.col("d_vw")), ["zone", "theme"])


@query("cell_signal", sql(CELL, "SELECT zone, theme, CAST(day AS DATE) AS day, round(s, 6) + 0.0 AS s, round(sd, 6) + 0.0 AS sd, round(z, 4) + 0.0 AS z FROM sg"))
def _(spark, sf):
    return signals(spark, sf).select("zone", "theme", "day", rnd("s").alias("s"), rnd("sd").alias("sd"), rnd("z", 4).alias("z"))


#: the base zone, and the sign of each theme's leg; theme 0 flips by regime, theme 1 has no base leg
BASE, FLIPS, NO_BASE, SIGNS = "click", 0, 1, {0: 1, 1: 1, 2: 1, 3: -1, 4: 1}
LEGS = CELL + """,
rg AS (SELECT *, sum(s) OVER (PARTITION BY zone, day) AS zone_s FROM sg),
rh AS (SELECT *, CASE WHEN lag(round(zone_s, 9)) OVER (PARTITION BY zone, theme ORDER BY day) < 0 THEN 1 ELSE 0 END AS regime FROM rg),
lg AS (SELECT *, CASE WHEN zone = 'click' AND theme = 1 THEN 0 WHEN theme = 0 THEN CASE WHEN regime = 1 THEN -1 ELSE 1 END * z WHEN theme = 3 THEN -z ELSE z END AS leg FROM rh)"""


def legs(spark, sf):
    """The signals with regime (1 after a day on which the zone's smoothed changes add up to less than 0) and signed leg."""
    s = signals(spark, sf).withColumn("zone_s", F.round(F.sum("s").over(Window.partitionBy("zone", "day")), 9))
    regime = F.when(F.lag("zone_s").over(Window.partitionBy("zone", "theme").orderBy("day")) < 0, 1).otherwise(0)
    s = s.withColumn("regime", regime)
    sign = F.create_map(*[F.lit(x) for p in SIGNS.items() for x in p])[F.col("theme")]
    flip = F.when((F.col("theme") == FLIPS) & (F.col("regime") == 1), -1).otherwise(1)
    leg = F.when((F.col("zone") == BASE) & (F.col("theme") == NO_BASE), 0.0).otherwise(sign * flip * F.col("z"))
    return s.withColumn("leg", leg)


def less_base(value):
    """A zone's value less that of the base zone on the same theme and day (0 where the base has none)."""
    value = F.col(value) if isinstance(value, str) else value
    base = F.max(F.when(F.col("zone") == BASE, value)).over(Window.partitionBy("theme", "day"))
    return value - F.coalesce(base, F.lit(0.0))


@query("signed_components", sql(LEGS, "SELECT f.zone, f.theme, CAST(f.day AS DATE) AS day, round(f.leg - coalesce(u.leg, 0), 4) + 0.0 AS x FROM lg f LEFT JOIN lg u ON u.zone = 'click' AND u.theme = f.theme AND u.day = f.day WHERE f.zone <> 'click'"))
def _(spark, sf):
    return legs(spark, sf).withColumn("x", less_base("leg")).where(F.col("zone") != BASE).select("zone", "theme", "day", rnd("x", 4).alias("x"))


@query("raw_interactions", sql(LEGS, """, q AS (SELECT zone, day, z, z * regime AS zr, z * length(zone) / 10.0::DOUBLE AS zd FROM lg WHERE theme = 0)
SELECT f.zone, CAST(f.day AS DATE) AS day, round(f.z - coalesce(u.z, 0), 4) + 0.0 AS raw, round(f.zr - coalesce(u.zr, 0), 4) + 0.0 AS x_regime, round(f.zd - coalesce(u.zd, 0), 4) + 0.0 AS x_debt
FROM q f LEFT JOIN q u ON u.zone = 'click' AND u.day = f.day WHERE f.zone <> 'click'""").replace(")\n, q", "), q"))
def _(spark, sf):
    rows = legs(spark, sf).where(F.col("theme") == FLIPS)
    z = F.col("z")
    parts = {"raw": z, "x_regime": z * F.col("regime"), "x_debt": z * F.length("zone") / 10.0}
    rows = rows.withColumns({name: less_base(x) for name, x in parts.items()})
    return rows.where(F.col("zone") != BASE).select("zone", "day", *[rnd(c, 4).alias(c) for c in parts])


CHAIN = LEGS + """,
cb AS (SELECT *, 0.1::DOUBLE * leg AS y, CASE WHEN sd > 0 THEN 0.1::DOUBLE * leg / (sd * sd) ELSE 0 END AS pos FROM lg)"""


def chain(spark, sf):
    s = legs(spark, sf).withColumn("y", 0.1 * F.col("leg"))
    return s.withColumn("pos", F.coalesce(F.when(F.col("sd") > 0, F.col("y") / (F.col("sd") * F.col("sd"))), F.lit(0.0)))


@query("signal_chain", sql(CHAIN, "SELECT zone, theme, CAST(day AS DATE) AS day, round(d, 5) + 0.0 AS d, round(s, 5) + 0.0 AS s, round(sd, 5) + 0.0 AS sd, round(z, 4) + 0.0 AS z, regime, round(y, 4) + 0.0 AS y, round(pos, 2) + 0.0 AS pos FROM cb"))
def _(spark, sf):
    return chain(spark, sf).select("zone", "theme", "day", rnd("d", 5).alias("d"), rnd("s", 5).alias("s"), rnd("sd", 5).alias("sd"), rnd("z", 4).alias("z"), "regime", rnd("y", 4).alias("y"), rnd("pos", 2).alias("pos"))


@query("event_window_slice", sql(CHAIN, ", an AS (SELECT zone, theme, arg_max(day, (round(abs(d), 6), day)) AS anchor FROM cb GROUP BY 1, 2) SELECT cb.zone, cb.theme, (cb.day - anchor)::INT AS off, round(cb.d, 5) + 0.0 AS d, round(cb.z, 4) + 0.0 AS z, round(x.exposure, 3) + 0.0 AS exposure FROM cb JOIN an ON an.zone = cb.zone AND an.theme = cb.theme AND cb.day BETWEEN anchor - 3 AND anchor + 5 LEFT JOIN (SELECT day, sum(abs(pos)) AS exposure FROM cb GROUP BY 1) x ON x.day = cb.day").replace(")\n, an", "), an"))
def _(spark, sf):
    c = chain(spark, sf)
    anchor = F.max_by("day", F.struct(F.round(F.abs("d"), 6), "day")).over(Window.partitionBy("zone", "theme"))
    exposure = F.sum(F.abs("pos")).over(Window.partitionBy("day"))
    cut = c.withColumn("exposure", exposure).withColumn("off", F.datediff("day", anchor)).where(F.col("off").between(-3, 5))
    return cut.select("zone", "theme", "off", rnd("d", 5).alias("d"), rnd("z", 4).alias("z"), rnd("exposure", 3).alias("exposure"))


SPLIT = Z + """,
pc AS (SELECT theme, day, sum(z * vol7d) / nullif(sum(vol7d), 0) AS d, coalesce(sum(z * vol7d) FILTER (is_deadline), 0) / nullif(sum(vol7d), 0) AS a, coalesce(sum(z * vol7d) FILTER (NOT is_deadline), 0) / nullif(sum(vol7d), 0) AS b, count(DISTINCT contract_id) AS n_contracts FROM zz WHERE z IS NOT NULL GROUP BY 1, 2),
pd AS (SELECT theme, CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM pc GROUP BY theme),
pe AS (SELECT pd.theme, pd.day, coalesce(d, 0) AS d, coalesce(a, 0) AS a, coalesce(b, 0) AS b, coalesce(n_contracts, 0) AS n_contracts, row_number() OVER (PARTITION BY pd.theme ORDER BY pd.day) AS i FROM pd LEFT JOIN pc ON pc.theme = pd.theme AND pc.day = pd.day),
pf AS (SELECT x.theme, x.day, sum(y.a * pow(0.5::DOUBLE, (x.i - y.i) / 5.0::DOUBLE)) / sum(pow(0.5::DOUBLE, (x.i - y.i) / 5.0::DOUBLE)) AS sa, sum(y.b * pow(0.5::DOUBLE, (x.i - y.i) / 5.0::DOUBLE)) / sum(pow(0.5::DOUBLE, (x.i - y.i) / 5.0::DOUBLE)) AS sb FROM pe x JOIN pe y ON y.theme = x.theme AND y.i <= x.i GROUP BY 1, 2), """ + signal_sql("pe", ["theme"])


@query("split_signal_additive", sql(SPLIT, "SELECT pf.theme, CAST(pf.day AS DATE) AS day, round(CASE WHEN z <> 0 THEN sa / sd ELSE 0 END, 4) + 0.0 AS deadline, round(CASE WHEN z <> 0 THEN sb / sd ELSE 0 END, 4) + 0.0 AS other, round(z, 4) + 0.0 AS full FROM pf JOIN sg ON sg.theme = pf.theme AND sg.day = pf.day"))
def _(spark, sf):
    from tidemark.functions.ewm import alpha_of, with_ewm_mean

    s = shocks.cell_signal(series(spark, sf), ["theme"])
    s = with_ewm_mean(s, "sa", F.col("part"), alpha_of(halflife=5), ["theme"], "day")
    s = with_ewm_mean(s, "sb", F.col("d") - F.col("part"), alpha_of(halflife=5), ["theme"], "day")
    part = lambda c: rnd(F.when(F.col("z") != 0, F.col(c) / F.col("sd")).otherwise(0.0), 4)
    return s.select("theme", "day", part("sa").alias("deadline"), part("sb").alias("other"), rnd("z", 4).alias("full"))
