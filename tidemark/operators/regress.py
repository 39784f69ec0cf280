"""Regressions from distributed moments: Spark sums products, small systems are solved on the driver."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.files import written


def within(rows: DataFrame, entity: str, columns: Sequence[str]) -> DataFrame:
    """Columns less their entity means (fixed effects)."""
    by = Window.partitionBy(entity)
    return rows.select(*[c for c in rows.columns if c not in columns], *[(F.col(c) - F.avg(c).over(by)).alias(c) for c in columns])


def gram(rows: DataFrame, y: str, xs: Sequence[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """X'X, X'y and n; k * k numbers come to the driver."""
    cells = [F.sum(F.col(a) * F.col(b)).alias(f"g{i}_{j}") for i, a in enumerate(xs) for j, b in enumerate([*xs, y]) if j >= i]
    r = rows.agg(F.count("*").alias("n"), *cells).first()
    k = len(xs)
    g = np.zeros((k, k))
    xy = np.zeros(k)
    for i in range(k):
        for j in range(i, k):
            g[i, j] = g[j, i] = r[f"g{i}_{j}"] or 0.0
        xy[i] = r[f"g{i}_{k}"] or 0.0
    return g, xy, r["n"]


def independent(g: np.ndarray, tol: float = 1e-9) -> list[int]:
    """Columns that are not (nearly) combinations of earlier ones."""
    keep: list[int] = []
    for j in range(len(g)):
        if g[j, j] <= tol:
            continue
        rest = g[j, j]
        if keep:
            sub = g[np.ix_(keep, keep)]
            rest -= g[j, keep] @ np.linalg.solve(sub, g[keep, j])
        if rest > tol * g[j, j]:
            keep.append(j)
    return keep


def bandwidth(t: int) -> int:
    return int(4 * (t / 100) ** (2 / 9))


def panel_fit(rows: DataFrame, entity: str, time: str, y: str, xs: Sequence[str], lags: int | None = None) -> list[dict]:
    """Entity fixed effects with Driscoll-Kraay standard errors: coef, se, t, p and n of each kept regressor.

    Scores are summed by time, and their lagged products with Bartlett weights are a join of
    the time series with itself on the distance of ordinals.
    """
    w = written(within(rows.select(entity, time, y, *xs).dropna(), entity, [y, *xs]), "within")  # read for the moments and for the scores
    g, xy, n = gram(w, y, xs)
    keep = independent(g)
    names = [xs[i] for i in keep]
    if not names:
        return []
    inverse = np.linalg.inv(g[np.ix_(keep, keep)])
    beta = inverse @ xy[keep]
    residual = F.col(y) - sum((F.col(c) * float(b) for c, b in zip(names, beta)), F.lit(0.0))
    scores = w.withColumn("__e", residual).groupBy(time).agg(*[F.sum(F.col(c) * F.col("__e")).alias(c) for c in names])
    scores = scores.withColumn("__i", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(time)))  # a row a day
    t = scores.count()
    lags = bandwidth(t) if lags is None else lags
    a = scores.select("__i", *[F.col(c).alias(f"a{i}") for i, c in enumerate(names)])
    b = scores.select(F.explode(F.sequence(F.lit(0), F.lit(lags))).alias("__l"), "__i", *[F.col(c).alias(f"b{i}") for i, c in enumerate(names)])
    both = a.join(b.withColumn("__i", F.col("__i") + F.col("__l")), "__i")
    weight = F.when(F.col("__l") == 0, 1.0).otherwise(1 - F.col("__l") / (lags + 1))
    sums = both.agg(*[F.sum(weight * F.col(f"a{i}") * F.col(f"b{j}")).alias(f"s{i}_{j}") for i in range(len(names)) for j in range(len(names))]).first()
    zero = both.where("__l = 0").agg(*[F.sum(F.col(f"a{i}") * F.col(f"b{j}")).alias(f"s{i}_{j}") for i in range(len(names)) for j in range(len(names))]).first()
    k = len(names)
    s = np.array([[sums[f"s{i}_{j}"] for j in range(k)] for i in range(k)])
    s0 = np.array([[zero[f"s{i}_{j}"] for j in range(k)] for i in range(k)])
    meat = s + s.T - s0
    cov = inverse @ meat @ inverse
    se = np.sqrt(np.maximum(np.diag(cov), 0))
    return [
        {"regressor": c, "coef": float(b), "se": float(e), "t": float(b / e) if e else None, "p": math.erfc(abs(b / e) / math.sqrt(2)) if e else None, "n": n}
        for c, b, e in zip(names, beta, se)
    ]


def simple_ols(keys: Sequence[str], y: str, x: str) -> list[Column]:
    return [F.regr_slope(y, x).alias("beta"), F.regr_intercept(y, x).alias("alpha"), F.regr_r2(y, x).alias("r2"), F.regr_count(y, x).alias("n")]


def newey_west(rows: DataFrame, keys: Sequence[str], order: str, y: str, x: str, lags: int) -> DataFrame:
    """Per group: beta, alpha and the Newey-West t of beta with ``lags`` lags."""
    by = Window.partitionBy(*keys)
    r = rows.dropna(subset=[y, x])
    r = r.withColumn("__b", F.regr_slope(y, x).over(by)).withColumn("__a", F.regr_intercept(y, x).over(by)).withColumn("__mx", F.avg(x).over(by))
    r = r.withColumn("__u", (F.col(x) - F.col("__mx")) * (F.col(y) - F.col("__a") - F.col("__b") * F.col(x)))
    ordered = by.orderBy(order)
    meat = F.col("__u") * F.col("__u")
    for l in range(1, lags + 1):
        meat = meat + 2 * (1 - l / (lags + 1)) * F.col("__u") * F.coalesce(F.lag("__u", l).over(ordered), F.lit(0.0))
    r = r.withColumn("__m", meat).withColumn("__d", (F.col(x) - F.col("__mx")) * (F.col(x) - F.col("__mx")))
    g = r.groupBy(*keys).agg(F.first("__b").alias("beta"), F.first("__a").alias("alpha"), F.count("*").alias("n"), (F.sqrt(F.sum("__m")) / F.sum("__d")).alias("se"))
    return g.withColumn("t", F.col("beta") / F.col("se"))


def newey_west_auto(rows: DataFrame, keys: Sequence[str], order: str, y: str, x: str, least: int = 3) -> DataFrame:
    """Per group: n, lags = floor(4 (n / 100) ** (2 / 9)), beta, alpha, their Newey-West t, corr and r2.

    Lagged products are a join of the rows with themselves on the distance of their ordinals, up to the group's own lags.
    """
    by = Window.partitionBy(*keys)
    r = rows.dropna(subset=[y, x]).select(*keys, F.col(order).alias("__o"), F.col(y).alias("__y"), F.col(x).alias("__x"))
    fit = r.groupBy(*keys).agg(
        F.count("*").alias("n"), F.regr_slope("__y", "__x").alias("beta"), F.regr_intercept("__y", "__x").alias("alpha"),
        F.corr("__y", "__x").alias("corr"), F.regr_r2("__y", "__x").alias("r2"), F.sum("__x").alias("__sx"), F.sum(F.col("__x") * F.col("__x")).alias("__sxx"),
    ).where(F.col("n") >= least)
    fit = fit.withColumn("lags", F.floor(4 * F.pow(F.col("n") / 100.0, F.lit(2 / 9))).cast("int"))
    e = r.withColumn("__i", F.row_number().over(by.orderBy("__o"))).join(fit, list(keys))
    e = e.withColumn("__e", F.col("__y") - F.col("alpha") - F.col("beta") * F.col("__x")).withColumn("__g", F.col("__x") * F.col("__e"))
    late = e.select(*keys, F.col("__e").alias("__e2"), F.col("__g").alias("__g2"), "lags", "__i", F.explode(F.sequence(F.lit(0), F.col("lags"))).alias("__l"))
    late = late.withColumn("__i", F.col("__i") + F.col("__l"))
    both = e.select(*keys, "__i", "__e", "__g").join(late, [*keys, "__i"])
    w = F.when(F.col("__l") == 0, 0.5).otherwise(1 - F.col("__l") / (F.col("lags") + 1))  # each product counts both ways round
    s = both.groupBy(*keys).agg(
        F.sum(2 * w * F.col("__e") * F.col("__e2")).alias("__s00"),
        F.sum(w * (F.col("__e") * F.col("__g2") + F.col("__g") * F.col("__e2"))).alias("__s01"),
        F.sum(2 * w * F.col("__g") * F.col("__g2")).alias("__s11"),
    )
    n, sx, sxx, s00, s01, s11 = (F.col(c) for c in ("n", "__sx", "__sxx", "__s00", "__s01", "__s11"))
    d = n * sxx - sx * sx
    out = fit.join(s, list(keys))
    out = out.withColumn("t", F.col("beta") / (F.sqrt(sx * sx * s00 - 2 * sx * n * s01 + n * n * s11) / d))
    out = out.withColumn("t_alpha", F.col("alpha") / (F.sqrt(sxx * sxx * s00 - 2 * sxx * sx * s01 + sx * sx * s11) / d))
    return out.select(*keys, "n", "lags", "beta", "t", "alpha", "t_alpha", "corr", "r2")


def panel_slopes(rows: DataFrame, keys: Sequence[str], entity: str, time: str, y: str, x: str, lags: str) -> DataFrame:
    """Per group of ``keys``: slope of y on x within entities, its Driscoll-Kraay standard error and t, and n.

    ``lags`` is a column that is constant in a group.  Everything stays on the cluster: scores are summed by
    time, and lagged products are a join on the distance of ordinals.
    """
    keys = list(keys)
    by = Window.partitionBy(*keys, entity)
    r = rows.dropna(subset=[y, x]).select(*keys, time, F.col(lags).alias("__lags"), (F.col(y) - F.avg(y).over(by)).alias("__y"), (F.col(x) - F.avg(x).over(by)).alias("__x"))
    fit = r.groupBy(*keys).agg(
        F.sum(F.col("__x") * F.col("__x")).alias("__xx"), F.sum(F.col("__x") * F.col("__y")).alias("__xy"), F.count("*").alias("n"), F.max("__lags").alias("__lags")
    )
    fit = fit.where(F.col("__xx") > 1e-18).withColumn("coef", F.col("__xy") / F.col("__xx"))
    h = r.drop("__lags").join(fit, keys).groupBy(*keys, time, "__lags").agg(F.sum(F.col("__x") * (F.col("__y") - F.col("coef") * F.col("__x"))).alias("__h"))
    h = h.withColumn("__i", F.row_number().over(Window.partitionBy(*keys).orderBy(time)))
    late = h.select(*keys, "__lags", F.col("__h").alias("__h2"), "__i", F.explode(F.sequence(F.lit(0), F.col("__lags"))).alias("__l")).withColumn("__i", F.col("__i") + F.col("__l"))
    both = h.select(*keys, "__i", "__h").join(late, [*keys, "__i"])
    w = F.when(F.col("__l") == 0, 1.0).otherwise(2 * (1 - F.col("__l") / (F.col("__lags") + 1)))
    meat = both.groupBy(*keys).agg(F.sum(w * F.col("__h") * F.col("__h2")).alias("__s"))
    out = fit.join(meat, keys).withColumn("se", F.sqrt(F.greatest("__s", F.lit(0.0))) / F.col("__xx"))
    return out.select(*keys, "coef", "se", (F.col("coef") / F.when(F.col("se") > 0, F.col("se"))).alias("t"), "n")


def chi2_tail(x: float, df: int) -> float:
    """P(chi-squared with ``df`` degrees > x), by the finite sums for whole degrees."""
    half = x / 2
    if df % 2 == 0:
        term, total = math.exp(-half), 0.0
        for i in range(df // 2):
            total += term
            term *= half / (i + 1)
        return total
    total, term = math.erfc(math.sqrt(half)), math.exp(-half) * math.sqrt(half) / math.gamma(1.5)
    for i in range((df - 1) // 2):
        total += term
        term *= half / (i + 1.5)
    return total


def wald_equal_slopes(rows: DataFrame, entity: str, time: str, y: str, x: str, lags: int | None = None, most: int = 500) -> dict:
    """Wald test that all entities have one slope: n, wald, p.  Over ``most`` entities are refused, as every two of them are a cell of a matrix.

    Entities enter by interactions with fixed effects, so each slope comes from its own rows; the covariance is
    Driscoll-Kraay's.  Products of entities (one number a pair) come to the driver.  Entities without variance go.
    """
    by = Window.partitionBy(entity)
    r = rows.dropna(subset=[y, x]).select(entity, time, (F.col(y) - F.avg(y).over(by)).alias("__y"), (F.col(x) - F.avg(x).over(by)).alias("__x"))
    fit = r.groupBy(entity).agg(F.sum(F.col("__x") * F.col("__x")).alias("__xx"), F.sum(F.col("__x") * F.col("__y")).alias("__xy")).where("__xx > 1e-18")
    fit = written(fit.withColumn("__b", F.col("__xy") / F.col("__xx")), "slopes")
    if (n := fit.count()) > most:
        raise ValueError(f"{n} entities are too many for a test of equal slopes, at most {most}")
    slopes = {e[entity]: (e["__b"], e["__xx"]) for e in fit.collect()}
    names = sorted(slopes)
    if len(names) < 2:
        return {"n": len(names), "wald": None, "p": None}
    h = r.join(fit, entity).groupBy(entity, time).agg(F.sum(F.col("__x") * (F.col("__y") - F.col("__b") * F.col("__x"))).alias("__h"))
    h = written(h, "entity-scores")
    days = h.select(time).distinct().withColumn("__i", F.row_number().over(Window.orderBy(time)))  # a row a day
    h = h.join(days, time).select(entity, "__i", "__h")
    lags = bandwidth(days.count()) if lags is None else lags
    late = h.select(F.col(entity).alias("__q"), F.col("__h").alias("__h2"), "__i", F.explode(F.sequence(F.lit(0), F.lit(lags))).alias("__l")).withColumn("__i", F.col("__i") + F.col("__l"))
    w = F.when(F.col("__l") == 0, 0.5).otherwise(1 - F.col("__l") / (lags + 1))
    cells = h.join(late, "__i").groupBy(F.col(entity).alias("__p"), "__q").agg(F.sum(w * F.col("__h") * F.col("__h2")).alias("s")).collect()
    at = {n: i for i, n in enumerate(names)}
    s = np.zeros((len(names), len(names)))
    for c in cells:
        s[at[c["__p"]], at[c["__q"]]] = c["s"]
    xx = np.array([slopes[n][1] for n in names])
    v = (s + s.T) / np.outer(xx, xx)
    d = np.diff(np.array([slopes[n][0] for n in names]))
    m = np.diff(np.diff(v, axis=0), axis=1)
    wald = float(d @ np.linalg.pinv(m) @ d)
    return {"n": len(names), "wald": wald, "p": chi2_tail(wald, len(names) - 1)}
