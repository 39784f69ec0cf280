"""Positions and P&L as long tables (strategy keys, day, asset, weight, return)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cap_weights(rows: DataFrame, keys: Sequence[str], share: float | Column, gross_cap: float, w: str = "w") -> DataFrame:
    """Clip every weight to ``share`` of the gross, then scale to the gross cap; adds which caps bind."""
    by = Window.partitionBy(*keys)
    gross = F.sum(F.abs(w)).over(by)
    out = rows.withColumn("__limit", share * gross).withColumn("name_cap", F.abs(w) > F.col("__limit"))
    out = out.withColumn("w1", F.greatest(-F.col("__limit"), F.least(F.col("__limit"), F.col(w))))
    after = F.sum(F.abs("w1")).over(by)
    out = out.withColumn("__after", after).withColumn("gross_cap", F.col("__after") > gross_cap)
    scale = F.when(F.col("gross_cap"), gross_cap / F.col("__after")).otherwise(1.0)
    return out.withColumn("capped", F.col("w1") * scale).drop("__limit", "__after", "w1")


def _leaves(held: float, targets: np.ndarray, band: float) -> np.ndarray:
    """Which targets a held position is given up for."""
    return (targets == 0) | (np.abs(targets - held) > band * abs(held)) if held else np.ones(len(targets), bool)


def _transfer(targets: np.ndarray, band: float) -> tuple[list[int], list[float], list[float]]:
    """What a chunk makes of any position held before it: (place, target, end) of the targets that can be the first to change it.

    The first target beyond the band on either side is a new highest or lowest one, or a 0; an unknown start is changed by
    the first.  ``end`` is the position after the chunk if the target at ``place`` was taken.
    """
    n, end = len(targets), targets.copy()
    for i in range(n - 2, -1, -1):
        out = np.flatnonzero(_leaves(targets[i], targets[i + 1 :], band))
        if len(out):
            end[i] = end[i + 1 + out[0]]
    first_zero = np.zeros(n, bool)
    first_zero[np.flatnonzero(targets == 0)[:1]] = True
    before = np.maximum.accumulate(targets), np.minimum.accumulate(targets)
    record = first_zero | np.concatenate([[True], (targets[1:] > before[0][:-1]) | (targets[1:] < before[1][:-1])]) if n else first_zero
    at = np.flatnonzero(record)
    return at.tolist(), targets[at].tolist(), end[at].tolist()


def no_trade_band(rows: DataFrame, keys: Sequence[str], order: str, target: str, band: float, chunk: Column | None = None) -> DataFrame:
    """Adds held: the previous position is kept unless it is 0, the target is 0, or the move is over band * abs(previous).

    Each chunk of a key (years of ``order`` by default) tells which of its targets would end a position held before it and what
    position that leads to; these small tables are walked along the key, and then every chunk is walked from its start on.  A row
    without a target keeps the position (0 at first).  ``order`` should have no ties.
    """
    names = rows.columns
    rows = rows.withColumn("__chunk", F.year(order) if chunk is None else chunk)
    by = [*keys, "__chunk"]
    schema = rows.select(*keys).schema
    text = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    part = rows.select(*by, order, F.col(target).cast("double").alias("__t"))
    kind = dict(rows.dtypes)["__chunk"]

    def summary(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        at, targets, ends = _transfer(pdf.sort_values(order)["__t"].dropna().to_numpy(float), band)
        return pd.DataFrame([[*key, at, targets, ends]], columns=[*by, "at", "targets", "ends"])

    def starts(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out, held = [], 0.0
        for c, targets, ends in pdf.sort_values("__chunk")[["__chunk", "targets", "ends"]].itertuples(index=False):
            out.append([*key, c, held])
            left = np.flatnonzero(_leaves(held, np.asarray(targets, float), band))
            held = float(ends[left[0]]) if len(left) else held
        return pd.DataFrame(out, columns=[*by, "__start"])

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        targets = pdf["__t"].to_numpy(float)
        at, last = 0, float(pdf["__start"].iloc[0])
        known = np.flatnonzero(~np.isnan(targets))
        held = np.full(len(targets), last)
        while at < len(known):
            out = np.flatnonzero(_leaves(last, targets[known[at:]], band))
            if not len(out):
                break
            at += int(out[0])
            last = targets[known[at]]
            held[known[at] :] = last
            at += 1
        return pdf[names].assign(held=held)

    maps = part.groupBy(*by).applyInPandas(summary, f"{text}, __chunk {kind}, at array<int>, targets array<double>, ends array<double>")
    begun = maps.groupBy(*keys).applyInPandas(starts, f"{text}, __chunk {kind}, __start double")
    same = F.lit(True)
    for k in by:
        same = same & F.col(f"l.`{k}`").eqNullSafe(F.col(f"r.`{k}`"))
    joined = rows.withColumn("__t", F.col(target).cast("double")).alias("l").join(begun.alias("r"), same, "left").select("l.*", "r.__start")
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*names).schema)
    return joined.groupBy(*by).applyInPandas(walk, f"{out}, held double")


def waterfill(rows: DataFrame, keys: Sequence[str], w: str, cap: float, order: str) -> DataFrame:
    """Cap the shares of a leg and hand the rest out pro rata; equal weights where no such split exists.

    The names at the cap are the largest ones.  With m of them at the cap the others share 1 - m * cap
    in proportion; the smallest m for which nobody is left above the cap is the answer.
    """
    by = Window.partitionBy(*keys)
    big = by.orderBy(F.desc(w), order)
    r = rows.withColumn("__k", F.row_number().over(big)).withColumn("__n", F.count("*").over(by))
    rest = F.sum(w).over(big.rowsBetween(0, Window.unboundedFollowing))
    # with the k - 1 names before this one at the cap, this one would get
    r = r.withColumn("__rest", rest).withColumn("__gets", (1 - (F.col("__k") - 1) * cap) * F.col(w) / F.col("__rest"))
    fits = F.min(F.when(F.col("__gets") <= cap + 1e-12, F.col("__k"))).over(by)
    r = r.withColumn("__m", fits)
    base = F.max(F.when(F.col("__k") == F.col("__m"), F.col("__rest"))).over(by)
    free = (1 - (F.col("__m") - 1) * cap) * F.col(w) / base
    filled = F.when(F.col("__n") * cap < 1, 1.0 / F.col("__n")).when(F.col("__k") < F.col("__m"), F.lit(cap)).otherwise(free)
    return r.withColumn("filled", filled).drop("__k", "__n", "__rest", "__gets", "__m")


def position_pnl(rows: DataFrame, keys: Sequence[str], order: str, w: str = "w", r: str = "r", half_spread: float = 0.0002) -> DataFrame:
    """Adds pnl (weight of the row before times this return), dw and cost."""
    by = Window.partitionBy(*keys).orderBy(order)
    before = F.lag(w).over(by)
    dw = F.abs(F.col(w) - F.coalesce(before, F.lit(0.0)))
    return (
        rows.withColumn("pnl", F.coalesce(before * F.col(r), F.lit(0.0)))
        .withColumn("dw", dw)
        .withColumn("cost", F.col("dw") * half_spread)
    )


def timing_exposure(since: str | Column, target: float | Column, days: int | Column) -> Column:
    """Exposure ``since`` rows after a hit: cut to ``target``, back to 1 linearly over ``days``."""
    s = F.col(since) if isinstance(since, str) else since
    low = target if isinstance(target, Column) else F.lit(float(target))
    return F.when(s.isNull() | (s >= days), 1.0).otherwise(low + (1 - low) * s / days)


def leg_sizes(n: str | Column) -> Column:
    """Names in each leg of n ranked ones: a third, one at least."""
    n = F.col(n) if isinstance(n, str) else n
    return F.greatest(F.floor(n / 3), F.lit(1))
