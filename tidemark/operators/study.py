"""Robustness studies: a run is a linear combination of sums by event and day, so rows are read once for all runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.common import hash_int
from tidemark.operators.resample import runs as with_seeds
from tidemark.operators.shocks import cell_signal

#: (run, kind, p, h): ``sign`` multiplies changes by p, ``equal`` weighs rows equally, ``random`` takes contracts that are not
#: used with random signs, ``volume`` keeps rows of at least p, ``without`` leaves event p out; other kinds change nothing
Run = tuple[str, str, float, float]


def _part(run: Run) -> tuple:
    """What tells the row sums of one run from another's; runs with the same part share their sums."""
    name, kind, p, _ = run
    return (kind, p) if kind == "volume" else (kind, name) if kind == "random" else (kind,) if kind == "equal" else ()


def event_days(rows: DataFrame, runs: Sequence[Run], used: Column, event: str = "event_no", key: str = "contract_id", day: str = "day", volume: str = "vol1d") -> DataFrame:
    """(event, day, volume, a0, w0, n0, a1, ...): sums of weighted changes, weights and rows for every part of ``runs``.

    rows: one for each contract and day, with z, vol7d and ``volume``.  The only step that reads rows; its size is events by days.
    """
    sums = [F.sum(F.when(used, F.col(volume))).alias("volume")]
    for i, part in enumerate(_parts(runs)):
        kind = part[0] if part else "actual"
        take = F.col("z").isNotNull() & F.coalesce(~used if kind == "random" else used, F.lit(False))
        if kind == "volume":
            take = take & (F.col("vol7d") >= part[1])
        z = F.col("z")
        if kind == "random":
            z = z * F.when(hash_int("placebo", F.lit(part[1]), key) % 2 == 0, 1.0).otherwise(-1.0)
        w = F.lit(1.0) if kind == "equal" else F.col("vol7d")
        sums += [F.sum(F.when(take, z * w)).alias(f"a{i}"), F.sum(F.when(take, w)).alias(f"w{i}"), F.count(F.when(take, 1)).alias(f"n{i}")]
    return rows.groupBy(F.col(event).alias("event"), F.col(day).alias("day")).agg(*sums)


def _parts(runs: Sequence[Run]) -> list[tuple]:
    """The parts of the runs; the first is the plain one, which runs without an event are taken from."""
    return list(dict.fromkeys([(), *map(_part, runs)]))


def top_events(sums: DataFrame, n: int) -> list:
    """The ``n`` events with the largest volume of used rows; n values come to the driver."""
    g = sums.where("volume is not null").groupBy("event").agg(F.round(F.sum("volume"), 6).alias("v"))
    return [r["event"] for r in g.orderBy(F.desc("v"), "event").limit(n).collect()]


def run_signals(sums: DataFrame, runs: Sequence[Run], longest: float, min_events: int = 1, removed: Sequence = ()) -> DataFrame:
    """(run, day, d, n_contracts, z): the composite of every run on every day from the first to the last, and its signal.

    ``sums`` as made by ``event_days`` for the same runs.  A run without an event (``removed``) is the total less the event's own sums; what is left
    of the weights counts as nothing where it is within rounding of 0.
    """
    parts = {part: i for i, part in enumerate(_parts(runs))}
    out = [F.col("day")]
    for i in parts.values():
        out += [F.sum(f"{c}{i}").alias(f"{c}{i}") for c in "awn"] + [F.count(F.when(F.col(f"n{i}") > 0, 1)).alias(f"e{i}")]
    for k, e in enumerate(removed):
        own = F.col("event") == F.lit(e)
        out += [F.coalesce(F.sum(F.when(own, F.col(f"{c}0"))), F.lit(0)).alias(f"own_{c}{k}") for c in "awn"]
    totals = sums.groupBy("day").agg(*out[1:])
    span = sums.agg(F.min("day").alias("a"), F.max("day").alias("b")).where("a is not null")
    calendar = span.select(F.explode(F.sequence("a", "b", F.expr("INTERVAL 1 DAY"))).alias("day"))

    def struct(run, h, a, w, n, events):
        known = F.coalesce((n > 0) & (events >= min_events), F.lit(False))
        d = F.coalesce(F.when(known, a / F.when(w != 0, w)), F.lit(0.0))
        return F.struct(F.lit(run).alias("run"), F.lit(float(h)).alias("h"), d.alias("d"), F.when(known, n).otherwise(0).alias("n_contracts"))

    every = []
    for run in runs:
        i = parts[_part(run)]
        a, w, n, events = (F.col(f"{c}{i}") for c in "awne")
        every.append(struct(run[0], run[3], a * (run[2] if run[1] == "sign" else 1.0), w, n, events))
    for k, e in enumerate(removed):
        a, w, n = (F.col(f"{c}0") - F.col(f"own_{c}{k}") for c in "awn")
        w = F.when(F.abs(w) > 1e-9 * F.col("w0"), w)
        every.append(struct(f"without:{e}", 5.0, a, w, n, F.col("e0") - F.when(F.col(f"own_n{k}") > 0, 1).otherwise(0)))
    dense = calendar.join(totals, "day", "left").select("day", F.inline(F.array(*every)))
    return cell_signal(dense, ["run"], F.col("h"), longest).select("run", "day", "d", "n_contracts", "z")


def with_shuffles(signals: DataFrame, n: int, run: str = "actual") -> DataFrame:
    """Adds ``n`` runs in which the signal of ``run`` is dealt anew within each month."""
    base = signals.where(F.col("run") == run).select("day", "z", F.trunc("day", "month").alias("__m"))
    r = with_seeds(base, n + 1).where("seed > 0")
    by = Window.partitionBy("seed", "__m")
    place = r.withColumn("__k", F.row_number().over(by.orderBy("day"))).drop("z")
    drawn = r.withColumn("__k", F.row_number().over(by.orderBy(hash_int("deal", "seed", "day"), "day"))).select("seed", "__m", "__k", "z")
    dealt = place.join(drawn, ["seed", "__m", "__k"]).select(F.concat(F.lit("shuffle:"), "seed").alias("run"), "day", "z")
    return signals.select("run", "day", "z").unionByName(dealt)


def run_returns(signals: DataFrame, market: DataFrame, hold: int = 1) -> DataFrame:
    """(run, day, r): yesterday's position times today's market return; positions change every ``hold`` days.

    market (day, m) is put beside the signal by the ordinal of its days.
    """
    by = Window.partitionBy("run").orderBy("day")
    s = signals.withColumn("j", F.row_number().over(by))
    s = s.withColumn("__pos", F.last(F.when((F.col("j") - 1) % hold == 0, F.col("z")), True).over(by))
    days = market.withColumn("j", F.row_number().over(Window.orderBy("day")) - 1).select("j", "m")  # a row a day
    return s.join(days, "j").select("run", "day", (F.col("__pos") * F.col("m")).alias("r"))


def sharpe_by_run(returns: DataFrame) -> DataFrame:
    sd = F.stddev_samp("r")
    return returns.groupBy("run").agg(F.count("r").alias("n"), (F.avg("r") / F.when(sd > 0, sd) * F.sqrt(F.lit(252.0))).alias("sharpe"))
