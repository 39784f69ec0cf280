"""As-of joins by union and segmented scan: rows are dealt by key and month, no explosion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.scan import last_known


def asof_join(
    probes: DataFrame,
    rows: DataFrame,
    keys: Sequence[str],
    probe_at: str,
    row_at: str,
    values: Sequence[str],
    how: str = "le",
    ties: Sequence[str] = (),
    segment: str = "month",
    once: bool = False,
) -> DataFrame:
    """The probes with ``values`` (and ``row_at``) of one row of their key each, or nulls.

    how: ``le`` latest row at or before the probe, ``lt`` latest strictly before, ``ge``
    first at or after.  Of rows at equal times the last (``ge``: the first) by ``ties`` is taken, then by
    the values themselves, so that runs agree.  Keys are cut into ``segment``s of time, so that a key with many rows is spread.
    With ``once``, probes that are equal in all columns are one.  Null keys and times match nothing: such rows are not found, such
    probes find none.
    """
    side = {"le": 1, "lt": -1, "ge": -1}[how]
    found = F.struct(F.col(row_at).alias("at"), *[F.col(v) for v in values])
    tie = F.struct(*[F.col(t) for t in ties], *[F.col(v) for v in values if v not in ties], F.lit(0))
    p = probes.select(*[F.col(k) for k in keys], F.col(probe_at).alias("__at"), F.lit(side).alias("__side"), F.struct(*probes.columns).alias("__probe"))
    r = rows.select(*[F.col(k) for k in keys], F.col(row_at).alias("__at"), F.lit(0).alias("__side"), tie.alias("__tie"), found.alias("__found"))
    for c in ("__at", *keys):
        r = r.where(F.col(c).isNotNull())
    both = p.unionByName(r, allowMissingColumns=True)
    scanned = last_known(both, "__one", "__found", keys, ["__at", "__side", "__tie"], F.date_trunc(segment, F.col("__at").cast("timestamp")), how == "ge", "__probe" if once else None)
    scanned = scanned.withColumn("__one", F.when(F.col("__at").isNotNull(), F.col("__one")))
    return scanned.where(F.col("__probe").isNotNull()).select(
        "__probe.*", F.col("__one.at").alias(f"{row_at}_found"), *[F.col(f"__one.{v}").alias(v) for v in values]
    )


def on_calendar(series: DataFrame, calendar: DataFrame, keys: Sequence[str], value: str, day: str = "day") -> DataFrame:
    """The last known value of every series on every day of the calendar."""
    probes = series.select(*keys).distinct().crossJoin(calendar.select(day))  # one row a series and day is what is asked for
    return asof_join(probes, series.withColumnRenamed(day, "seen"), keys, day, "seen", [value])
