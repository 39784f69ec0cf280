"""Column helpers: null-safe clipping, rounding for reports, seeded hashes, time-zone arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rnd(c: str | Column, digits: int = 6) -> Column:
    """Rounded double without a negative zero."""
    return F.round(col(c).cast("double"), digits) + F.lit(0.0)


def clip(c: str | Column, low: float, high: float) -> Column:
    """Winsorised value; null stays null (``greatest`` and ``least`` skip nulls)."""
    c = col(c)
    return F.when(c.isNotNull(), F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), c)))


def hash_key(seed: str, *keys: str | Column) -> Column:
    """Reproducible order of a key under a seed: md5 of seed|key|..."""
    return F.md5(F.concat_ws("|", F.lit(seed), *[col(k).cast("string") for k in keys]))


def hash_int(seed: str, *keys: str | Column) -> Column:
    """Uniform integer in [0, 2**32) of a key under a seed."""
    return F.conv(F.substring(hash_key(seed, *keys), 1, 8), 16, 10).cast("long")


def local_time(ts: str | Column, zone: str) -> Column:
    """UTC timestamp to wall time in ``zone`` (per row, so summer time is right)."""
    return F.from_utc_timestamp(col(ts), zone)


def second_of_day(ts: Column) -> Column:
    return F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def seconds_between(a: str | Column, b: str | Column) -> Column:
    return F.unix_seconds(col(b).cast("timestamp")) - F.unix_seconds(col(a).cast("timestamp"))


def hazard(p: str | Column, years: str | Column) -> Column:
    """Constant hazard rate of an event with probability ``p`` over ``years``; p is kept off 0 and 1."""
    return -F.log(1 - clip(p, 0.001, 0.999)) / col(years)


def word_number(c: str | Column) -> Column:
    """Number written in digits or as an English word up to ten."""
    words = "one two three four five six seven eight nine ten".split()
    table = F.create_map(*[x for i, w in enumerate(words, 1) for x in (F.lit(w), F.lit(i))])
    w = F.lower(col(c))
    return F.when(w.rlike("^[0-9]+$"), w.cast("int")).otherwise(F.element_at(table, w))
