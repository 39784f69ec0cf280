"""Seeded samples of groups by smallest hashes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.common import hash_key


def bottom_k(rows: DataFrame, strata: Sequence[str], key: Sequence[str], k: int, seed: str) -> DataFrame:
    """The ``k`` rows with the smallest hashes of each stratum, with their rank (__k).

    A limit on the rank goes below the exchange, so a task sends on at most k rows of a stratum and none is sorted as a whole.
    """
    by = Window.partitionBy(*strata).orderBy(hash_key(seed, *key), *key)
    return rows.withColumn("__k", F.row_number().over(by)).where(F.col("__k") <= k)


def stratified_sample(rows: DataFrame, stratum: str, event: str, market: str, volume: str, floor: float, n: int, seed: str) -> DataFrame:
    """(item, stratum, event, market): ``n`` events of each stratum with ``floor`` of volume at least, one market of each, in shuffled order.

    rows: one for each market, with the volume of its own; an event counts in every stratum that one of its markets has.
    """
    volumes = rows.groupBy(event).agg(F.sum(volume).alias("__v")).where(F.col("__v") >= floor).select(event)
    events = rows.select(stratum, event).distinct().join(volumes, event, "left_semi")
    taken = bottom_k(events, [stratum], [event], n, f"{seed}-event").select(stratum, event)
    # a market of the event, whatever its own stratum
    markets = bottom_k(rows.select(event, market).join(taken.select(event).distinct(), event, "left_semi"), [event], [market], 1, f"{seed}-market").select(event, market)
    both = taken.join(markets, event)
    item = F.row_number().over(Window.orderBy(hash_key(f"{seed}-item", stratum, event), stratum, event))  # n rows a stratum
    return both.select(item.alias("item"), stratum, event, market)
