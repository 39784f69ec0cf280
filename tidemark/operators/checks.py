"""Checks that stop a run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def duplicates(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, n): keys that occur more than once; null keys count as a key."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def require_unique(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows, or a ValueError that names some of the keys that occur more than once."""
    found = duplicates(rows, keys).limit(5).collect()
    if found:
        raise ValueError(f"{', '.join(keys)} should be unique, but occur more than once: " + "; ".join(str(tuple(r[k] for k in keys)) for r in found))
    return rows
