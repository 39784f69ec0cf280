"""Registry shared by the query modules: a Spark query and its DuckDB counterpart under one key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(key: str, oracle: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``key``, with SQL for the same rows if there is any."""

    def add(fn):
        if key in QUERIES:
            raise ValueError(f"query {key} is registered twice")
        QUERIES[key] = fn
        if oracle:
            ORACLES[key] = oracle
        return fn

    return add
