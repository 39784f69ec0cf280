"""Seeded resampling as tables: every draw is a key, so all draws run as one job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.common import hash_int, hash_key
from tidemark.sources.files import written


def runs(df: DataFrame, n: int, name: str = "seed") -> DataFrame:
    """The rows once for each run 0 .. n - 1."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def shuffle_within_month(rows: DataFrame, n: int, keys: Sequence[str], day: str, value: str) -> DataFrame:
    """For each seed the values permuted inside their month: (seed, keys, day, value)."""
    r = runs(rows.select(*keys, day, value).withColumn("__m", F.trunc(day, "month")), n)
    by = Window.partitionBy("seed", *keys, "__m")
    place = r.withColumn("__k", F.row_number().over(by.orderBy(day))).drop(value)
    order = hash_key("shuffle", "seed", *keys, day)
    drawn = r.withColumn("__k", F.row_number().over(by.orderBy(order))).select("seed", *keys, "__m", "__k", value)
    return place.join(drawn, ["seed", *keys, "__m", "__k"]).select("seed", *keys, day, value)


def block_bootstrap(rows: DataFrame, draws: int, block: int, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """(keys, draw, n, total, squares): count, sum and sum of squares of each draw of moving blocks.

    A draw has blocks from hashed starts, the last one cut to the length of the series; series of under two blocks give none.
    A block's sums are differences of running sums, so that a draw costs a row for each block and no value is repeated.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    x = F.col(value)
    s = rows.select(*keys, F.row_number().over(w).alias("i"), F.sum(x).over(upto).alias("s1"), F.sum(x * x).over(upto).alias("s2"))
    s = written(s, "running-sums")
    size = s.groupBy(*keys).agg(F.count("*").cast("int").alias("t")).where(F.col("t") >= 2 * block)
    blocks = (
        size.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
        .withColumn("b", F.explode(F.sequence(F.lit(0), F.floor((F.col("t") - 1) / block).cast("int"))))
        .withColumn("start", (hash_int("boot", *keys, "draw", "b") % (F.col("t") - block + 1)).cast("int"))
        .withColumn("len", F.least(F.lit(block), F.col("t") - F.col("b") * block))
    )
    # both ends of a block look up their running sums; the place before the first row is 0
    ends = F.array(F.struct((F.col("start") + F.col("len")).alias("i"), F.lit(1).alias("side")), F.struct(F.col("start").alias("i"), F.lit(-1).alias("side")))
    at = blocks.select(*keys, "draw", "len", F.inline(ends)).where("i > 0").join(s, [*keys, "i"])
    return at.groupBy(*keys, "draw").agg(
        F.sum(F.when(F.col("side") == 1, F.col("len"))).alias("n"),
        F.sum(F.col("side") * F.col("s1")).alias("total"),
        F.sum(F.col("side") * F.col("s2")).alias("squares"),
    )


def sharpe_of_sums(year: float = 252.0) -> Column:
    """Annual Sharpe ratio from n, total and squares."""
    n, mean = F.col("n"), F.col("total") / F.col("n")
    var = (F.col("squares") - n * mean * mean) / (n - 1)
    return mean / F.when(var > 0, F.sqrt(var)) * F.lit(year) ** 0.5
