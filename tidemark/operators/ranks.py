"""Exact running quantiles by refinement of counts.

Values are numbered by narrow cells of a logarithmic scale, cells within cells: 32 an octave,
then 64 in each of those, and so on until the wanted cells hold few values.  For every point
in time, running counts over the cells say in which cell the wanted rank lies; only the
values of such cells are counted at the next level, by cell and time, and of the last cells
the distinct values.  No frame grows with the series and no group holds values: a level has 64
counters for each wanted point, wherever the values lie.  The wanted cells are written between the levels,
so that their size is known: where it is small Spark broadcasts them, and the values are
filtered without a shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.files import written

#: cells an octave at the first level, and parts of a cell at each further one
OCTAVE, FANOUT = 32, 64
#: cells of up to so many values are not cut further, nor those of the last level, whose numbers fill a double's 53 bits
LEAF, DEEPEST = 1000, 5
_SHIFT = 1100  # above the largest and the smallest power of two of a double


def _cell(x: str, level: int):
    """Number of the cell of ``x`` at a level; grows with x."""
    size = F.when(F.col(x) == 0, 0.0).otherwise(F.signum(x) * F.least(F.log2(F.abs(x)) + _SHIFT, F.lit(2.0 * _SHIFT)))
    return F.floor(size * float(OCTAVE * FANOUT**level)).cast("long")


def _counted(probes: DataFrame, counts: DataFrame, by: Sequence[str], strict: bool) -> DataFrame:
    """Probes (by, at, ...) with __n: the counts (by, at, __c) of the same cell before ``at``, or up to it."""
    both = probes.withColumn("__probe", F.lit(True)).unionByName(counts.withColumn("__probe", F.lit(False)), allowMissingColumns=True)
    first = F.col("__probe") if not strict else ~F.col("__probe")  # False sorts before True
    order = Window.partitionBy(*by).orderBy("at", first).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("__n", F.sum(F.coalesce("__c", F.lit(0))).over(order))
    return both.where("__probe and __n > 0").drop("__probe", "__c", "__size")


def _picked(probes: DataFrame, by: Sequence[str], cell: str) -> DataFrame:
    """Of the probes of one wanted rank the cell that holds it, with the rank within."""
    w = Window.partitionBy(*by).orderBy(cell).rowsBetween(Window.unboundedPreceding, 0)
    below = probes.withColumn("__below", F.sum("__n").over(w) - F.col("__n"))
    inside = below.where((F.col("__rank") >= F.col("__below")) & (F.col("__rank") < F.col("__below") + F.col("__n")))
    return inside.withColumn("__rank", F.col("__rank") - F.col("__below")).withColumn("__size", F.col("__n")).drop("__below", "__n")


def running_quantile(values: DataFrame, points: DataFrame, keys: Sequence[str], at: str, x: str, q: float, strict: bool) -> DataFrame:
    """(keys, at, n, quantile): the q-quantile of ``x`` over the key's values before each point (``strict``) or up to it.

    ``values`` (keys, at, x) and ``points`` (keys, at) may repeat; the quantile lies between the two middle values in
    proportion.  Nulls and NaN are no values; points without values and null keys give no row.  ``values`` are read once a level and should be a written table.
    """
    keys = list(keys)
    base = values.where(F.col(x).isNotNull() & ~F.isnan(x)).select(*keys, F.col(at).alias("at"), F.col(x).cast("double").alias("__x"))
    points = points.select(*keys, F.col(at).alias("at")).distinct()

    counts = base.groupBy(*keys, _cell("__x", 0).alias("__part"), "at").agg(F.count("*").alias("__c"))
    probes = points.join(counts.select(*keys, "__part").distinct(), keys)  # points x cells of the key, whatever the rows
    found = _counted(probes, counts, [*keys, "__part"], strict)
    total = F.sum("__n").over(Window.partitionBy(*keys, "at"))
    place = (F.col("__all") - 1) * q
    ranks = F.array_distinct(F.array(F.floor(place), F.ceil(place)))
    found = found.withColumn("__all", total).withColumn("__rank", F.explode(ranks))
    weight = 1 - F.abs(F.col("__rank") - place)
    found = found.withColumn("__slot", F.col("__rank")).withColumn("__w", weight)
    wanted = written(_picked(found, [*keys, "at", "__slot"], "__part"), "wanted-cells")

    level = 0
    largest = F.max(F.when(F.col("__part") != 0, F.col("__size")))  # cell 0 holds zeros alone
    while level < DEEPEST and (wanted.agg(largest).head()[0] or 0) > LEAF:
        level += 1
        some = base.withColumn("__part", _cell("__x", level - 1)).join(wanted.select(*keys, "__part").distinct(), [*keys, "__part"], "left_semi")
        counts = some.groupBy(*keys, _cell("__x", level).alias("__part"), "at").agg(F.count("*").alias("__c"))
        digits = F.explode(F.sequence(F.lit(0), F.lit(FANOUT - 1)))
        probes = wanted.withColumn("__digit", digits).withColumn("__part", F.col("__part") * FANOUT + F.col("__digit")).drop("__digit")
        wanted = written(_picked(_counted(probes, counts, [*keys, "__part"], strict), [*keys, "at", "__slot"], "__part"), "wanted-cells")

    some = base.withColumn("__part", _cell("__x", level)).join(wanted.select(*keys, "__part").distinct(), [*keys, "__part"], "left_semi")
    counts = some.groupBy(*keys, "__part", "__x", "at").agg(F.count("*").alias("__c"))
    probes = wanted.join(counts.select(*keys, "__part", "__x").distinct(), [*keys, "__part"])
    last = _picked(_counted(probes, counts, [*keys, "__part", "__x"], strict), [*keys, "at", "__slot"], "__x")
    return last.groupBy(*keys, F.col("at").alias(at)).agg(F.max("__all").alias("n"), F.sum(F.col("__x") * F.col("__w")).alias("quantile"))
