"""Rule-based labelling: ordered rule tables as native expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.common import word_number

#: (rule id, label, pattern)
Rule = tuple[str, str, str]


def first_match(text: str | Column, rules: Sequence[Rule]) -> tuple[Column, Column, Column]:
    """Label, rule id and matched text of the first rule whose pattern matches; nulls if none does."""
    t = F.col(text) if isinstance(text, str) else text
    label, rule, found = (F.lit(None).cast("string") for _ in range(3))
    for rule_id, name, pattern in reversed(rules):
        hit = t.rlike(pattern)
        label = F.when(hit, F.lit(name)).otherwise(label)
        rule = F.when(hit, F.lit(rule_id)).otherwise(rule)
        found = F.when(hit, F.regexp_extract(t, pattern, 0)).otherwise(found)
    return label, rule, found


def places(rows: DataFrame, key: str, text: str, gazetteer: DataFrame) -> DataFrame:
    """(key, places): dictionary entries (word, place) among the words of each text, sorted.

    A dictionary of any size will do; Spark broadcasts it if it is small.
    """
    words = rows.select(key, F.explode(F.split(F.lower(text), r"[^\w]+")).alias("word")).distinct()
    hits = words.join(gazetteer, "word").groupBy(key).agg(F.array_sort(F.collect_set("place")).alias("places"))
    return rows.select(key).join(hits, key, "left").withColumn("places", F.coalesce("places", F.array().cast("array<string>")))


def first_region(found: Column, regions: Sequence[tuple[str, Sequence[str]]], other: str = "OTHER") -> Column:
    """Name of the first region one of whose members was found."""
    out = F.lit(other)
    for name, members in reversed(regions):
        out = F.when(F.arrays_overlap(found, F.array(*[F.lit(m) for m in members])), F.lit(name)).otherwise(out)
    return out


def direction(text: str | Column, up: str, down: str) -> Column:
    t = F.col(text) if isinstance(text, str) else text
    return F.when(t.rlike(down), -1).when(t.rlike(up), 1).otherwise(0)


def number_in(text: str | Column, pattern: str, group: int = 1) -> Column:
    """Number in a group of the first match, null if there is none."""
    t = F.col(text) if isinstance(text, str) else text
    found = F.regexp_extract(t, pattern, group)
    return F.when(found != "", found.cast("double"))


def bracket(text: str | Column, pattern: str) -> Column:
    """Middle of the two numbers of a bracket."""
    return (number_in(text, pattern, 1) + number_in(text, pattern, 2)) / 2


def count_in(text: str | Column, pattern: str) -> Column:
    t = F.col(text) if isinstance(text, str) else text
    return word_number(F.nullif(F.regexp_extract(t, pattern, 1), F.lit("")))


def decision_bp(text: Column, suffix: str, by_suffix: dict[str, int], rules: Sequence[tuple[str, int]]) -> Column:
    """Basis points by the suffix's table, else by the first rule (pattern, factor) that matches.

    A rule with a group gives factor times the number in it, one without gives its factor.
    """
    table = F.create_map(*[F.lit(x) for p in by_suffix.items() for x in p])
    out = F.lit(None).cast("double")
    for pattern, factor in reversed(rules):
        value = number_in(text, pattern) * factor if "(" in pattern else F.lit(float(factor))
        out = F.when(text.rlike(pattern), value).otherwise(out)
    return F.coalesce(F.try_element_at(table, F.regexp_extract(text, suffix, 1)).cast("double"), out)


def mark_families(rows: DataFrame, event: str, families: Sequence[tuple[str, str, str | None]], direction: str) -> DataFrame:
    """Marks the buckets of partitioned events: adds partition, unit and bucket, and sets their direction to 0.

    families (unit, value column, threshold column), in order of priority: the first with two or more rows of two or
    more values in an event is the event's.  Rows of the event without a value, but with a threshold and a direction,
    are open ends: half the median gap of the distinct values above or below the threshold.
    """
    values = [F.struct(F.lit(i).alias("p"), F.lit(u).alias("unit"), F.col(v).cast("double").alias("v")) for i, (u, v, _) in enumerate(families)]
    long = rows.select(event, F.explode(F.array(*values)).alias("f")).select(event, "f.*").where("v is not null")
    by_value = long.groupBy(event, "p", "unit", "v").agg(F.count("*").alias("n"))
    gap = F.lead("v").over(Window.partitionBy(event, "p").orderBy("v")) - F.col("v")
    fit = by_value.withColumn("gap", gap).groupBy(event, "p", "unit").agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.percentile("gap", 0.5).alias("width"))
    best = fit.where("n >= 2 and k >= 2").groupBy(event).agg(F.min_by(F.struct("p", "unit", "width"), "p").alias("__f"))
    out = rows.join(best, event, "left")
    bucket = F.lit(None).cast("double")
    for i, (_, v, threshold) in enumerate(families):
        value = F.col(v).cast("double")
        if threshold:
            end = F.when(F.col(direction) != 0, F.col(threshold) + F.signum(F.col(direction).cast("double")) * F.col("__f.width") / 2)
            value = F.coalesce(value, end)
        bucket = F.when(F.col("__f.p") == i, value).otherwise(bucket)
    out = out.withColumn("bucket", bucket).withColumn("partition", F.col("bucket").isNotNull())
    out = out.withColumn("unit", F.when(F.col("partition"), F.col("__f.unit"))).drop("__f")
    return out.withColumn(direction, F.when(F.col("partition"), 0).otherwise(F.col(direction)))


def scores(rows: DataFrame, other: str) -> DataFrame:
    """Accuracy of theme, zone set and direction against true_theme, true_zones and true_direction, by true theme and in all (label null).

    Zones and directions count where the true theme isn't ``other``; a sign error is an opposite sign there.
    """
    macro = F.col("true_theme") != other
    share = lambda ok: F.round(F.avg(ok.cast("double")), 6)
    same_zones = F.array_sort(F.array_distinct("zones")) == F.array_sort(F.array_distinct("true_zones"))
    return rows.rollup(F.col("true_theme").alias("label")).agg(
        F.count("*").alias("n"),
        share(F.col("theme") == F.col("true_theme")).alias("theme"),
        share(F.when(macro, same_zones)).alias("zone"),
        share(F.when(macro, F.col("direction") == F.col("true_direction"))).alias("direction"),
        F.count_if(macro & (F.col("direction") * F.col("true_direction") == -1)).alias("sign_errors"),
    )
