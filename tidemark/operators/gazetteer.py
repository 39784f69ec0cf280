"""Places in texts by joins with a phrase dictionary, and the zones and regions that follow from them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_WORDS = r"[^\w]+"


def phrase_hits(texts: DataFrame, key: str, text: str, phrases: DataFrame, longest: int) -> DataFrame:
    """(key, found): places of the dictionary (phrase, place) in each text, in text order; texts without any are left out.

    A phrase of up to ``longest`` words is looked up by an equality join on the word n-grams of the text.  From the left the
    longest phrase at a place is taken and the next one is looked for behind it.  Case and punctuation don't count; nulls have no words.
    """
    words = F.filter(F.split(F.lower(text), _WORDS), lambda w: w != "")
    rows = texts.select(F.col(key).alias("__k"), words.alias("__w")).where(F.size("__w") > 0)
    rows = rows.select("__k", "__w", F.explode(F.sequence(F.lit(1), F.lit(longest))).alias("__n")).where(F.size("__w") >= F.col("__n"))
    at = F.explode(F.sequence(F.lit(1), F.size("__w") - F.col("__n") + 1)).alias("__at")
    grams = rows.select("__k", "__n", "__w", at).select("__k", "__n", "__at", F.array_join(F.slice("__w", F.col("__at"), F.col("__n")), " ").alias("phrase"))
    own = F.array_join(F.filter(F.split(F.lower("phrase"), _WORDS), lambda w: w != ""), " ")
    dictionary = phrases.select(own.alias("phrase"), "place").groupBy("phrase").agg(F.min("place").alias("place"))
    hits = grams.join(dictionary, "phrase").groupBy("__k").agg(F.array_sort(F.collect_list(F.struct("__at", (-F.col("__n")).alias("__less"), "place"))).alias("__h"))
    start = F.struct(F.lit(0).alias("end"), F.array().cast("array<string>").alias("found"))

    def step(state, hit):
        taken = F.struct((hit["__at"] - hit["__less"]).alias("end"), F.concat(state["found"], F.array(hit["place"])).alias("found"))
        return F.when(hit["__at"] >= state["end"], taken).otherwise(state)

    return hits.select(F.col("__k").alias(key), F.aggregate("__h", start, step)["found"].alias("found"))


def with_places(texts: DataFrame, key: str, text: str, phrases: DataFrame, longest: int) -> DataFrame:
    """The texts with places (array, in text order); ``key`` is unique."""
    hits = phrase_hits(texts, key, text, phrases, longest)
    return texts.join(hits.withColumnRenamed("found", "places"), key, "left").withColumn("places", F.coalesce("places", F.array().cast("array<string>")))


def _mapped(places: Column, table: Mapping[str, str]) -> Column:
    pairs = F.create_map(*[F.lit(x) for p in table.items() for x in p]) if table else F.create_map().cast("map<string,string>")
    return F.filter(F.transform(places, lambda p: F.element_at(pairs, p)), lambda z: z.isNotNull())


def resolve_zones(
    text: Column,
    places: Column,
    theme: Column,
    banks: Sequence[tuple[str, str]],
    bank_theme: object,
    texts: Sequence[tuple[str, str]],
    zones: Mapping[str, str],
    world_theme: object,
    world_zones: Sequence[str],
    default: str,
    default_themes: Sequence,
    always_theme: object,
) -> Column:
    """Zones of a text, in order.

    In ``bank_theme`` the first pattern of ``banks`` (pattern, zone) that matches decides alone.  Else zones come from the
    patterns of ``texts`` and then from the places.  In ``world_theme`` they are GLOBAL and those of ``world_zones``.  Where there is neither a zone
    nor a place, ``default_themes`` get ``default``; ``always_theme`` has it in any case, first.
    """
    none = F.array().cast("array<string>")
    bank = F.lit(None).cast("string")
    for pattern, zone in reversed(banks):
        bank = F.when(text.rlike(pattern), F.lit(zone)).otherwise(bank)
    bank = F.when(theme == F.lit(bank_theme), bank)
    said = F.concat(*[F.when(text.rlike(p), F.array(F.lit(z))).otherwise(none) for p, z in texts]) if texts else none
    found = F.array_distinct(F.concat(said, _mapped(places, zones)))
    world = F.concat(F.array(F.lit("GLOBAL")), F.filter(found, lambda z: z.isin(*world_zones)))
    bare = (F.size(found) == 0) & (F.size(places) == 0) & theme.isin(*default_themes)
    local = F.when(bare, F.array(F.lit(default))).otherwise(found)
    local = F.when((theme == F.lit(always_theme)) & ~F.array_contains(local, default), F.concat(F.array(F.lit(default)), local)).otherwise(local)
    return F.when(bank.isNotNull(), F.array(bank)).when(theme == F.lit(world_theme), world).otherwise(local)


def first_member(places: Column, members: Mapping[str, str]) -> Column:
    """The member that the first such place stands for, or null."""
    return F.get(_mapped(places, members), 0)


def region_of(text: Column, places: Column, regions: Sequence[tuple[str, Sequence[str]]], spoken: Sequence[tuple[str, str]], other: str = "OTHER") -> Column:
    """The first region with a member among the places, else the first of ``spoken`` (region, pattern) in the text, else ``other``."""
    out = F.lit(other)
    for name, pattern in reversed(spoken):
        out = F.when(text.rlike(pattern), F.lit(name)).otherwise(out)
    for name, members in reversed(regions):
        out = F.when(F.arrays_overlap(places, F.array(*[F.lit(m) for m in members])), F.lit(name)).otherwise(out)
    return out
