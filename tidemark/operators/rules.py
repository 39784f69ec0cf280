"""Text rules as a table: a literal that a pattern cannot do without finds its texts by a join, the pattern is tried on those alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: characters of the literal pieces that texts and rules are joined by
PIECE = 3


def mandatory_literal(pattern: str) -> str:
    """The longest run of plain characters, in lower case, that every match of a regular expression holds; "" if none is sure.

    Groups, classes and escapes end a run and give none; a quantifier takes the character before it off.
    """
    runs, run, depth, in_class, i = [], "", 0, False, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            plain = i + 1 < len(pattern) and not pattern[i + 1].isalnum() and not (depth or in_class)
            if plain:
                run += pattern[i + 1]
            elif not (depth or in_class):
                runs, run = [*runs, run], ""
            i += 2
            continue
        if in_class:
            in_class = c != "]"
        elif c == "[":
            in_class, runs, run = True, [*runs, run], ""
        elif c == "(":
            depth, runs, run = depth + 1, [*runs, run], ""
        elif c == ")":
            depth -= 1
        elif depth:
            pass
        elif c == "|":
            return ""
        elif c in "?*+{":
            runs, run = [*runs, run[:-1]], ""
            if c == "{":
                i = pattern.find("}", i)
                if i < 0:
                    return ""
        elif c in ".^$":
            runs, run = [*runs, run], ""
        else:
            run += c
        i += 1
    return max([*runs, run], key=len).lower()


def _pieces(text):
    """Distinct pieces of a lower-case text, and the empty piece."""
    n = F.length(text)
    every = F.when(n >= PIECE, F.transform(F.sequence(F.lit(1), n - PIECE + 1), lambda i: F.substring(text, i, F.lit(PIECE)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(F.lit("")), every))


def first_rule(texts: DataFrame, key: str, title: str, context: str, rules: DataFrame, value: str) -> DataFrame:
    """(key, rule, value): the first rule (no, pattern, context, value) whose pattern matches the title and its context pattern the context.

    Rules may be many thousands: each is found through one piece of its literal, the one that fewest rules have; rules without
    a sure literal are tried on all texts.  The rules are broadcast, a row each; texts stay where they are up to the hits.  Null
    texts match nothing; texts without a rule are left out.
    """
    literal = F.udf(mandatory_literal, StringType())  # once a rule, not a text
    r = rules.select(F.col("no").alias("__no"), F.col("pattern").alias("__p"), F.col("context").alias("__c"), F.col(value).alias("__v"))
    r = r.withColumn("__lit", literal("__p"))
    pieces = F.filter(_pieces(F.col("__lit")), lambda p: (p != "") | (F.length("__lit") < PIECE))
    keyed = r.select("*", F.explode(pieces).alias("__piece"))
    rare = keyed.groupBy("__piece").agg(F.count("*").alias("__n"))
    chosen = keyed.join(rare, "__piece").groupBy("__no", "__p", "__c", "__v", "__lit").agg(F.min_by("__piece", F.struct("__n", "__piece")).alias("__piece"))
    t = texts.select(F.col(key).alias("__k"), F.col(title).alias("__t"), F.col(context).alias("__x")).where("__t is not null and __x is not null")
    found = t.withColumn("__piece", F.explode(_pieces(F.lower("__t")))).join(F.broadcast(chosen), "__piece").where(F.contains(F.lower("__t"), F.col("__lit")))
    hits = found.where(F.expr("regexp_like(__t, '(?i)' || __p) and regexp_like(__x, '(?i)' || __c)"))
    first = hits.groupBy("__k").agg(F.min(F.struct(F.col("__no").alias("no"), F.col("__v").alias("v"))).alias("f"))
    return first.select(F.col("__k").alias(key), F.col("f.no").alias("rule"), F.col("f.v").alias(value))
