"""Secret scan with corpus-wide ownership frequency.

Base spans come from three fixed patterns, leftmost and non-overlapping for each kind.
Positions are found by putting marks around the matches and adding up the lengths of the
pieces, all with built-in functions.  Every value that looks like a credential, among
them ``opaque`` runs (letters in both cases and digits, outside base spans), is hashed and
counted over the corpus by distinct owners (sources) and repositories (distinct texts).
A value of few owners and few repositories looks live, one that many owners or many
repositories copy is an example.  Opaque runs
are reported only where they look live; base spans always stay.

Cases: a null text counts as empty, a null source is one owner; empty texts and tables
give no spans; rows that repeat an id are scanned one by one; other columns are ignored.
U+0001 and U+0002 in a text are read as U+0003, which no pattern can match either.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialize, text_or_empty

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A run that fails its kind's length can't hold a longer one, so the length is part of the pattern.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
OPAQUE = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[A-Za-z0-9+/_-]{20})[A-Za-z0-9+/_-]++"
KINDS = ("assign", "access", "hex", "opaque")
CHUNK = 64


def spans(clean: Column, pattern: str, kind: str) -> Column:
    """array<struct<start,kind_no,stop,kind,value>> of the matches in ``clean``; code points, end exclusive."""
    parts = F.split(F.regexp_replace(clean, F.lit(pattern), F.lit("\u0001$0\u0002")), "\u0001")
    one = "struct<start:int,kind_no:int,stop:int,kind:string,value:string>"
    none = F.array().cast(f"array<{one}>")

    def step(acc, part):
        match = F.substring_index(part, "\u0002", 1)
        begin = acc["at"]
        value = F.regexp_extract(match, ASSIGN, 2) if kind == "assign" else match
        good = F.lit(True)
        if kind == "assign":
            good = F.length(value) >= 6
        elif kind == "opaque":
            good = match.rlike("[a-z]") & match.rlike("[A-Z]")
        span = F.struct(
            begin.alias("start"),
            F.lit(KINDS.index(kind)).alias("kind_no"),
            (begin + F.length(match)).cast("int").alias("stop"),
            F.lit(kind).alias("kind"),
            value.alias("value"),
        )
        found = F.when(good, F.concat(acc["found"], F.array(span))).otherwise(acc["found"])
        return F.struct((begin + F.length(part) - 1).cast("int").alias("at"), found.cast(f"array<{one}>").alias("found"))

    def chunk_step(acc, chunk):
        return F.aggregate(
            chunk,
            F.struct(acc["at"].alias("at"), none.alias("found")),
            step,
            lambda done: F.struct(
                done["at"].alias("at"), F.concat(acc["found"], F.array(done["found"])).cast(f"array<array<{one}>>").alias("found")
            ),
        )

    # appending to an array copies it: short chunks keep a text of very many matches from being quadratic
    last = F.greatest(F.ceil((F.size(parts) - 1) / CHUNK) - 1, F.lit(0)).cast("int")
    chunks = F.transform(F.sequence(F.lit(0), last), lambda c: F.slice(parts, c * CHUNK + 2, CHUNK))
    zero = F.struct(F.length(F.element_at(parts, 1)).alias("at"), F.array().cast(f"array<array<{one}>>").alias("found"))
    found = F.flatten(F.aggregate(chunks, zero, chunk_step)["found"])
    return F.when(clean.rlike(pattern), found).otherwise(none)


def joined(found: Column) -> Column:
    """kind:start:stop by start, then kind as listed, comma-joined."""
    return F.array_join(
        F.transform(F.array_sort(found), lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ","
    )


def find_secrets(
    documents: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    owner_col: str = "source",
    max_owners: int = 2,
    max_repos: int = 10,
) -> DataFrame:
    """Per document: doc_id, base and opaque spans with values, and how each value is owned.

    Columns: doc_id, base (spans), live_opaque (spans), n_live, n_example: values of base
    spans that look live (at most ``max_owners`` owners and ``max_repos`` repositories) and the others.
    """
    clean = F.translate(text_or_empty(text_col), "\u0001\u0002", "\u0003\u0003")
    scanned = documents.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(owner_col).cast("string"), F.lit("")).alias("owner"),
        F.xxhash64(text_or_empty(text_col)).alias("repo"),
        F.concat(spans(clean, ASSIGN, "assign"), spans(clean, ACCESS, "access"), spans(clean, HEX, "hex")).alias("base"),
        spans(clean, OPAQUE, "opaque").alias("opaque"),
    )
    scanned = materialize(scanned, "secret-scan").withColumn(
        "opaque",
        F.filter(
            "opaque",
            lambda o: ~F.exists("base", lambda b: (b["start"] < o["stop"]) & (o["start"] < b["stop"])),
        ),
    )
    hit = scanned.where((F.size("base") > 0) | (F.size("opaque") > 0))
    values = hit.select(
        "doc_id", "owner", "repo", F.explode(F.concat("base", "opaque")).alias("span")
    ).withColumn("value_hash", F.sha2(F.col("span.value"), 256))
    owners = values.groupBy("value_hash", "owner").agg(F.count("*").alias("n_uses"))
    repos = values.groupBy("value_hash", "repo").agg(F.count("*").alias("n_uses"))
    owned = owners.groupBy("value_hash").agg(F.count("*").alias("n_owners"))
    owned = owned.join(repos.groupBy("value_hash").agg(F.count("*").alias("n_repos")), "value_hash")
    live = (F.col("n_owners") <= max_owners) & (F.col("n_repos") <= max_repos)
    judged = values.join(owned, "value_hash").withColumn("live", live)
    is_base = F.col("span.kind") != "opaque"
    per_doc = judged.groupBy("doc_id", "owner", "repo").agg(
        F.collect_set(F.when(~is_base & F.col("live"), F.col("span"))).alias("live_opaque"),
        # sets, as rows that repeat an id, owner and text meet here
        F.size(F.collect_set(F.when(is_base & F.col("live"), F.col("span")))).alias("n_live"),
        F.size(F.collect_set(F.when(is_base & ~F.col("live"), F.col("span")))).alias("n_example"),
        F.max("n_owners").alias("max_owners"),
        F.max("n_repos").alias("max_repos"),
    )
    key = [F.col(f"s.{c}").eqNullSafe(F.col(f"p.{c}")) for c in ("doc_id", "owner", "repo")]
    return scanned.alias("s").join(per_doc.alias("p"), key, "left").select(
        "s.doc_id",
        "s.repo",
        "s.base",
        F.coalesce("p.live_opaque", F.filter("s.base", lambda _: F.lit(False))).alias("live_opaque"),
        F.coalesce("p.n_live", F.lit(0)).cast("long").alias("n_live"),
        F.coalesce("p.n_example", F.lit(0)).cast("long").alias("n_example"),
        F.coalesce("p.max_owners", F.lit(0)).cast("long").alias("most_owners"),
        F.coalesce("p.max_repos", F.lit(0)).cast("long").alias("most_repos"),
    )


def redact(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", mask: str = "[SECRET]", **options) -> DataFrame:
    """The documents with the values of base spans and live opaque runs replaced in their text; null texts stay null."""
    found = find_secrets(documents, id_col, text_col, **options)
    # a value ends its span; the word that it is assigned to stays
    values = F.transform(
        F.concat("base", "live_opaque"), lambda s: F.struct((s["stop"] - F.length(s["value"])).alias("start"), s["stop"].alias("stop"))
    )
    found = found.select("doc_id", "repo", F.array_sort(values).alias("spans")).where(F.size("spans") > 0)
    found = found.dropDuplicates(["doc_id", "repo"])
    key = F.col("f.doc_id").eqNullSafe(F.col(f"d.{id_col}")) & (F.col("f.repo") == F.xxhash64(text_or_empty(f"d.{text_col}")))
    text = F.col(f"d.{text_col}")

    def step(acc, span):
        piece = F.concat(acc["out"], F.substring(text, acc["at"] + 1, span["start"] - acc["at"]), F.lit(mask))
        out = F.when(span["start"] >= acc["at"], piece).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], span["stop"]).alias("at"), out.alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    masked = F.aggregate("f.spans", zero, step, lambda r: F.concat(r["out"], F.substring(text, r["at"] + 1, F.length(text))))
    new = F.when(F.col("f.spans").isNull(), text).otherwise(masked)
    joined_rows = documents.alias("d").join(found.alias("f"), key, "left")
    return joined_rows.select(*[new.alias(c) if c == text_col else F.col(f"d.{c}") for c in documents.columns])


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from ``find_secrets``."""

    def n(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        n("assign"),
        n("access"),
        n("hex"),
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.concat("base", "live_opaque")).alias("spans"),
        "n_live",
        "n_example",
        "most_owners",
        "most_repos",
    )
