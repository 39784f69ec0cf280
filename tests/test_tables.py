"""Places, rules, distinct counts, samples, checks and the registry on small made-up tables, against plain loops."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.operators import bitmaps, checks, gazetteer, rules, sampling
from tidemark.sources import files


def test_phrases_from_the_left_longest_first(spark):
    phrases = [("new york", "NY"), ("york", "YK"), ("new york city", "NYC"), ("city of london", "LON"), ("london", "LN"), ("New", "N")]
    dictionary = spark.createDataFrame(phrases, "phrase string, place string")
    rng = random.Random(1)
    words = ["new", "york", "city", "of", "london", "NEW", "x"]
    texts = [(i, rng.choice([" ", ", ", " - "]).join(rng.choices(words, k=rng.randint(0, 9)))) for i in range(200)] + [(900, None), (901, "")]
    got = {r["i"]: r["places"] for r in gazetteer.with_places(spark.createDataFrame(texts, "i int, t string"), "i", "t", dictionary, 3).collect()}
    table = {p.lower(): c for p, c in phrases}
    for i, t in texts:
        w, at, want = [x for x in re.split(r"\W+", (t or "").lower()) if x], 0, []
        while at < len(w):
            n = next((n for n in (3, 2, 1) if at + n <= len(w) and " ".join(w[at : at + n]) in table), 0)
            want += [table[" ".join(w[at : at + n])]] if n else []
            at += n or 1
        assert got[i] == want, t


def test_zones_and_regions(spark):
    rows = [
        (1, "M", "the fed meets", ["FR"]), (2, "M", "euro area rates", ["DE"]), (3, "I", "prices", []), (4, "G", "war", ["DE", "IR", "BR"]),
        (5, "T", "tariffs on japan", ["JP"]), (6, "I", "prices", ["??"]), (7, "G", "gaza", []), (8, None, "nothing", []), (9, "O", "other", []),
    ]
    df = spark.createDataFrame(rows, "i int, theme string, text string, places array<string>")
    zone = gazetteer.resolve_zones(
        F.col("text"), F.col("places"), F.col("theme"), [("fed", "US"), ("boj", "JP")], "M", [("euro area", "EA")],
        {"DE": "EA", "FR": "EA", "JP": "JP", "BR": "BR"}, "G", ["EA", "JP"], "US", ["M", "I", "T"], "T",
    )
    region = gazetteer.region_of(F.col("text"), F.col("places"), [("MID", ["IR"]), ("LAT", ["BR"])], [("MID", "gaza")])
    got = {r["i"]: (r["z"], r["m"], r["r"]) for r in df.select("i", zone.alias("z"), gazetteer.first_member(F.col("places"), {"DE": "DE", "FR": "FR"}).alias("m"), region.alias("r")).collect()}
    assert got[1] == (["US"], "FR", "OTHER") and got[2] == (["EA"], "DE", "OTHER") and got[3][0] == ["US"]
    assert got[4] == (["GLOBAL", "EA"], "DE", "MID") and got[5][0] == ["US", "JP"] and got[6][0] == []
    assert got[7] == (["GLOBAL"], None, "MID") and got[8][0] == [] and got[9][0] == []


@pytest.mark.parametrize(
    "pattern, literal",
    [("shutdown end", "shutdown end"), ("colou?r", "colo"), ("a|b", ""), (r"\bwins? the", " the"), ("(abc|d)efg+", "ef"), ("x{0,2}yz", "yz"), ("[abc]tail", "tail"), (r"A\.B", "a.b"), ("", ""), ("^Red.*ring$", "ring")],
)
def test_mandatory_literals(pattern, literal):
    assert rules.mandatory_literal(pattern) == literal


def test_thousands_of_rules_without_a_nested_loop(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdef", k=rng.randint(3, 6)))
    seeds = [word() for _ in range(400)]
    table = [(i, rng.choice([rng.choice(seeds), rng.choice(seeds)[:4] + ".?", "(" + rng.choice(seeds) + "|zz)", "^" + rng.choice(seeds)]), rng.choice([".", "pro", "con"]), i % 3 - 1) for i in range(3000)]
    texts = [(i, " ".join(rng.choices(seeds, k=6)).title(), rng.choice(["Pro", "con", "none"])) for i in range(60)] + [(60, None, "pro"), (61, "zz", None), (62, "", "pro")]
    out = rules.first_rule(spark.createDataFrame(texts, "i int, t string, c string"), "i", "t", "c", spark.createDataFrame(table, "no int, pattern string, context string, s int"), "s")
    got = {r["i"]: (r["rule"], r["s"]) for r in out.collect()}
    want = {}
    for i, t, c in texts:
        hit = next(((n, s) for n, p, x, s in table if t is not None and c is not None and re.search(p, t, re.I) and re.search(x, c, re.I)), None)
        if hit:
            want[i] = hit
    assert got == want and len(want) > 30
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner" in plan and "Join Cross" not in plan


def test_texts_of_small_files_are_not_broadcast(spark, tmp_path):
    texts = spark.range(2000).select(F.col("id").cast("int").alias("i"), F.concat(F.lit("red bolt "), "id").alias("t"), F.lit("pro").alias("c"))
    texts.write.parquet(f"{tmp_path}/texts")  # the size of the files says nothing about the pieces of the texts
    table = spark.createDataFrame([(1, "bolt 7", "con", -1), (2, "^red", ".", 1)], "no int, pattern string, context string, s int")
    out = rules.first_rule(spark.read.parquet(f"{tmp_path}/texts"), "i", "t", "c", table, "s")
    assert [tuple(r) for r in out.groupBy("rule", "s").count().collect()] == [(2, 1, 2000)]
    joins = [line for line in out._jdf.queryExecution().sparkPlan().toString().splitlines() if "Join" in line and "RLIKE" in line]
    assert len(joins) == 1 and "BroadcastHashJoin" in joins[0] and "BuildRight" in joins[0]  # the rules are on the right


def test_bitmap_counts_merge(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab") if rng.random() < 0.9 else None, rng.randint(1, 4), f"c{rng.randint(0, 300)}", rng.randint(0, 40000)) for _ in range(3000)]
    df = spark.createDataFrame(rows, "k string, month int, c string, day int")
    contracts = bitmaps.with_code(df.select("c").distinct(), ["c"], "code")
    codes = sorted(r["code"] for r in contracts.collect())
    assert codes == list(range(1, len({r[2] for r in rows}) + 1))
    big = df.join(contracts, "c").withColumn("code", F.col("code") * 400)  # several ranges of codes
    parts = bitmaps.bitmaps(big, ["k", "month"], {"nc": F.col("code"), "nd": F.when(F.col("day") > 100, F.col("day"))}, {"s": F.col("day")})
    for keys, of in ((["k", "month"], lambda r: (r[0], r[1])), (["k"], lambda r: (r[0],))):
        rolled = parts if len(keys) == 2 else bitmaps.merged(parts, keys, ["nc", "nd"], ["s"])
        got = {tuple(r[k] for k in keys): (r["nc"], r["nd"], r["s"]) for r in bitmaps.counted(rolled, keys, ["nc", "nd"], ["s"]).collect()}
        groups = {}
        for r in rows:
            groups.setdefault(of(r), []).append(r)
        assert got == {g: (len({r[2] for r in v}), len({r[3] for r in v if r[3] > 100}), sum(r[3] for r in v)) for g, v in groups.items()}


def test_two_stage_samples(spark):
    rng = random.Random(4)
    rows = [(f"s{rng.randint(0, 3)}", e, f"m{e}-{i}", rng.uniform(0, 100)) for e in range(60) for i in range(rng.randint(1, 5))]
    df = spark.createDataFrame(rows, "s string, e int, m string, v double")
    got = sampling.stratified_sample(df, "s", "e", "m", "v", 120.0, 5, "x")
    md5 = lambda *x: hashlib.md5("|".join(map(str, x)).encode()).hexdigest()
    total = {}
    for _, e, _, v in rows:
        total[e] = total.get(e, 0) + v
    want = set()
    for s in {r[0] for r in rows}:
        events = sorted({r[1] for r in rows if r[0] == s and total[r[1]] >= 120}, key=lambda e: md5("x-event", e))[:5]
        want |= {(s, e, min((r[2] for r in rows if r[1] == e), key=lambda m: md5("x-market", m))) for e in events}
    out = got.collect()
    assert {(r["s"], r["e"], r["m"]) for r in out} == want
    order = sorted(want, key=lambda r: md5("x-item", r[0], r[1]))
    assert [(r["s"], r["e"], r["m"]) for r in sorted(out, key=lambda r: r["item"])] == order
    assert "WindowGroupLimit" in sampling.bottom_k(df, ["s"], ["m"], 2, "y")._jdf.queryExecution().executedPlan().toString()


def test_duplicates_stop_a_run(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (2, "d"), (None, "e")], "i int, v string")
    assert {(r["i"], r["n"]) for r in checks.duplicates(df, ["i"]).collect()} == {(1, 2), (None, 2)}
    with pytest.raises(ValueError, match="more than once"):
        checks.require_unique(df, ["i"])
    assert checks.require_unique(df, ["v"]).count() == 5


def test_registry_skips_missing_sources(spark, tmp_path):
    tables = [("a", lambda: spark.range(3), "numbers", {"id": "count"}), ("b", lambda: spark.read.parquet(f"{tmp_path}/none"), "missing", {})]
    got = files.export_registry(tables, f"{tmp_path}/out", spark).collect()
    assert [(r["name"], r["column"], r["units"], r["written"]) for r in got] == [("a", "id", "count", True), ("b", None, None, False)]
    assert spark.read.parquet(f"{tmp_path}/out/a").count() == 3
    with pytest.raises(ZeroDivisionError):
        files.export_registry([("c", lambda: 1 / 0, "broken", {})], f"{tmp_path}/out", spark)
