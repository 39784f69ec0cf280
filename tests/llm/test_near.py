"""Runs, components, near-duplicate documents and lines against brute force."""

import glob
import itertools
import os
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F
from tests.llm.util import ODD, docs

from tidemark.llm import common, line_dedup, links, near_dedup, registry
from tidemark.llm.common import shared_dir


def union(pairs, ids):
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    return {i: find(i) for i in ids}


def lcs(a, b):
    best = [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(best[j] + 1 if x == y else max(best[j + 1], row[j]))
        best = row
    return best[-1]


def test_banded_alignment_against_full_lcs():
    rng = random.Random(3)
    for _ in range(300):
        a = [rng.randint(0, 6) for _ in range(rng.randint(0, 40))]
        b = list(a)
        for _ in range(rng.randint(0, 8)):
            if b and rng.random() < 0.5:
                b.pop(rng.randrange(len(b)))
            else:
                b.insert(rng.randint(0, len(b)), rng.randint(0, 6))
        x, y = np.array(a, np.uint64), np.array(b, np.uint64)
        want = lcs(a, b)
        assert near_dedup.common_in_order(x, y, len(a) + len(b)) == want
        similar = want / (len(a) + len(b) - want) if a and b else 0.0
        got = near_dedup.aligned_similarity(x, y, 0.6)
        assert got == similar if similar >= 0.6 else got < 0.6


def test_components_chain_and_star(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    got = {r["id"]: r["component"] for r in links.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == union(edges, set(itertools.chain(*edges)))


def test_components_of_a_long_chain(spark):
    ids = np.random.default_rng(6).integers(-(2**62), 2**62, 2000).tolist()
    edges = list(zip(ids, ids[1:]))
    got = links.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["id"]: r["component"] for r in got} == {i: min(ids) for i in ids} and len(got) == len(ids)


def test_packed_runs_find_every_shared_key():
    rng = np.random.default_rng(1)
    keys, ids = rng.integers(0, 60, 400).astype(np.uint64), rng.integers(-50, 50, 400)
    buckets = defaultdict(list)
    for a in range(0, 400, 100):
        for row in links.packed_entries(keys[a : a + 100], ids[a : a + 100], 7):
            buckets[row[0]].append(row[1:])
    got = set()
    for rows in buckets.values():
        parts = [np.frombuffer(b"".join(x), d) for x, d in zip(zip(*rows), (np.uint64, np.int64, np.uint8))]
        got |= set(zip(*[x.tolist() for x in links.runs_of(*parts)]))
    by = defaultdict(set)
    for k, i in zip(keys.tolist(), ids.tolist()):
        by[k].add(i)
    assert got == {(k, i) for k, v in by.items() if len(v) > 1 for i in v}


def variants(rng, n, words=120):
    base = [f"w{rng.randint(0, 400)}" for _ in range(words)]
    out = [" ".join(base)]
    for _ in range(n - 1):
        w = list(base)
        for _ in range(rng.randint(1, 6)):
            w[rng.randrange(len(w))] = f"e{rng.randint(0, 999)}"
        out.append(" ".join(w))
    return out


def test_near_dedup_against_brute_force(spark):
    rng = random.Random(8)
    texts = [t for _ in range(8) for t in variants(rng, 9)]
    texts += [texts[0], " ".join(reversed(texts[0].split())), "short one", "short one", "short two"]
    rng.shuffle(texts)
    df = docs(spark, list(zip(range(len(texts)), texts, itertools.repeat("s")))).withColumnRenamed("lang", "class_id")
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_dedup(df).collect()}
    seqs = [[tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] for w in map(str.split, texts)]
    pairs = []
    for a, b in itertools.combinations(range(len(texts)), 2):
        m = lcs(seqs[a], seqs[b])
        if m / (len(seqs[a]) + len(seqs[b]) - m) >= 0.8:
            pairs.append((a, b))
    assert got == union(pairs, range(len(texts)))


def test_near_dedup_odd_rows(spark):
    got = near_dedup.near_dedup(docs(spark, ODD)).collect()
    assert len(got) == len(ODD)
    by = {(r["doc_id"]): r for r in got if r["doc_id"] is not None}
    assert by[1]["class_id"] == by[2]["class_id"] == 1 and not by[2]["kept"]
    assert by[4]["class_id"] == 3 and by[3]["class_size"] == 4
    assert sorted((r["class_id"], r["kept"]) for r in got if r["doc_id"] is None and r["class_id"]) == [(3, False)]
    assert near_dedup.near_dedup(docs(spark, ODD).limit(0)).count() == 0


def brute_lines(rows, k=8, t=0.8):
    """Line numbers to remove by document, comparing all pairs of lines."""
    first, places = {}, []
    for i, text in rows:
        for n, line in enumerate((text or "").split("\n")):
            if line.strip(" "):
                first.setdefault(line, (i, n))
                places.append((line, i, n))
    lines = list(first)
    sets = [{x[i : i + k] for i in range(len(x) - k + 1)} for x in lines]
    pairs = [
        (lines[a], lines[b])
        for a, b in itertools.combinations(range(len(lines)), 2)
        if sets[a] and sets[b] and len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b])
    ]
    comp = union(pairs, lines)
    best = {}
    for line, at in first.items():
        best[comp[line]] = min(best.get(comp[line], at), at)
    gone = defaultdict(list)
    for line, i, n in places:
        if best[comp[line]] != (i, n):
            gone[i].append(n)
    return gone


def test_line_dedup_against_brute_force(spark):
    rng = random.Random(4)
    pool = []
    for _ in range(30):
        base = "".join(rng.choice("abcdefg éß") for _ in range(rng.randint(40, 200)))
        pool.append(base)
        for _ in range(3):
            c = list(base)
            for _ in range(rng.randint(1, 3)):
                c[rng.randrange(len(c))] = rng.choice("xyz")
            pool.append("".join(c))
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 8)))) for i in range(60)] + [(60, "a\n\na\na"), (61, None)]
    df = docs(spark, [(i, t, "s") for i, t in rows]).withColumnRenamed("lang", "removed")
    got = {r["doc_id"]: r for r in line_dedup.line_report(df).collect()}
    gone = brute_lines(rows)
    assert {i: r["removed"] for i, r in got.items()} == {i: ",".join(map(str, gone.get(i, []))) for i, _ in rows}
    clean = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(df).collect()}
    for i, t in rows:
        want = None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone.get(i, []))
        assert clean[i] == want
    assert got[61]["n_lines"] == 0 and got[60]["n_lines"] == 4


def test_short_lines_count_as_exact_copies(spark, tmp_path):
    rows = [(1, "Les.\n\nLes.\nAnd ornd."), (2, "And ornd.\n \nLes\nLes."), (3, "\n\n")]
    docs(spark, [(i, t, "s") for i, t in rows]).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in registry.QUERIES["op6_line_dedup"](spark, str(tmp_path)).collect()}
    assert {i: r["removed"] for i, r in got.items()} == {1: "2", 2: "0,3", 3: ""}
    assert {i: (r["n_exact"], r["n_fuzzy"]) for i, r in got.items()} == {1: (1, 0), 2: (2, 0), 3: (0, 0)}
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    clean = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(df).collect()}
    assert clean == {1: "Les.\n\nAnd ornd.", 2: " \nLes", 3: "\n\n"}


def test_lines_of_k_characters_are_compared(spark):
    rows = [(1, "-" * 9), (2, "-" * 8), (3, "-" * 11), (4, "-" * 7), (5, "-" * 7)]  # one shingle set; 7 characters have none
    got = {r["doc_id"]: (r["removed"], r["n_exact"], r["n_fuzzy"]) for r in line_dedup.line_report(docs(spark, [(i, t, "s") for i, t in rows])).collect()}
    assert got == {1: ("", 0, 0), 2: ("0", 0, 1), 3: ("0", 0, 1), 4: ("", 0, 0), 5: ("0", 1, 0)}


def test_a_large_run_sends_each_member_once(spark):
    rng = random.Random(12)
    lines = ["".join(rng.choice("abcdefgh ") for _ in range(60)) for _ in range(1500)]
    for n in range(0, 1500, 50):  # planted links across parts
        lines[n + 7] = lines[n][:30] + "x" + lines[n][31:]
    make = lambda: line_dedup.JaccardMatcher(8, 0.6, 16, 4)
    texts = spark.createDataFrame(list(enumerate(lines)), "id long, text string")
    payload = links.with_sketches(texts, make).withColumn("keys", F.expr("unhex(repeat('01', 128))"))  # all share every key
    mixed = spark.createDataFrame([(0x0101010101010101, i, i) for i in range(1500)], "key long, id long, c long")
    got = {tuple(sorted((r["a"], r["b"]))) for r in links.run_links(mixed, payload, make, block=100).collect()}
    assert got == {(n, n + 7) for n in range(0, 1500, 50)}
    files = max(glob.glob(f"{shared_dir(spark).removeprefix('file:')}/run-parts-*"), key=lambda d: len(os.listdir(d)))
    stored = [pq.read_metadata(f"{files}/{f}").num_rows for f in os.listdir(files)]
    assert len(stored) == 15 and sum(stored) == 1500 and max(stored) < 200
    assert links.run_links(mixed.limit(0), payload, make, block=100).count() == 0


def test_line_dedup_odd_rows(spark):
    df = docs(spark, ODD)
    out = line_dedup.dedup_lines(df)
    assert out.columns == df.columns and out.count() == len(ODD)
    text = {r["doc_id"]: r["text"] for r in out.collect() if r["doc_id"] is not None}
    assert text[3] == "same text here" and text[4] == "" and text[1] is None
    assert line_dedup.line_report(df.limit(0)).count() == 0


def test_ids_of_all_sizes(spark):
    a, b = "one two three four five six seven eight nine ten eleven twelve", "completely other words in this one here and more of them again"
    data = [(2**62 + 5, a, "s"), (2**63 - 1, a, "s"), (None, a, "s"), (2**62 + 7, b, "s"), (-(2**63), b, "s"), (None, "alone", "s")]
    got = Counter((r["doc_id"], r["class_id"], r["kept"], r["class_size"]) for r in near_dedup.near_dedup(docs(spark, data)).collect())
    want = [(2**62 + 5, 2**62 + 5, True, 3), (2**63 - 1, 2**62 + 5, False, 3), (None, 2**62 + 5, False, 3)]
    want += [(2**62 + 7, -(2**63), False, 2), (-(2**63), -(2**63), True, 2), (None, None, True, 1)]
    assert got == Counter(want)
    kept = near_dedup.keep_representatives(docs(spark, data).selectExpr("*", "1 as n", "2 as id", "3 as __at")).collect()
    assert Counter(r["doc_id"] for r in kept) == Counter([2**62 + 5, -(2**63), None])
    assert kept[0]["n"] == 1 and kept[0]["__at"] == 3


def test_lines_with_ids_of_all_sizes(spark):
    line = "a line that is long enough to be compared"
    df = docs(spark, [(2**62 + 5, line, "s"), (2**62 + 6, line, "s"), (None, line, "s"), (-5, "other\n" + line, "s")])
    df = df.selectExpr("*", "1 as rid", "2 as removed", "3 as __at", "4 as __text")
    got = line_dedup.dedup_lines(df).collect()
    assert {r["doc_id"]: r["text"] for r in got} == {2**62 + 5: "", 2**62 + 6: "", None: "", -5: "other\n" + line}
    assert all((r["rid"], r["removed"], r["__at"], r["__text"]) == (1, 2, 3, 4) for r in got)


def test_joined_classes_equal_components_of_all_links(spark):
    rng = random.Random(3)
    first = [(rng.randrange(60), rng.randrange(60)) for _ in range(25)]
    more = [(rng.randrange(80), rng.randrange(80)) for _ in range(25)]
    frame = lambda pairs: spark.createDataFrame(pairs, "a long, b long").where("a <> b")
    classes = links.components(frame(first))
    got = {r["id"]: r["component"] for r in links.joined_classes(classes, frame(more)).collect()}
    want = {r["id"]: r["component"] for r in links.components(frame(first + more)).collect()}
    assert got == want


def test_small_tables_are_written_in_few_files(spark):
    """A round's labels are no file for each shuffle partition; where there are more rows, there are more tasks."""
    kept = {k: spark.conf.get(k, None) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        for k, v in zip(kept, ("48", "false")):
            spark.conf.set(k, v)
        before = set(glob.glob(f"{shared_dir(spark)}/labels-*"))
        edges = spark.range(400).selectExpr("id as a", "id + 1000 as b")
        found = {r["id"]: r["component"] for r in links.components(edges).collect()}
        assert found == {i + d: i for i in range(400) for d in (0, 1000)}
        written = [len(glob.glob(f"{d}/part-*")) for d in set(glob.glob(f"{shared_dir(spark)}/labels-*")) - before]
        assert written and max(written) <= 12, written
        assert common.files_for(edges, 10) == 40 and common.files_for(edges, 1000) == 12
    finally:
        for k, v in kept.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_a_refused_pair_with_the_smallest_of_a_run_is_not_sent_again(spark):
    """The smallest id of a run has been compared with every other; only the others are sent to be compared with each other."""

    class Never(links.Matcher):
        def sketch(self, texts):
            keys = np.array([[1], [1], [2], [2], [2]], np.int64)[[int(t) for t in texts]]
            return keys, np.zeros((len(texts), 1), np.uint8)

        def check(self, x, y):
            return False

    runs = spark.createDataFrame([(1, 0), (1, 1), (2, 2), (2, 3), (2, 4)], "key long, id long")
    payload = spark.createDataFrame([(i, str(i)) for i in range(5)], "id long, text string")
    root = shared_dir(spark).removeprefix("file:")
    before = set(glob.glob(f"{root}/dealt-*"))
    assert links.linked_classes(runs, payload, Never).count() == 0
    (written,) = set(glob.glob(f"{root}/dealt-*")) - before
    assert sorted((r["key"], r["id"]) for r in spark.read.parquet(written).collect()) == [(2, 3), (2, 4)]


def test_pairs_checked_together_and_one_by_one():
    rng = random.Random(5)
    lines = ["".join(rng.choice("abé😀 ") for _ in range(rng.randint(8, 60))) for _ in range(40)] + ["-" * 8, "-" * 30, "xy" * 6000]
    lines += [x[:-1] + "!" for x in lines]
    matcher = line_dedup.JaccardMatcher(8, 0.8, 16, 4)
    pairs = list(itertools.product(lines, lines))
    sets = [{x[i : i + 8] for i in range(len(x) - 7)} for x in lines]
    want = [len(a & b) >= 0.8 * len(a | b) for a, b in itertools.product(sets, sets)]
    assert list(matcher.check_all(pairs)) == want == [matcher.check(x, y) for x, y in pairs]
    low = matcher.hashes.least_of_all(lines, chars=100)
    assert (low == np.concatenate([matcher.hashes.least([x]) for x in lines], axis=1)).all()
