"""Suffix-order substring dedup against a brute-force index of all windows."""

import hashlib
import random
from collections import Counter

import numpy as np
from tests.llm.util import ODD, SMALL, docs

from tidemark.llm import substring_dedup as sd


def brute(rows, length=50):
    first = {}
    for i, text in rows:
        raw = (text or "").encode()
        for p in range(len(raw) - length + 1):
            w = raw[p : p + length]
            first[w] = min(first.get(w, np.inf), np.inf if i is None else i)
    out = []
    for i, text in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            if first[raw[p : p + length]] < (np.inf if i is None else i):
                gone[p : p + length] = b"\1" * length
        kept = bytes(c for c, g in zip(raw, gone) if not g)
        spans = sum(g and (n == 0 or not gone[n - 1]) for n, g in enumerate(gone))
        out.append((i, len(raw), len(raw) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def got(df):
    return Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect())


def test_longest_previous_factor():
    rng = np.random.default_rng(2)
    rows = rng.integers(0, 2, (120, 6)).astype(np.uint8) + 97
    owners = rng.integers(0, 9, 120)
    lpf = sd.longest_previous_factor(rows, owners)
    for i in range(120):
        best = 0
        for j in np.flatnonzero(owners < owners[i]):
            d = np.flatnonzero(rows[i] != rows[j])
            best = max(best, int(d[0]) if len(d) else 6)
        assert lpf[i] == best


def test_rolling_and_window_min():
    x = np.arange(1, 60, dtype=np.uint64) ** 3 % 17
    for k in (1, 2, 3, 7, 20, 25):
        h = sd.rolling(x, k)
        assert len(h) == len(x) - k + 1
        same = [(i, j) for i in range(len(h)) for j in range(i) if (x[i : i + k] == x[j : j + k]).all()]
        assert all(h[i] == h[j] for i, j in same)
        assert (sd.window_min(x, k) == [x[i : i + k].min() for i in range(len(x) - k + 1)]).all()


def test_whole_table_against_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    out = got(sd.dedup_substrings(spark.read.parquet(f"{SMALL}/documents.parquet").repartition(5)))
    assert out == brute(rows)


def shuffled(seed):
    rng = random.Random(seed)
    passages = ["".join(rng.choice("abcé \n") for _ in range(rng.randint(40, 120))) for _ in range(12)]
    rows = []
    for i in range(90):
        parts = [rng.choice(passages) if rng.random() < 0.6 else "".join(rng.choice("xyz ") for _ in range(30)) for _ in range(5)]
        rows.append((rng.randint(-5, 80) if rng.random() < 0.95 else None, "".join(parts)))
    return rows + [rows[3], (81, rows[0][1]), (81, rows[1][1]), (82, "a" * 500), (83, "b" + "a" * 300)]


def test_passages_repeats_and_hot_keys(spark):
    rows = shuffled(6)
    df = docs(spark, [(i, t, "s") for i, t in rows]).withColumnRenamed("lang", "rid").repartition(6)
    want = brute(rows)
    assert got(sd.dedup_substrings(df)) == want
    assert got(sd.dedup_substrings(df, hot=2, n_buckets=3)) == want


def test_odd_rows(spark):
    df = docs(spark, ODD)
    assert got(sd.dedup_substrings(df)) == brute([(i, t) for i, t, _ in ODD])
    kept = sd.dedup_substrings(df, with_text=True).where("doc_id = 3").first()["kept"]
    assert bytes(kept) == b"same text here"
    assert sd.dedup_substrings(df.limit(0)).count() == 0


def test_ids_of_all_sizes_and_rows_without_one(spark):
    rng = random.Random(5)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(90))
    ids = [2**62 + 5, 2**62 + 6, 2**63 - 2, 2**63 - 1, -(2**63), 0, None, None, 2**62 - 1]
    rows = [(i, f"{n} {passage} {n * n}") for n, i in enumerate(ids)] + [(None, passage + " ends"), (2**62 + 5, passage)]
    df = docs(spark, [(i, t, "s") for i, t in rows]).repartition(4)
    want = brute([(2**63 - 1 if i is None else i, t) for i, t in rows])
    found = sd.dedup_substrings(df)
    assert {r["doc_id"] for r in found.collect()} == set(ids)
    assert got(found.na.fill(2**63 - 1, ["doc_id"])) == want
    assert got(sd.dedup_substrings(df, hot=1, n_buckets=3).na.fill(2**63 - 1, ["doc_id"])) == want


def test_exchange_files_go_with_each_step(spark, monkeypatch):
    """Before a step is read again, the exchanges of its write are gone, whether or not the driver has collected its garbage."""
    shuffles = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses()
    left = []
    real = sd.materialize

    def counted(df, *args, **options):
        before = shuffles.size()
        out = real(df, *args, **options)
        left.append(shuffles.size() - before)
        return out

    monkeypatch.setattr(sd, "materialize", counted)
    df = docs(spark, ODD).repartition(3)
    assert got(sd.dedup_substrings(df)) == brute([(i, t) for i, t, _ in ODD])
    assert len(left) == 3 and max(left) <= 0, left
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
