"""Periodic runs against brute force, Lyndon arrays against their definition, and the query against a plain loop."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from tests.llm.util import ODD, SMALL, docs

from tidemark.llm import registry, runs


def plain_runs(x, least):
    """All (start, length, period) by trying every period."""
    out, n = set(), len(x)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            start = i
            while i + q < n and x[i] == x[i + q]:
                i += 1
            size = i + q - start
            if i > start and size >= max(least, 2 * q):
                y = x[start : start + size]
                if not any(y[p:] == y[:-p] for p in range(1, q)):
                    out.add((start, size, q))
            i += i == start
    return sorted(out)


def row_of(doc_id, text):
    words = runs.split_words(doc_id, (text or "").encode())
    if doc_id is not None and words and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g, n = zlib.crc32(str(doc_id).encode()) // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain_runs(words, 12)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    top = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
    return {
        "doc_id": doc_id,
        "n_runs": len(found),
        "start": top[0],
        "length": top[1],
        "period": top[2],
        "exponent_milli": 1000 * top[1] // top[2] if found else None,
        "runs_sha256": hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest(),
        "collapsed_sha256": hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest(),
    }


def key(r):
    return repr(sorted(r.items()))


def random_text(rng, size):
    x = []
    goal = rng.randint(0, size)
    while len(x) < goal:
        if x and rng.random() < 0.5:
            p = rng.randint(1, min(len(x), 14))
            for _ in range(rng.randint(1, 30)):
                x.append(x[-p])
        else:
            x.append(rng.randint(0, rng.choice([1, 3, 50])))
    return x


def test_lyndon_arrays():
    rng = random.Random(1)
    for _ in range(400):
        x = [rng.randint(1, rng.choice([1, 2, 3, 5])) for _ in range(rng.randint(0, 16))]
        want = []
        for i in range(len(x)):
            sizes = [j - i for j in range(i + 1, len(x) + 1) if all(x[i:j] < x[k:j] for k in range(i + 1, j))]
            want.append(max(sizes))
        assert runs.lyndon_array(x) == want


@pytest.mark.parametrize("least", [2, 3, 5, 12])
def test_runs_of_many_texts(least):
    rng = random.Random(least)
    for _ in range(250):
        texts = [random_text(rng, 70) for _ in range(rng.randint(1, 4))]
        part = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        got = runs.find_runs(np.array([w for t in texts for w in t], np.int64), part, least)
        want, at = [], 0
        for t in texts:
            want += [(s + at, n, q) for s, n, q in plain_runs(t, least)]
            at += len(t)
        assert [tuple(r) for r in got.tolist()] == want


def test_window_clashes_change_nothing(monkeypatch):
    rng = random.Random(3)
    x = random_text(rng, 400)
    part = np.zeros(len(x), np.int64)
    want = runs.find_runs(np.array(x), part, 12).tolist()
    monkeypatch.setattr(runs, "covered", lambda words, part, width: np.ones(len(words), bool))
    assert runs.find_runs(np.array(x), part, 12).tolist() == want


def test_query_on_a_whole_table(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    short = [r for r in rows if len(r["text"] or "") < 6000]  # the plain loop is quadratic
    got = {r["doc_id"]: r.asDict() for r in registry.QUERIES["op11_runs"](spark, SMALL).collect()}
    assert len(got) == len(rows) and len(short) > 100
    for r in short:
        assert got[r["doc_id"]] == row_of(r["doc_id"], r["text"])
    assert sum(g["n_runs"] for g in got.values()) > 10


def test_odd_rows_and_general_interface(spark):
    periodic = [(11, "a b c " * 9 + "d", "a"), (12, "x y " * 20, None), (13, "to be " * 5, "a"), (14, "\u001c a\u001fb " * 13, "a")]
    rows = [(i, t, s) for i, t, s in ODD + periodic if i != 7]
    frame = docs(spark, rows)
    want = sorted(key(row_of(i, t)) for i, t, _ in rows)
    assert sorted(key(r.asDict()) for r in runs.digest(runs.collapse_runs(frame, words=runs.planted_words)).collect()) == want
    long = runs.collapse_runs(docs(spark, [(7, "word " * 30000, "a")])).collect()[0]
    assert [r.asDict() for r in long["runs"]] == [{"start": 0, "length": 30000, "period": 1}] and long["collapsed"] == "word"
    renamed = frame.withColumnRenamed("doc_id", "runs").withColumnRenamed("text", "collapsed").withColumnRenamed("source", "doc_id")
    assert runs.collapse_runs(renamed, id_col="runs", text_col="collapsed").count() == len(rows)
    assert runs.digest(runs.collapse_runs(frame.limit(0))).count() == 0
