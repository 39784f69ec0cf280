"""Toxicity chain (held-out accuracy, odd rows) and packing (exact round trip, brute-force sums)."""

import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
from tests.llm.util import ODD, docs

from tidemark.llm import packing, registry, toxicity

SF = "/root/testdata/sf0.1"


def test_toxicity_held_out(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    train, test = labels.where("doc_id % 4 > 0"), labels.where("doc_id % 4 = 0")
    got = toxicity.classify(documents, train).join(test.select("doc_id", "toxic").withColumnRenamed("toxic", "y"), "doc_id")
    rows = got.collect()
    hit = sum(r["toxic"] and r["y"] for r in rows)
    assert hit >= 0.85 * sum(r["y"] for r in rows)
    assert sum(r["toxic"] and not r["y"] for r in rows) <= 0.03 * len(rows)


def test_toxicity_chain_feeds_forward(spark):
    data = [(i, ("bad " if i % 3 == 0 else "good ") + f"filler{i % 7} text", "s") for i in range(120)]
    labels = spark.createDataFrame([(i, int(i % 3 != 0), int(i % 3 == 0)) for i in range(120)], "doc_id long, quality int, toxic int")
    chain = toxicity.fit_chain(docs(spark, data), labels)
    assert chain.categories == ["low_quality", "toxic"]
    assert len(chain.weights[1]) == len(chain.weights[0]) + 1 and chain.weights[1][-1] > 0
    p = {r["doc_id"]: r["p_toxic"] for r in toxicity.score(docs(spark, data), chain).collect()}
    assert all((p[i] > 0.5) == (i % 3 == 0) for i in range(120))
    kept = toxicity.keep_clean(docs(spark, data), labels)
    assert kept.columns == docs(spark, data).columns and kept.count() == 80


def test_toxicity_chain_against_plain_numpy(spark):
    rng = random.Random(7)
    words = ["bad", "awful", "good", "fine", "plain", "stone", "river", "cloud"]
    data = [(i, " ".join(rng.choices(words, k=rng.randint(3, 12))) + "!" * (i % 4) + str(i % 5), "s") for i in range(150)]
    marks = [(i, int("awful" not in t), int("bad" in t and rng.random() < 0.9)) for i, t, _ in data]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    chain = toxicity.fit_chain(docs(spark, data), labels, ridge=0.5, folds=3)
    got = {r["doc_id"]: (r["p_low_quality"], r["p_toxic"]) for r in toxicity.score(docs(spark, data), chain).collect()}

    def fit(x, y):
        w, pull = np.zeros(x.shape[1]), np.full(x.shape[1], 0.5)
        pull[0] = 1e-6
        for _ in range(60):
            p = 1 / (1 + np.exp(-x @ w))
            w = w - np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + np.diag(pull), x.T @ (p - y) + pull * w)
        return w

    present = np.zeros((len(data), len(chain.vocabulary)))
    for i, (_, text, _) in enumerate(data):
        letters = ["".join(c for c in w if c.isalpha()) for w in text.split()]
        for w in letters:
            for f in (w, *[w[:k] + "*" for k in (4, 5, 6) if len(w) >= k]):
                if f in chain.vocabulary:
                    present[i, chain.vocabulary[f]] = 1
    dense = np.array([toxicity.measures(t, len(t.split())) for _, t, _ in data])
    x = np.hstack([np.ones((len(data), 1)), (dense - dense.mean(0)) / (dense.std(0) + 1e-9), present])
    y = np.array([[1 - q, t] for _, q, t in marks], float)
    fold = np.array([i * 2654435761 % 2**32 * 3 >> 32 for i, _, _ in marks])
    first = fit(x, y[:, 0])
    held = np.concatenate([[0.0] * len(data)])
    for f in range(3):
        held[fold == f] = x[fold == f] @ fit(x[fold != f], y[fold != f, 0])
    second = fit(np.hstack([x, np.clip(held, -12, 12)[:, None]]), y[:, 1])
    z = x @ first
    want = np.column_stack([z, np.hstack([x, np.clip(z, -12, 12)[:, None]]) @ second])
    want = 1 / (1 + np.exp(-want))
    assert np.allclose([got[i] for i, _, _ in data], want, atol=1e-4)
    other = docs(spark, data).withColumnsRenamed({"text": "body", "doc_id": "key"})
    named = labels.withColumnRenamed("doc_id", "key")
    again = toxicity.classify(other, named, ridge=0.5, folds=3, id_col="key", text_col="body")
    assert again.where("toxic").count() == toxicity.classify(docs(spark, data), labels, ridge=0.5, folds=3).where("toxic").count()


def test_toxicity_odd_rows(spark):
    labels = spark.createDataFrame([(None, 1, 1), (3, None, 1), (4, 1, 0), (4, 1, 0)], "doc_id long, quality int, toxic int")
    got = toxicity.classify(docs(spark, ODD).withColumnRenamed("lang", "toxic"), labels)
    assert sorted(str(r["doc_id"]) for r in got.collect()) == sorted(str(r[0]) for r in ODD)
    assert not any(r["toxic"] for r in got.collect())
    assert toxicity.classify(docs(spark, ODD), labels.limit(0)).where("toxic").count() == 0
    assert toxicity.classify(docs(spark, ODD).limit(0), labels).count() == 0


def test_best_subset_against_brute_force():
    rng = random.Random(5)
    for _ in range(200):
        items = [rng.randint(1, 30) for _ in range(rng.randint(0, 9))]
        room = rng.randint(0, 90)
        got = packing.best_subset(Counter(items), room)
        sums = {sum(c) for n in range(len(items) + 1) for c in itertools.combinations(items, n)}
        assert sum(got) == max(s for s in sums if s <= room)
        assert not Counter(got) - Counter(items)


def check_pieces(pieces, texts, encode, capacity=1024):
    """Every id in one piece, checksums right, offsets gapless; returns the padding."""
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_seq[p["sequence_id"]].append(p)
    for i, text in texts.items():
        ids = np.array([*encode(text), 0], dtype="<u4")
        at = 0
        for p in sorted(by_doc.pop(i), key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids)
    assert not by_doc
    padding = 0
    for s in by_seq.values():
        s.sort(key=lambda p: p["offset"])
        total = 0
        for p in s:
            assert p["offset"] == total
            total += p["length"]
        assert total <= capacity
        padding += 0 if total & (total - 1) == 0 else capacity - total
    return padding


def library_encode(path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def test_packing_round_trip(spark):
    path, _ = registry.byte_bpe()
    rows = registry.QUERIES["op5_packing"](spark, "/root/testdata/sf0.001").collect()
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert check_pieces(rows, texts, library_encode(path)) == 0


def test_packing_odd_rows_and_sequences(spark):
    path, pattern = registry.byte_bpe()
    odd = {1: None, 2: "", 3: "x" * 50_000, 4: " " * 30_000, 5: "a<|endoftext|>b", 6: "\u0000é😀\n\n  '' 's", None: "no id"}
    df = docs(spark, [(i, t, None) for i, t in odd.items()]).withColumnRenamed("lang", "offset")
    pieces = packing.pack_documents(df, path, pattern, with_ids=True)
    assert check_pieces(pieces.collect(), {i: t or "" for i, t in odd.items()}, library_encode(path)) == 0
    whole = packing.sequences(pieces).collect()
    assert all(len(r["ids"]) == 4 * r["length"] and r["padding"] == 0 for r in whole)
    assert packing.pack_documents(df.limit(0), path, pattern).count() == 0


def test_packing_added_tokens_as_by_the_unmodified_library(spark, tmp_path):
    from tokenizers import Tokenizer

    path, _ = registry.byte_bpe()
    plain = Tokenizer.from_file(path)
    texts = {1: "a<|endoftext|>b", 2: "a < b", 3: "<|endoftext|><|endoftext|> c", 4: "<|endoftext"}
    docs(spark, [(i, t, None) for i, t in texts.items()]).write.parquet(f"{tmp_path}/documents.parquet")
    rows = registry.QUERIES["op5_packing"](spark, str(tmp_path)).collect()
    assert {r["doc_id"]: r["doc_tokens"] for r in rows}[1] == 4
    check_pieces(rows, texts, lambda t: plain.encode(t, add_special_tokens=False).ids)


def test_packing_repeated_rows_and_windows_from_the_subset_sums(spark):
    path, pattern = registry.byte_bpe()
    text = "some words that repeat " * 20
    df = docs(spark, [(7, text, None)] * 30).coalesce(1)
    rows = packing.pack_documents(df, path, pattern).collect()
    total = rows[0]["doc_tokens"]
    assert sum(r["length"] for r in rows) == 30 * total
    by_seq = defaultdict(int)
    for r in rows:
        by_seq[r["sequence_id"]] += r["length"]
    assert sum(n != 1024 for n in by_seq.values()) == bin(30 * total % 1024).count("1")
    assert all(n & (n - 1) == 0 for n in by_seq.values())


def test_packing_keeps_best_windows_and_cuts_one_piece_each():
    lengths = [600] * 40 + [300] * 40 + [130] * 40
    data = [(i, "x" * (n - 1)) for i, n in enumerate(lengths)]
    out = list(packing.pack_partition(iter(data), lambda t: [1] * len(t), 0, 1024, 64, 0))
    whole = sum(p[2] == p[4] for p in out)
    assert len(out) - len(lengths) <= len({p[5] for p in out})  # one cut a window at most
    assert whole >= len(lengths) / 2
