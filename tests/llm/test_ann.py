"""Hash-prefix forest: recall against brute force, exact scores, odd vectors."""

import math

import numpy as np

from tidemark.llm import ann, registry


def exact(rows, every=20, k=20):
    rows = [(i, v) for i, v in rows]
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], dtype=np.float64)
    out = {}
    for i, q in zip(ids, x):
        if i % every == 0:
            s = [(-math.fsum((x[j] * q).tolist()), int(ids[j])) for j in range(len(ids)) if ids[j] != i]
            out[int(i)] = [(j, -v) for v, j in sorted(s)[:k]]
    return out


def test_recall(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = exact(rows)
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    got = ann.nearest_neighbours(vectors, capacity=200, least=20).collect()
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append(r)
    assert by.keys() == want.keys()
    hit = 0
    for q, found in by.items():
        found.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in found] == list(range(1, 21))
        assert [(-r["score"], r["vec_id"]) for r in found] == sorted((-r["score"], r["vec_id"]) for r in found)
        truth = dict(want[q])
        assert all(r["score"] == truth[r["vec_id"]] for r in found if r["vec_id"] in truth)
        hit += sum(r["vec_id"] in truth for r in found)
    assert hit >= 0.9 * 20 * len(want)


def test_recall_of_the_registered_query(spark):
    sf = "/root/testdata/sf0.1"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert len(rows) >= 2000
    want = exact(rows)
    got = {}
    for r in registry.QUERIES["op8_ann"](spark, sf).collect():
        got.setdefault(r["query_id"], set()).add((r["vec_id"], r["score"]))
    assert got.keys() == want.keys()
    assert sum(len(got[q] & set(found)) for q, found in want.items()) >= 0.9 * 20 * len(want)


def test_blocks_and_parts_are_merged(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((700, 8)).astype(np.float32).astype(float)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(20, x[20].tolist()), (5, x[5].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest_neighbours(df, every=7, k=5, capacity=90, part=11, share=1.0).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    want = exact(rows[:700], every=7, k=5)
    assert {q: [found[n] for n in sorted(found)] for q, found in got.items()} == want


def test_query_is_whole(spark):
    out = registry.QUERIES["op8_ann"](spark, "/root/testdata/sf0.001")
    n = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").where("vec_id % 20 = 0").count()
    assert out.count() == 20 * n


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [1.0, None])]
    rows += [(7, [inf, 0.0]), (8, [9.0, 1.0]), (None, [1.0, 1.0]), (20, [1.0, 2.0, 3.0]), (40, [1.0, 1.0]), (1, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as block", "2 as score")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.nearest_neighbours(df).collect())
    assert got == [
        (0, 1, 8, 9.0), (0, 2, 40, 1.0), (0, 3, 1, 0.5), (0, 4, 2, 0.5),
        (40, 1, 8, 10.0), (40, 2, 0, 1.0), (40, 3, 1, 1.0), (40, 4, 2, 1.0),
    ]
    assert ann.nearest_neighbours(df.limit(0)).count() == 0
