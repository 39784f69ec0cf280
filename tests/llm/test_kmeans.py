"""Heap-bounded clustering against plain rounds, on given and on clustered vectors."""

import hashlib
import math
import random

import numpy as np
from tests.llm.util import SMALL

from tidemark.llm import kmeans, registry


def plain(rows, k=16, rounds=3, dim=64, scale=64.0):
    """(id, cluster, distance) and centroids by comparing all with all."""
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(scale * x) for x in v]))
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'null' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:k]]

    def nearest(v):
        d = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in centroids]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        own = [nearest(v)[0] for _, v in kept]
        for c in range(len(centroids)):
            mine = [v for (_, v), o in zip(kept, own) if o == c]
            if mine:
                centroids[c] = [sum(x) // len(mine) for x in zip(*mine)]
    return [(i, *nearest(v)) for i, v in kept], centroids


def text(rows):
    return sorted(map(repr, rows))


def test_query_on_a_whole_table(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    want, centroids = plain(rows)
    got = registry.QUERIES["op13_centroids"](spark, SMALL).collect()
    assert text((r["vec_id"], r["cluster"], r["distance"]) for r in got) == text(want)
    for r in got:
        assert r["inertia"] == sum(d for _, _, d in want)
        assert r["cluster_inertia"] == sum(d for _, c, d in want if c == r["cluster"])
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, centroids[r["cluster"]])).encode()).hexdigest()


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def test_bounds_spare_scans_on_clustered_vectors(spark):
    rng = random.Random(2)
    centres = [[rng.uniform(-9, 9) for _ in range(4)] for _ in range(6)]
    rows = [(i, [x + rng.gauss(0, 0.3) for x in centres[i % 6]]) for i in range(900)]
    found, centroids, scanned = kmeans.cluster_vectors(frame(spark, rows), k=6, rounds=5, dim=4)
    want, plain_centroids = plain(rows, k=6, rounds=5, dim=4)
    assert text(map(tuple, found.collect())) == text(want) and centroids.tolist() == plain_centroids
    assert scanned[0] == 900 and scanned[-1] < 450


def test_many_random_tables_and_ties(spark):
    rng = random.Random(4)
    for dim, spread in ((2, 1), (3, 40), (2, 3_000_000)):
        rows = [(rng.choice([None, *range(60)]), [rng.randint(-spread, spread) / 64 for _ in range(dim)]) for _ in range(150)]
        found, centroids, _ = kmeans.cluster_vectors(frame(spark, rows), k=5, rounds=4, dim=dim)
        want, plain_centroids = plain(rows, k=5, rounds=4, dim=dim)
        assert text(map(tuple, found.collect())) == text(want) and centroids.tolist() == plain_centroids


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [1.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, -2.5]), (None, [0.0, 0.0]), (7, [1.0, -2.5])]
    found, centroids, _ = kmeans.cluster_vectors(frame(spark, rows).selectExpr("*", "vec_id AS cluster", "embedding AS v"), k=16, dim=2)
    want, plain_centroids = plain(rows, dim=2)
    got = kmeans.digest(found, centroids).collect()
    assert text((r["vec_id"], r["cluster"], r["distance"]) for r in got) == text(want) and len(centroids) == 3
    huge = kmeans.cluster_vectors(frame(spark, [(1, [1e30, 0.0]), (2, [1.0, 2.0])]), dim=2)[0].collect()
    assert [r["vec_id"] for r in huge] == [2]
    found, centroids, _ = kmeans.cluster_vectors(frame(spark, rows[:6]), dim=2)
    assert kmeans.digest(found, centroids).count() == 0


def test_distances_are_exact():
    rng = np.random.default_rng(1)
    for top in (100, 1 << 27):
        x, c = rng.integers(-top, top, (20, 64)), rng.integers(-top, top, (5, 64))
        want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(p, q)) for q in c] for p in x]
        assert kmeans.squared_distances(x, c).tolist() == want
