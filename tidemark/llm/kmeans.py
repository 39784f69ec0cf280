"""Centroid clustering with heap-ordered bounds, in exact integers.

Vectors are quantised to integers and lie in blocks of some thousands, each a row of a
written table.  A block keeps a heap for each cluster with the gaps of its vectors: the
distance to the second nearest centroid less that to the own one, plus the cluster's
accumulated drift at that time.  A cluster's drift grows in each round by the way of its
own centroid and the longest way of another one, so as long as a vector's entry is above
the drift, no other centroid can be as near.  In a round only entries that the drift has
reached are popped, compared with all centroids in exact integers, and pushed again.

A round is a narrow map over the blocks: nothing is shuffled but sums of the vectors that
changed their cluster, k by dimensions numbers a block at most, which Spark adds up
exactly.  k centroids come to the driver, nothing that grows with the vectors.  Blocks are
written to the shared folder after each round, so a lost executor repeats one round of
its blocks.

Cases: vectors that are null, of another dimension or hold null or non-finite components
take no part, nor do those with a quantised component so large that a squared distance
would not fit into 64 bits (beyond 2^27 at 64 dimensions); null ids are kept and count as the word null in the hash
that picks the first centroids; rows that repeat an id are vectors of their own; with
fewer vectors than k there are fewer clusters; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialize

BLOCK = 8192

_STATE = (
    "ids array<long>, width int, points binary, cluster binary, sizes binary, members binary, gaps binary, "
    "scanned long, moves array<struct<cluster:int,n:long,sums:array<long>>>"
)
_MOVE = pa.struct([("cluster", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])
_SCHEMA = pa.schema(
    [("ids", pa.list_(pa.int64())), ("width", pa.int32())]
    + [(c, pa.binary()) for c in ("points", "cluster", "sizes", "members", "gaps")]
    + [("scanned", pa.int64()), ("moves", pa.list_(_MOVE))]
)


def largest_component(dim: int) -> int:
    """Components up to this keep every squared distance within 62 bits."""
    return math.isqrt((1 << 60) // dim)


def squared_distances(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact int64 squared distances, one row a point."""
    top = max(int(np.abs(points).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    kind = np.float64 if 4 * points.shape[1] * top * top < 1 << 53 else np.int64  # doubles are exact up to there
    x, c = points.astype(kind), centroids.astype(kind)
    return ((x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)).astype(np.int64)


class Block:
    """Points of a block, their clusters and one heap of (gap, point) for each cluster."""

    def __init__(self, points: np.ndarray, k: int):
        self.points = points
        self.cluster = np.full(len(points), -1, np.int32)
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in range(k)]

    def expired(self, drift: np.ndarray) -> np.ndarray:
        """Pops the points whose gap the drift of their cluster has reached; at first, all points."""
        if len(self.cluster) and self.cluster[0] < 0:
            return np.arange(len(self.points))
        out = []
        for heap, reached in zip(self.heaps, drift):
            while heap and heap[0][0] <= reached:
                out.append(heapq.heappop(heap)[1])
        return np.array(sorted(out), np.int64)

    def rescan(self, which: np.ndarray, centroids: np.ndarray, drift: np.ndarray) -> None:
        """Exact nearest centroid of the given points (ties: the smaller number), with new gaps."""
        d = squared_distances(self.points[which], centroids)
        best = d.argmin(1)
        rows = np.arange(len(which))
        own = np.sqrt(d[rows, best].astype(np.float64))
        if len(centroids) > 1:
            d[rows, best] = np.iinfo(np.int64).max
            other = np.sqrt(d.min(1).astype(np.float64))
            gaps = other - own - 1e-9 * (other + own + 1) + drift[best]  # rounding is on the safe side
        else:
            gaps = np.full(len(which), np.inf)
        self.cluster[which] = best
        for gap, point, c in zip(gaps.tolist(), which.tolist(), best.tolist()):
            heapq.heappush(self.heaps[c], (gap, point))

    def moves(self, before: np.ndarray) -> list[dict]:
        """What each cluster wins and loses against the clusters before."""
        changed = np.flatnonzero(self.cluster != before)
        out = []
        for c in np.union1d(self.cluster[changed], before[changed]).tolist():
            if c >= 0:
                won, lost = changed[self.cluster[changed] == c], changed[before[changed] == c]
                sums = self.points[won].sum(0, dtype=np.int64) - self.points[lost].sum(0, dtype=np.int64)
                out.append({"cluster": c, "n": len(won) - len(lost), "sums": sums.tolist()})
        return out

    def row(self, ids, scanned: int, moves: list[dict]) -> tuple:
        order = [np.array([p for _, p in h], np.int32) for h in self.heaps]
        gaps = [np.array([g for g, _ in h], np.float64) for h in self.heaps]
        sizes = np.array([len(h) for h in self.heaps], np.int32)
        flat = (sizes, np.concatenate(order), np.concatenate(gaps))
        raw = [self.points.tobytes(), self.cluster.tobytes(), *(x.tobytes() for x in flat)]
        return (ids, self.points.itemsize, *raw, scanned, moves)

    @classmethod
    def of(cls, width: int, dim: int, points: bytes, cluster: bytes, sizes: bytes, members: bytes, gaps: bytes) -> Block:
        sizes = np.frombuffer(sizes, np.int32)
        out = cls(np.frombuffer(points, f"<i{width}").reshape(-1, dim), len(sizes))
        out.cluster = np.frombuffer(cluster, np.int32).copy()
        flat = list(zip(np.frombuffer(gaps, np.float64).tolist(), np.frombuffer(members, np.int32).tolist()))
        ends = np.cumsum(sizes).tolist()
        out.heaps = [flat[end - size : end] for end, size in zip(ends, sizes.tolist())]
        return out


def _narrow(points: np.ndarray) -> np.ndarray:
    top = int(np.abs(points).max(initial=0))
    return points.astype("<i1" if top < 128 else "<i2" if top < 1 << 15 else "<i4")


def quantised(vectors: DataFrame, dim: int, scale: float, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v array<double> of whole numbers) of the vectors that take part."""
    x = F.col("v").cast("array<double>")
    # null, NaN and infinite components fail the comparison too
    small = F.forall(x, lambda c: F.coalesce(F.abs(c) * scale < largest_component(dim), F.lit(False)))
    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))
    own = own.where((F.size("v") == dim) & small)
    return own.select("vec_id", F.transform(x, lambda c: F.floor(c * scale).cast("double")).alias("v"))


def first_centroids(points: DataFrame, k: int, seed: str) -> np.ndarray:
    """The k vectors with the smallest SHA-256 of seed and id."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))), 256)
    top = points.select(key.alias("key"), "v").orderBy("key", "v").limit(k).collect()  # k rows
    return np.array([r["v"] for r in top], np.int64)


def _round(blocks: DataFrame, dim: int, centroids: np.ndarray, drift: np.ndarray) -> DataFrame:
    """Blocks, or batches of points at first, to blocks with every point at its nearest centroid."""

    def assign(block: Block, ids) -> tuple:
        before = block.cluster.copy()
        which = block.expired(drift)
        if len(which):
            block.rescan(which, centroids, drift)
        return block.row(ids, len(which), block.moves(before))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if "points" in batch.schema.names:
                for row in batch.to_pylist():
                    block = Block.of(row["width"], dim, *(row[c] for c in ("points", "cluster", "sizes", "members", "gaps")))
                    yield _one(assign(block, row["ids"]))
                continue
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                flat = part.column("v").flatten().to_numpy(zero_copy_only=False)
                block = Block(_narrow(flat.reshape(-1, dim).astype(np.int64)), len(centroids))
                yield _one(assign(block, part.column("vec_id").to_pylist()))

    return blocks.mapInArrow(run, _STATE)


def _one(row: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _SCHEMA)], schema=_SCHEMA)


def _apply_moves(blocks: DataFrame, sums: list[list[int]], counts: list[int]) -> None:
    """Adds up what the clusters won and lost; k by dimensions numbers come to the driver."""
    moves = blocks.select(F.inline("moves"))
    wide = moves.select("cluster", "n", F.posexplode("sums").alias("d", "x"))
    total = wide.groupBy("cluster", "d").agg(F.sum(F.col("x").cast("decimal(20,0)")).alias("x"), F.sum("n").alias("n"))
    for r in total.collect():
        sums[r["cluster"]][r["d"]] += int(r["x"])
        if r["d"] == 0:
            counts[r["cluster"]] += r["n"]


def cluster_vectors(
    vectors: DataFrame,
    k: int = 16,
    rounds: int = 3,
    dim: int = 64,
    scale: float = 64.0,
    seed: str = "1",
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> tuple[DataFrame, np.ndarray, list[int]]:
    """Assignments (vec_id, cluster, distance), the final centroids, and the number of points scanned in each round.

    ``rounds`` times vectors are assigned and centroids become the floored means; then vectors
    are assigned once more.  ``distance`` is squared.
    """
    spark = vectors.sparkSession
    points = quantised(vectors, dim, scale, id_col, vector_col)
    centroids = first_centroids(points, k, seed)
    k = len(centroids)
    if not k:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long"), np.zeros((0, dim), np.int64), []
    drift = np.zeros(k)
    sums, counts = [[0] * dim for _ in range(k)], [0] * k
    blocks, scanned = points, []
    for turn in range(rounds + 1):
        blocks = materialize(_round(blocks, dim, centroids, drift), "cluster-blocks")
        scanned.append(blocks.agg(F.coalesce(F.sum("scanned"), F.lit(0))).head()[0])
        if turn == rounds:
            break
        _apply_moves(blocks, sums, counts)
        new = np.array([[x // n for x in row] if n else old for row, n, old in zip(sums, counts, centroids.tolist())], np.int64)
        way = np.sqrt(((new - centroids).astype(np.float64) ** 2).sum(1))
        others = np.array([np.delete(way, c).max(initial=0.0) for c in range(k)])
        drift = (drift + way + others) * (1 + 1e-12)
        centroids = new

    def distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                x = np.frombuffer(row["points"], f"<i{row['width']}").reshape(-1, dim).astype(np.int64)
                cluster = np.frombuffer(row["cluster"], np.int32)
                d = ((x - centroids[cluster]) ** 2).sum(1)
                cols = [pa.array(row["ids"], pa.int64()), pa.array(cluster), pa.array(d)]
                yield pa.RecordBatch.from_arrays(cols, names=["vec_id", "cluster", "distance"])

    found = blocks.select("ids", "width", "points", "cluster").mapInArrow(distances, "vec_id long, cluster int, distance long")
    return found, centroids, scanned


def digest(found: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Each vector with the inertia of its cluster and of all, and a hash of its centroid (k rows are joined)."""
    spark = found.sparkSession
    found = materialize(found, "clusters")
    named = [(c, hashlib.sha256(",".join(map(str, row)).encode()).hexdigest()) for c, row in enumerate(centroids.tolist())]
    hashes = spark.createDataFrame(named, "cluster int, centroid_sha256 string")
    own = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("s"))
    whole = own.agg(F.sum("s").cast("long").alias("inertia"))
    of_cluster = own.select("cluster", F.col("s").cast("long").alias("cluster_inertia")).crossJoin(whole)  # k rows and one
    sizes = F.broadcast(of_cluster.join(hashes, "cluster"))
    return found.join(sizes, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
