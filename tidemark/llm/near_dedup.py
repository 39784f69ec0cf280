"""Near-duplicate documents by Order MinHash.

A text is the sequence of its k-word shingles, each labelled with its occurrence number.
A sketch holds the ``take`` shingles with the smallest hash values under one hash
function, in the order in which they stand in the text; two texts are candidates if any
sketch is equal.  Keeping the order makes the sketches sensitive to edit similarity: a
text with the same shingles in another order gives other sketches.

Candidates are verified by a banded alignment of the shingle sequences: with m shingles
in the longest common subsequence, texts of p and q shingles are near if
``m / (p + q - m) >= threshold``.  Matches further from the diagonal than the threshold
allows are outside the band.  Near-duplicates are linked into classes; equal texts are one item.

Cases: a null text counts as empty, and empty texts are copies of each other; texts of
fewer than k words are one shingle; a row without an id is kept only if no row of its
class has one (``class_id`` is null then), and any 64-bit number is an id; rows that repeat
an id and a text share a decision; an empty table gives an empty result; other columns are
ignored.  Texts are
told apart by 64-bit hashes.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import files_for, free_name, materialize, row_order, text_or_empty
from tidemark.llm.links import TEXT_ROWS, Matcher, candidate_runs, linked_classes

_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD6E8FEB86659FD93)
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


class _WordHash(dict):
    def __missing__(self, word):
        if len(self) > 1_000_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return h ^ (h >> np.uint64(29))


def rolling(chars: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k values from each position on (k >= 1), by doubling; as wide as the values, unsigned."""
    whole, done = None, 0
    h, width = chars, 1
    number, p = chars.dtype.type, int(_BASE)
    while True:
        p %= 2 ** (8 * chars.itemsize)
        if k & width:
            if whole is None:
                whole = h
            else:
                n = len(chars) - done - width + 1
                whole = whole[:n] * number(p) + h[done : done + n]
            done += width
        width *= 2
        if width > k:
            return whole
        n = len(h) - width // 2
        if n <= 0:
            return np.zeros(0, chars.dtype)
        h = h[:n] * number(p) + h[width // 2 : width // 2 + n]
        p *= p


def shingle_hashes(words: list[str], k: int, hashes: dict) -> np.ndarray:
    """Hashes of the k-word shingles in text order; all words are one shingle if there are fewer."""
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - k + 1) if len(h) else 0
    out = np.zeros(n, np.uint64)
    for j in range(min(k, len(h))):
        out = out * _BASE + h[j : j + n]
    return mixed(out)


def hash_functions(sketches: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    factors = rng.integers(1, 2**63, sketches, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return factors, rng.integers(0, 2**63, sketches, dtype=np.uint64)


def order_minhash_signer(k: int, take: int, sketches: int):
    """A signer of ``sketches`` ordered minimum samples for each text."""

    def make():
        hashes = _WordHash()
        factors, shifts = hash_functions(sketches)

        def sign(texts):
            parts = [shingle_hashes(t.split(), k, hashes) for t in texts]
            rows = np.flatnonzero([len(p) > 0 for p in parts])
            if not len(rows):
                return np.zeros(0, np.int64), np.zeros(0, np.uint64)
            keys = np.concatenate([_sketch([parts[i] for i in rows[a:b]], factors, shifts, take)[0] for a, b in _blocks(parts, rows)], axis=1)
            return np.tile(rows, sketches), keys.ravel()

        return sign

    return make


def _blocks(parts, rows, size: int = 30_000):
    """Ranges of rows of about ``size`` shingles, which stay in the processor's cache."""
    start = total = 0
    for at, i in enumerate(rows):
        total += len(parts[i])
        if total >= size:
            yield start, at + 1
            start, total = at + 1, 0
    if start < len(rows):
        yield start, len(rows)


def _sketch(parts, factors, shifts, take) -> tuple[np.ndarray, np.ndarray]:
    """Keys and smallest hashes, one row a sketch and one column a text."""
    lengths = np.array([len(p) for p in parts])
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    segment = np.repeat(np.arange(len(parts)), lengths)
    h = np.concatenate(parts)
    # occurrence number of a shingle within its text
    order = np.lexsort((h, segment))
    hs, ss = h[order], segment[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (hs[1:] != hs[:-1]) | (ss[1:] != ss[:-1])
    first = np.maximum.accumulate(np.where(fresh, np.arange(len(h)), 0))
    occurrence = np.empty(len(h), np.uint64)
    occurrence[order] = (np.arange(len(h)) - first).astype(np.uint64)
    h = mixed(h + occurrence * _BASE)
    index = np.arange(len(h), dtype=np.int64)
    keys = np.empty((len(factors), len(parts)), np.uint64)
    least = np.empty((len(factors), len(parts)), np.uint64)
    for j, (f, s) in enumerate(zip(factors, shifts)):
        x = (h ^ s) * f
        chosen = np.empty((take, len(parts)), np.int64)
        for t in range(take):
            low = np.minimum.reduceat(x, starts)
            at = np.minimum.reduceat(np.where(x == low[segment], index, len(h)), starts)
            chosen[t] = np.where(low == _TOP, -1, at)
            x[at] = _TOP
            if not t:
                least[j] = low
        chosen.sort(axis=0)
        key = np.full(len(parts), np.uint64(j + 1) * _MIX)
        for row in chosen:
            key = mixed(key * _BASE + np.where(row < 0, np.uint64(0), h[row]))
        keys[j] = key
    return keys, least


def common_in_order(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Length of the longest common subsequence with matches at most ``band`` off the diagonal.

    Common ends are taken off first; the middle is aligned with one bit a column, row by row.
    """
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    head = int(differ[0]) if len(differ) else n
    a, b, n = a[head:], b[head:], n - head
    differ = np.flatnonzero(a[::-1][:n] != b[::-1][:n])
    tail = int(differ[0]) if len(differ) else n
    a, b = a[: len(a) - tail].tolist(), b[: len(b) - tail].tolist()
    at: dict[int, int] = {}
    for j, v in enumerate(b):
        at[v] = at.get(v, 0) | 1 << j
    full = (1 << len(b)) - 1
    width = (1 << (2 * band + 1)) - 1
    state = full
    for i, v in enumerate(a):
        m = at.get(v, 0)
        if m:
            m &= width << i >> band
            u = state & m
            state = ((state + u) | (state - u)) & full
    return head + tail + len(b) - state.bit_count()


def aligned_similarity(a: np.ndarray, b: np.ndarray, threshold: float) -> float:
    """m / (p + q - m), or 0.0 as soon as it is known to be under the threshold."""
    p, q = len(a), len(b)
    need = math.ceil(threshold * (p + q) / (1 + threshold) - 1e-9)
    if not p or not q or min(p, q) < need:
        return 0.0
    ua, ub = np.unique(a), np.unique(b)
    if len(np.intersect1d(ua, ub, assume_unique=True)) + min(p - len(ua), q - len(ub)) < need:
        return 0.0
    m = common_in_order(a, b, p + q - 2 * need)
    return m / (p + q - m) if m >= need else 0.0


class AlignmentMatcher(Matcher):
    """Banded alignment of shingle sequences, after a look at the minimum hashes."""

    def __init__(self, k: int, threshold: float, take: int, sketches: int):
        self.k, self.threshold, self.take = k, threshold, take
        self.functions = hash_functions(sketches)
        self.hashes = _WordHash()
        # so far under the threshold that a pair at it is missed less often than by the sketches themselves
        self.stages = [(sketches, threshold - 5.5 * math.sqrt(threshold * (1 - threshold) / sketches))]
        self.shingles = functools.lru_cache(maxsize=512)(lambda text: shingle_hashes(text.split(), k, self.hashes))

    def sketch(self, texts):
        parts = [shingle_hashes(t.split(), self.k, self.hashes) for t in texts]
        keys, least = _sketch(parts, *self.functions, self.take)
        return np.ascontiguousarray(keys.T), np.ascontiguousarray((least.T >> np.uint64(32)).astype(np.uint8))

    def check(self, x, y):
        return aligned_similarity(self.shingles(x), self.shingles(y), self.threshold) >= self.threshold


def _classified(documents, k, threshold, take, sketches, id_col, text_col) -> DataFrame:
    """(doc_id, id, class_id, kept, class_size) of each row; id is the hash of its text."""
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    docs = docs.withColumn("id", F.xxhash64("text"))
    slim = docs.select("doc_id", "id")
    runs = materialize(
        candidate_runs(docs.select("id", "text"), order_minhash_signer(k, take, sketches)), "near-runs"
    )
    items = slim.groupBy("id").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"))
    wanted = runs.select("id").distinct().join(items.drop("n"), "id").select(F.col("id").alias("item"), "rep")
    payload = materialize(
        docs.join(wanted, (F.col("id") == F.col("item")) & F.col("doc_id").eqNullSafe(F.col("rep")))
        .groupBy("id")
        .agg(F.first("text").alias("text")),
        "near-texts",
        files=files_for(runs, TEXT_ROWS),
    )
    classes = linked_classes(runs, payload, lambda: AlignmentMatcher(k, threshold, take, sketches))
    named = items.join(classes, "id", "left").withColumn("component", F.coalesce("component", "id"))
    first = F.min(F.struct(F.col("rep").isNull().alias("no_id"), "rep", F.col("id").alias("item")))
    of_class = named.groupBy("component").agg(first.alias("first"), F.sum("n").alias("class_size"))
    by_text = named.join(of_class, "component").select("id", F.col("first.rep").alias("class_id"), "first.item", "class_size")
    kept = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("id") == F.col("item"))
    return slim.join(by_text, "id").withColumn("kept", kept).drop("item")


def near_dedup(
    documents: DataFrame,
    k: int = 5,
    threshold: float = 0.8,
    take: int = 4,
    sketches: int = 24,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: doc_id, class_id (smallest id of its class), kept, class_size.

    At a similarity of 0.8 a pair shares a given sketch with probability of about 0.8 ** take,
    and none of them with about 3e-6 (take 4, 24 sketches).
    """
    found = _classified(documents, k, threshold, take, sketches, id_col, text_col)
    return found.select("doc_id", "class_id", "kept", "class_size")


def keep_representatives(
    documents: DataFrame,
    k: int = 5,
    threshold: float = 0.8,
    take: int = 4,
    sketches: int = 24,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One document of each class, with its own columns; of rows that repeat id and text one stays."""
    found = _classified(documents, k, threshold, take, sketches, id_col, text_col)
    reps = found.where("kept").select("doc_id", "id").distinct().alias("r")
    h, rid, n = F.xxhash64(text_or_empty(text_col)), F.col(id_col).cast("long"), free_name(documents, "n")
    here = (F.xxhash64(text_or_empty(f"d.{text_col}")) == F.col("r.id")) & F.col(f"d.{id_col}").cast("long").eqNullSafe(F.col("r.doc_id"))
    same = F.row_number().over(Window.partitionBy(rid, h).orderBy(row_order(documents)))
    kept = documents.alias("d").join(reps, here, "left_semi").select("d.*")
    return kept.withColumn(n, same).where(F.col(n) == 1).drop(n)
