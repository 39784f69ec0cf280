"""Fuzzy line deduplication by MinHash.

Lines are sets of k-character shingles.  Signatures of ``bands * rows`` minimum hashes
are cut into bands; lines that share a band are candidates, and exact Jaccard similarity
of the shingle sets decides.  Linked lines form components by union-find, equal lines
being one item, and of every component the first line stays: the one with the smallest
document id, then line number.

At a similarity of 0.8 a pair shares none of the 16 bands of 4 with probability 0.0002.

Lines under k characters have no shingles and are compared for equality only.

Cases: a null text has no lines; blank lines are always kept; a null id counts as the largest 64-bit number; rows that repeat id and text share their
decisions; an empty table gives an empty result; other columns are kept or ignored,
whatever their names.  Lines are told apart by 64-bit hashes.
"""

from __future__ import annotations

import functools
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import files_for, materialize, text_or_empty
from tidemark.llm.links import NUMBER_ROWS, TEXT_ROWS, Matcher, candidate_runs, linked_classes
from tidemark.llm.near_dedup import _MIX, mixed, rolling

_NO_ID = 2**63 - 1


class LineHashes:
    """Minimum hashes of the k-character shingles of lines, and the keys of their bands.

    A function multiplies a shingle's mixed hash by an odd number of its own; ``more`` functions follow those of the bands.
    """

    def __init__(self, k: int, bands: int, rows: int, more: int = 0, seed: int = 11):
        self.k, self.bands, self.rows = k, bands, rows
        self.factors = np.random.default_rng(seed).integers(1, 2**31, bands * rows + more, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        # glibc keeps freed memory of up to the largest size freed so far; else each block's arrays are new pages
        np.empty(16 << 20, np.uint8)

    def least(self, lines: list[str]) -> np.ndarray:
        """Minimum hashes, one row a function and one column a line; lines have k characters or more."""
        k = self.k
        lengths = np.array([len(x) for x in lines])
        chars = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
        h = rolling(chars + np.uint32(1), k)
        ends = np.cumsum(lengths)
        valid = np.ones(len(chars), bool)
        for j in range(1, k):
            valid[ends - j] = False
        h = h[valid[: len(h)]]
        for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
            h ^= h >> np.uint32(shift)
            h *= np.uint32(factor)
        h ^= h >> np.uint32(16)
        starts = np.concatenate([[0], np.cumsum(lengths - k + 1)[:-1]])
        low = np.empty((len(self.factors), len(lines)), np.uint32)
        x = np.empty_like(h)
        for j, factor in enumerate(self.factors):
            np.multiply(h, factor, out=x)
            np.minimum.reduceat(x, starts, out=low[j])
        return low

    def least_of_all(self, lines: list[str], chars: int = 100_000) -> np.ndarray:
        """``least`` by blocks of about ``chars`` characters, which stay in the processor's cache."""
        parts, at = [np.empty((len(self.factors), 0), np.uint32)], 0
        while at < len(lines):
            stop, total = at, 0
            while stop < len(lines) and (total < chars or stop == at):
                total += len(lines[stop])
                stop += 1
            parts.append(self.least(lines[at:stop]))
            at = stop
        return np.concatenate(parts, axis=1)

    def keys(self, low: np.ndarray) -> np.ndarray:
        """One row a band and one column a line."""
        bands = low[: self.bands * self.rows].reshape(self.bands, self.rows, -1)
        keys = np.empty((self.bands, low.shape[1]), np.uint64)
        keys[:] = (np.arange(1, self.bands + 1, dtype=np.uint64) * _MIX)[:, None]
        for j in range(self.rows):
            keys = mixed(keys * np.uint64(0xD6E8FEB86659FD93) + bands[:, j])
        return keys


def minhash_signer(k: int, bands: int, rows: int):
    """A signer of ``bands`` keys for each line of at least k characters."""

    def make():
        hashes = LineHashes(k, bands, rows)

        def sign(texts):
            index = np.array([i for i, t in enumerate(texts) if len(t) >= k], np.int64)
            keys = hashes.keys(hashes.least_of_all([texts[i] for i in index]))
            return np.tile(index, bands), keys.ravel()

        return sign

    return make


class JaccardMatcher(Matcher):
    """Exact Jaccard similarity of shingle sets (as 64-bit hashes), after a look at the minimum hashes."""

    #: shingle sets of lines up to so many characters are kept for later pairs
    SHORT = 8192
    #: pairs whose short lines are hashed at once
    TOGETHER = 100
    #: minimum hashes beyond those of the bands, of candidates only
    MORE = 192

    def __init__(self, k: int, threshold: float, bands: int, rows: int):
        # further functions tell pairs near the threshold better apart; four and a half standard deviations under it
        self.hashes, self.threshold, self.k = LineHashes(k, bands, rows, self.MORE), threshold, k
        self.stages = [(n, threshold - 4.5 * math.sqrt(threshold * (1 - threshold) / n)) for n in (bands * rows, bands * rows + self.MORE)]
        self.kept = functools.lru_cache(maxsize=4096)(self.shingles)

    def shingles(self, line: str) -> np.ndarray:
        """The distinct shingles, in order of their hashes."""
        return self.sets([line])[0]

    def sets(self, lines: list[str]) -> list[np.ndarray]:
        """``shingles`` of each line; lines have k characters or more."""
        chars = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        h = rolling(chars + np.uint64(1), self.k)
        fresh = np.ones(len(h), bool)
        places, at = [], 0
        for line in lines:
            places.append(slice(at, at + len(line) - self.k + 1))
            h[places[-1]].sort()
            at += len(line)
        np.not_equal(h[1:], h[:-1], out=fresh[1:])
        fresh[[p.start for p in places]] = True
        return [h[p][fresh[p]] for p in places]

    def sketch(self, texts):
        mins = self.hashes.least_of_all(texts)
        return np.ascontiguousarray(self.hashes.keys(mins).T), np.ascontiguousarray((mins.T >> np.uint32(8)).astype(np.uint8))

    def check(self, x, y):
        return self.alike(*(self.kept(t) if len(t) <= self.SHORT else self.shingles(t) for t in (x, y)))

    def check_all(self, pairs):
        for at in range(0, len(pairs), self.TOGETHER):
            part = pairs[at : at + self.TOGETHER]
            lines = list({t for pair in part for t in pair if len(t) <= self.SHORT})
            sets = dict(zip(lines, self.sets(lines))) if lines else {}
            for x, y in part:
                yield self.alike(*(sets[t] if t in sets else self.shingles(t) for t in (x, y)))

    def alike(self, p: np.ndarray, q: np.ndarray) -> bool:
        if min(len(p), len(q)) < self.threshold * max(len(p), len(q)):
            return False
        every = np.concatenate([p, q])
        every.sort()
        both = int(np.count_nonzero(every[1:] == every[:-1]))
        return both >= self.threshold * (len(p) + len(q) - both)


def _rid(id_col: str):
    return F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("rid")


def _lines(text_col: str):
    return F.split(text_or_empty(text_col), "\n")


def hashed_lines(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, rid, th, n_lines, ids), written: a row for each document, with the hashes of its lines and null for blank ones.

    rid is the id (or a large stand-in for null) and th the hash of the text.
    """
    ids = F.transform(_lines(text_col), lambda line: F.when(F.trim(line) != "", F.xxhash64(line)))
    rows = documents.select(
        F.col(id_col).alias("doc_id"),
        _rid(id_col),
        F.xxhash64(text_or_empty(text_col)).alias("th"),
        F.when(F.col(text_col).isNotNull(), ids).alias("ids"),
    )
    return materialize(rows.withColumn("n_lines", F.when(F.col("ids").isNull(), 0).otherwise(F.size("ids")).cast("long")), "line-hashes")


def removed_lines(
    documents: DataFrame,
    hashed: DataFrame,
    k: int = 8,
    threshold: float = 0.8,
    bands: int = 16,
    rows: int = 4,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(rid, th, removed, n_exact, n_fuzzy): line numbers to remove of each document that has any.

    ``hashed`` is made of the documents by ``hashed_lines``.
    """
    fuzzy = documents.select(F.explode(_lines(text_col)).alias("text"))
    fuzzy = fuzzy.where((F.trim("text") != "") & (F.length("text") >= k)).select(F.xxhash64("text").alias("id"), "text")
    runs = materialize(candidate_runs(fuzzy, minhash_signer(k, bands, rows)), "line-runs")
    places = hashed.select("rid", "th", F.posexplode("ids").alias("line_no", "id")).where("id is not null")
    # the firsts are of one row; they lead to a copy of the line's text, and numbers are aggregated by hash where a struct would be sorted
    found = places.groupBy("id").agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("rid", "th", "line_no")])
    in_runs = runs.select("id").distinct().withColumn("in_run", F.lit(True))
    found = found.join(in_runs, "id", "left").where((F.col("n") > 1) | F.col("in_run")).drop("n")
    found = materialize(found, "line-found", files=files_for(runs, NUMBER_ROWS))  # lines that stand in one place and are in no run stay
    wanted = found.where("in_run").groupBy("rid", "th").agg(F.collect_list(F.struct("id", "line_no")).alias("wanted"))
    texts = documents.select(_rid(id_col), F.xxhash64(text_or_empty(text_col)).alias("th"), text_or_empty(text_col).alias("text"))
    # split before the explode, so once a document
    split = texts.join(wanted, ["rid", "th"]).select(_lines("text").alias("lines"), "wanted")
    payload = materialize(
        split.select("lines", F.explode("wanted").alias("w")).select("w.id", F.get("lines", "w.line_no").alias("text")).dropDuplicates(["id"]),
        "line-texts",
        files=files_for(runs, TEXT_ROWS),
    )
    classes = linked_classes(runs, payload, lambda: JaccardMatcher(k, threshold, bands, rows))
    named = found.select("id").join(classes, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
    at = F.struct("rid", "th", "line_no").alias("at")
    shared = materialize(places.join(named, "id").select("id", "component", at), "line-places", files=files_for(found, NUMBER_ROWS))
    own = shared.groupBy("component", "id").agg(F.min("at").alias("own"))
    best = own.groupBy("component").agg(F.min("own").alias("best"))
    gone = shared.join(own.join(best, "component").select("id", "own", "best"), "id").where("at <> best")
    # a line's number, and in the lowest bit whether this is its text's first place
    marks = F.collect_set(F.col("at.line_no").cast("long") * 2 + (F.col("at") == F.col("own")).cast("long"))
    fuzzy_marks = F.size(F.filter("marks", lambda m: m % 2 == 1))
    return gone.groupBy("at.rid", "at.th").agg(marks.alias("marks")).select(
        "rid",
        "th",
        F.array_sort(F.transform("marks", lambda m: F.shiftright(m, 1).cast("int"))).alias("removed"),
        (F.size("marks") - fuzzy_marks).alias("n_exact"),
        fuzzy_marks.alias("n_fuzzy"),
    )


def dedup_lines(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents with later lines of every component taken out of their text; null texts stay null."""
    gone = removed_lines(documents, hashed_lines(documents, id_col, text_col), id_col=id_col, text_col=text_col, **options)
    rid, th, out = F.coalesce(F.col(f"d.{id_col}").cast("long"), F.lit(_NO_ID)), F.xxhash64(text_or_empty(f"d.{text_col}")), F.col(f"d.{text_col}")
    gone = gone.select("rid", "th", "removed").alias("g")
    joined = documents.alias("d").join(gone, (rid == F.col("g.rid")) & (th == F.col("g.th")), "left")
    kept = F.filter(F.split(out, "\n"), lambda _, i: ~F.array_contains(F.col("g.removed"), i))
    text = F.when(F.col("g.removed").isNull(), out).otherwise(F.array_join(kept, "\n"))
    return joined.select(*[text.alias(c) if c == text_col else F.col(f"d.`{c}`") for c in documents.columns])


def line_report(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per document: doc_id, n_lines, n_exact, n_fuzzy, removed (line numbers, comma-joined)."""
    docs = hashed_lines(documents, id_col, text_col)
    gone = removed_lines(documents, docs, id_col=id_col, text_col=text_col, **options)
    return docs.join(gone, ["rid", "th"], "left").select(
        "doc_id",
        "n_lines",
        F.coalesce("n_exact", F.lit(0)).cast("long").alias("n_exact"),
        F.coalesce("n_fuzzy", F.lit(0)).cast("long").alias("n_fuzzy"),
        F.coalesce(F.array_join("removed", ","), F.lit("")).alias("removed"),
    )
