"""Periodic runs of words: Lyndon arrays by suffix grouping, roots extended into maximal repetitions.

A run is a stretch of words with smallest period q and at least two periods long that no
neighbouring word extends.  Each run holds a root that is the longest Lyndon word at its
place under the order of the words or under the reverse order.  Phase one of the grouping
suffix sorter ends with the suffixes grouped by their longest Lyndon prefix, so one pass
for each order gives these roots without finishing the suffix array.  A root is extended
by longest common extensions to both sides; where two periods and ``min_length`` words
are reached, it is a run.

Before that, words that no run can hold are set aside: at least half of ``min_length``
words of a run lie one period apart from equal ones, so every word of a run is covered
by a window of that many words that occurs twice in its text.  What is covered falls
into stretches, and the test is repeated within each.  Windows are compared by hash here; a
clash keeps words that could have been set aside and changes no result.

Texts are handled where they lie: nothing is shuffled, and a lost task is repeated from
its input with the same result.  A task holds a few hundred thousand words or one text.

Cases: a null or blank text has no words and no runs; repeated rows and null ids are
handled row by row; very long texts are one row's work of n log n; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: words of the texts that are searched together in a task
BATCH_WORDS = 300_000


def split_words(doc_id: int | None, text: bytes) -> list[bytes]:
    """Words between ASCII white space."""
    return text.split()


def planted_words(doc_id: int | None, text: bytes) -> list[bytes]:
    """Words, with a repetition planted in the texts whose id has a CRC-32 divisible by ten (null ids: none)."""
    words = text.split()
    if doc_id is None or not words:
        return words
    n, (g, pick) = len(words), divmod(zlib.crc32(str(doc_id).encode()), 10)
    if pick:
        return words
    a = g % n
    period = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + period] * (-(-(n - a) // period)))[: n - a]


def lyndon_array(symbols: list[int]) -> list[int]:
    """Length of the longest Lyndon word that starts at each place.

    Groups of suffixes stand in a list by order, the highest first to be settled.  Each
    member of a settled group points to the nearest place before it that is not settled;
    the places that c members point to have their Lyndon prefix followed by c copies of
    the group's, and move into a new group just above their own.
    """
    members: list[list[int]] = []
    length: list[int] = []
    below: list[int] = []
    above: list[int] = []
    group = [0] * len(symbols)
    places: dict[int, list[int]] = {}
    for i, s in enumerate(symbols):
        places.setdefault(s, []).append(i)
    for number, s in enumerate(sorted(places)):
        members.append(places[s])
        length.append(1)
        below.append(number - 1)
        above.append(number + 1)
        for i in places[s]:
            group[i] = number
    at = len(members) - 1
    if at >= 0:
        above[at] = -1
    settled = bytearray(len(symbols))
    before = [-1] * len(symbols)
    while at >= 0:
        size = length[at]
        targets: list[int] = []
        counts: list[int] = []
        last = -1
        for i in members[at]:
            if group[i] != at:
                continue
            j = i - 1
            while j >= 0 and settled[j]:
                j = before[j]
            before[i] = j
            settled[i] = 1
            if j >= 0:
                if j == last:
                    counts[-1] += 1
                else:
                    targets.append(j)
                    counts.append(1)
                    last = j
        levels = set(counts)
        for level in sorted(levels, reverse=True):
            moved: dict[int, int] = {}
            for j, c in zip(targets, counts):
                if c != level:
                    continue
                own = group[j]
                new = moved.get(own)
                if new is None:
                    new = moved[own] = len(members)
                    members.append([])
                    length.append(length[own] + level * size)
                    up = above[own]
                    below.append(own)
                    above.append(up)
                    above[own] = new
                    if up >= 0:
                        below[up] = new
                members[new].append(j)
                group[j] = new
        at = below[at]
    return [length[g] for g in group]


class Extensions:
    """Longest common extensions by names of all stretches whose length is a power of two."""

    def __init__(self, symbols: np.ndarray, longest: int):
        self.n = len(symbols)
        self.names = [np.unique(symbols, return_inverse=True)[1].astype(np.int64)]
        step = 1
        while step * 2 <= longest:
            last = self.names[-1]
            pairs = last[:-step] * (int(last.max()) + 1) + last[step:]
            self.names.append(np.unique(pairs, return_inverse=True)[1].astype(np.int64))
            step *= 2

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Number of equal symbols from i and from j on (i < j)."""
        got = np.zeros(len(i), np.int64)
        for names, step in zip(reversed(self.names), reversed([1 << k for k in range(len(self.names))])):
            inside = np.flatnonzero(j + got + step <= self.n)
            a, b = i[inside] + got[inside], j[inside] + got[inside]
            got[inside[names[a] == names[b]]] += step
        return got

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Number of equal symbols that end at i and at j (i < j)."""
        got = np.zeros(len(i), np.int64)
        for names, step in zip(reversed(self.names), reversed([1 << k for k in range(len(self.names))])):
            inside = np.flatnonzero(i - got - step + 1 >= 0)
            a, b = i[inside] - got[inside] - step + 1, j[inside] - got[inside] - step + 1
            got[inside[names[a] == names[b]]] += step
        return got


def covered(words: np.ndarray, part: np.ndarray, width: int) -> np.ndarray:
    """Which words lie in a window of ``width`` words that occurs twice or more in their part."""
    m = len(words) - width + 1
    if m <= 0:
        return np.zeros(len(words), bool)
    key = part[:m].astype(np.uint64)
    for k in range(width):
        key = key * np.uint64(0x9E3779B97F4A7C15) + words[k : m + k].astype(np.uint64)
        key ^= key >> np.uint64(29)
    inside = np.flatnonzero(part[:m] == part[width - 1 :])
    order = np.argsort(key[inside])
    ordered = key[inside][order]
    twin = ordered[1:] == ordered[:-1]
    twice = np.zeros(len(inside), bool)
    twice[order[1:]] |= twin
    twice[order[:-1]] |= twin
    change = np.zeros(len(words) + 1, np.int32)
    starts = inside[twice]
    change[starts] += 1
    change[starts + width] -= 1
    return np.cumsum(change[:-1]) > 0


def stretches(words: np.ndarray, part: np.ndarray, min_length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places that may lie in runs, ascending, and the number of the stretch of each."""
    place = np.arange(len(words))
    while len(place):
        held = np.flatnonzero(covered(words[place], part, (min_length + 1) // 2))
        kept, part = place[held], part[held]
        new = np.ones(len(kept), bool)
        new[1:] = (np.diff(kept) > 1) | (np.diff(part) != 0)
        part = np.cumsum(new) - 1
        long = np.bincount(part)[part] >= min_length if len(part) else new
        done = int(long.sum()) >= 0.9 * len(place)  # what is left costs less than another pass
        place, part = kept[long], part[long]
        if done:
            break
    return place, part


def find_runs(words: np.ndarray, part: np.ndarray, min_length: int = 12) -> np.ndarray:
    """Rows (start, length, period), ordered so: all runs of at least ``min_length`` within the parts.

    ``words`` are word numbers, ``part`` ascending numbers of the texts that they come from.
    """
    place, stretch = stretches(words, part, min_length)
    if not len(place):
        return np.zeros((0, 3), np.int64)
    numbers = np.unique(words[place], return_inverse=True)[1].astype(np.int64) + 1
    high = int(numbers.max()) + 1
    # a separator before each stretch: below all words in both orders, and equal to nothing
    opens = np.diff(stretch, prepend=stretch[0] - 1) > 0
    ranks = np.cumsum(opens)
    cell = np.arange(len(place)) + ranks
    n = len(place) + int(ranks[-1])
    text = np.zeros(n, np.int64)
    text[cell] = numbers
    turned = np.zeros(n, np.int64)
    turned[cell] = high - numbers
    apart = text.copy()
    gaps = np.flatnonzero(text == 0)
    apart[gaps] = high + np.arange(len(gaps))
    roots = [np.array(lyndon_array(t.tolist()), np.int64) for t in (text, turned)]
    start = np.concatenate([cell, cell])
    period = np.concatenate([r[cell] for r in roots])
    pair = np.unique(start * (n + 1) + period)
    start, period = pair // (n + 1), pair % (n + 1)
    fits = start + period < n
    start, period = start[fits], period[fits]
    reach = Extensions(apart, int(np.bincount(ranks).max()))
    right = reach.forward(start, start + period)
    left = reach.backward(start - 1, start + period - 1)
    length = left + period + right
    good = (length >= 2 * period) & (length >= min_length)
    back = np.zeros(n, np.int64)
    back[cell] = place
    found = np.stack([back[(start - left)[good]], length[good], period[good]], axis=1)
    return np.unique(found, axis=0)


def run_batch(rows: list[tuple[int | None, list[bytes]]], min_length: int) -> Iterator[tuple]:
    """(id, number of words, runs, kept words) for each row of (id, words)."""
    sizes = [len(words) for _, words in rows]
    numbers: dict[bytes, int] = {}
    for _, words in rows:
        for w in dict.fromkeys(words):
            numbers.setdefault(w, len(numbers))
    ids = np.fromiter((numbers[w] for _, words in rows for w in words), np.int64, sum(sizes))
    runs = find_runs(ids, np.repeat(np.arange(len(rows)), sizes), min_length)
    ends = np.cumsum(sizes)
    cut = np.searchsorted(runs[:, 0], np.concatenate([[0], ends]))
    for k, (doc, words) in enumerate(rows):
        own = runs[cut[k] : cut[k + 1]].copy()
        if len(own):
            own[:, 0] -= ends[k] - sizes[k]
            change = np.zeros(len(words) + 1, np.int64)
            np.add.at(change, own[:, 0] + own[:, 2], 1)
            np.add.at(change, own[:, 0] + own[:, 1], -1)
            words = compress(words, (np.cumsum(change[:-1]) == 0).tolist())
        yield doc, sizes[k], own, b" ".join(words)


def collapse_runs(
    documents: DataFrame,
    min_length: int = 12,
    words: Callable[[int | None, bytes], list[bytes]] = split_words,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per text: doc_id, n_words, runs (start, length, period; by start, then period), collapsed.

    ``collapsed`` is the text with every run cut to its first period, words joined by one
    blank.  ``words`` makes the words of a text from its id and its UTF-8 bytes.
    """
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(run)), ("collapsed", pa.binary())])

    def batch(rows: list) -> pa.RecordBatch:
        found = [r[2] for r in rows]
        flat = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
        offsets = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
        parts = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, c])) for c in range(3)], fields=list(run))
        columns = [
            pa.array([r[0] for r in rows], pa.int64()),
            pa.array([r[1] for r in rows], pa.int64()),
            pa.ListArray.from_arrays(pa.array(offsets), parts),
            pa.array([r[3] for r in rows], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                waiting.append((doc, words(doc, text.as_py())))
                size += len(waiting[-1][1])
                if size > BATCH_WORDS or len(waiting) >= 10_000:
                    yield batch(list(run_batch(waiting, min_length)))
                    waiting, size = [], 0
        yield batch(list(run_batch(waiting, min_length)))

    texts = documents.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text")
    )
    out = texts.mapInArrow(search, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed binary")
    return out.withColumn("collapsed", F.col("collapsed").cast("string"))


def digest(found: DataFrame) -> DataFrame:
    """The longest run of each text and hashes of its runs and of what is kept."""
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("l"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return found.select("doc_id", "runs", "collapsed", longest.alias("top")).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("top.s")).alias("start"),
        F.col("top.l").alias("length"),
        (-F.col("top.p")).alias("period"),
        F.expr("1000 * top.l div -top.p").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
