"""Packing token ids into fixed sequences by minimum bin slack.

Each document becomes its token ids and an end id.  Full windows of ``capacity`` ids are
sequences of their own; what is left of a document (shorter than a window) waits in a
pool.  For each sequence the longest waiting piece is taken, and a subset-sum dynamic
program over the multiset of waiting lengths (one bit for each reachable total) finds
the pieces that come closest to the rest of the window; the counts are found by going
back through the recorded bitsets.  Where the closest total leaves slack, one waiting piece
is cut to close the window and its rest waits on.  What is left at the end of a partition
is less than a window; it is cut into powers of two, which need no padding.

Each task packs its own partition, so nothing is shuffled, and a lost task is repeated
from its input with the same result.

Cases: a null text counts as empty and is the end id alone; a null id is kept; repeated
rows are packed one by one; very long texts are cut into full windows; an empty table
gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import functools
import json
import zlib
from collections import Counter, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIELDS = [
    ("doc_id", pa.int64()),
    ("start", pa.int64()),
    ("length", pa.int64()),
    ("ids_crc32", pa.int64()),
    ("doc_tokens", pa.int64()),
    ("sequence_id", pa.int64()),
    ("offset", pa.int64()),
]


def byte_alphabet() -> dict[str, int]:
    """The printable characters that stand for bytes in byte-level vocabularies."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.lru_cache(maxsize=2)
def encoder(tokenizer_path: str, pattern: str, added_tokens: bool = False):
    """text -> ids, from a byte-level BPE vocabulary file of the ``tokenizers`` library.

    The vocabulary's ids are in the order of its merges, so they serve as merge ranks for a
    faster encoder of the same ids; texts that it refuses go through the library itself.
    With ``added_tokens``, a text that contains an added token goes through the library with
    its default settings, where the token is one id; without, it is ordinary text.
    """
    import tiktoken
    from tokenizers import Tokenizer

    with open(tokenizer_path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"] for t in spec["added_tokens"]}
    alphabet = byte_alphabet()
    ranks = {bytes(alphabet[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
    fast = tiktoken.Encoding("byte-level", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    slow = Tokenizer.from_file(tokenizer_path)
    slow.encode_special_tokens = True
    default = Tokenizer.from_file(tokenizer_path)

    def encode(text: str) -> list[int]:
        if added_tokens and any(t in text for t in special):
            return default.encode(text, add_special_tokens=False).ids
        try:
            return fast.encode_ordinary(text)
        except BaseException as error:  # the regex engine panics on some very long runs
            if isinstance(error, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
            return slow.encode(text, add_special_tokens=False).ids

    return encode


def best_subset(lengths: Counter, room: int) -> list[int]:
    """Lengths from the multiset with the largest sum of at most ``room``.

    Bit s of a bitset says that the sum s can be reached.  A length with count c enters as
    blocks of 1, 2, 4, ... copies; going back through the bitsets gives the counts.
    """
    full = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in sorted((x for x in lengths if 0 < x <= room), reverse=True):
        left, block = min(lengths[length], room // length), 1
        while left > 0 and not reach >> room & 1:
            take = min(block, left)
            steps.append((reach, length, take))
            reach |= reach << length * take & full
            left -= take
            block *= 2
        if reach >> room & 1:
            break
    at, chosen = reach.bit_length() - 1, []
    for before, length, take in reversed(steps):
        if not before >> at & 1:
            chosen += [length] * take
            at -= length * take
    return chosen


class Pool:
    """Waiting pieces of one task by length."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.by_length: dict[int, deque] = {}
        self.counts: Counter = Counter()
        self.size = self.total = 0

    def add(self, piece, length: int) -> None:
        self.by_length.setdefault(length, deque()).append(piece)
        self.counts[length] += 1
        self.size += 1
        self.total += length

    def take(self, length: int):
        self.size -= 1
        self.total -= length
        self.counts[length] -= 1
        if not self.counts[length]:
            del self.counts[length]
        return self.by_length[length].popleft()

    def fill(self) -> tuple[list, int]:
        """Pieces of the next sequence and its slack."""
        longest = max(self.counts)
        pieces = [self.take(longest)]
        rest = best_subset(self.counts, self.capacity - longest)
        pieces += [self.take(x) for x in rest]
        return pieces, self.capacity - longest - sum(rest)


def pack_partition(documents, encode, end_id: int, capacity: int, window: int, first_sequence: int) -> Iterator[tuple]:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids) of one partition."""
    sequence = first_sequence
    pool = Pool(capacity)

    def piece(doc, start, ids, total, offset):
        raw = ids.tobytes()
        return (doc, start, len(ids), zlib.crc32(raw), total, sequence, offset, raw)

    def lay(pieces):
        offset = 0
        for doc, start, ids, total in pieces:
            yield piece(doc, start, ids, total, offset)
            offset += len(ids)

    def closed():
        """Pieces of the next sequence; slack only if nothing waits that could close it."""
        pieces, left = pool.fill()
        if left and pool.size:
            longest = max(pool.counts)  # longer than the slack, or it would have been chosen
            doc, start, ids, total = pool.take(longest)
            pieces.append((doc, start, ids[:left], total))
            pool.add((doc, start + left, ids[left:], total), longest - left)
            left = 0
        return pieces, left

    for doc, text in documents:
        ids = np.array([*encode(text), end_id], dtype="<u4")
        total = len(ids)
        for start in range(0, total - capacity + 1, capacity):
            yield piece(doc, start, ids[start : start + capacity], total, 0)
            sequence += 1
        start = total - total % capacity
        if start < total:
            pool.add((doc, start, ids[start:], total), total - start)
        while pool.size >= window and pool.total >= 2 * capacity:  # so much that the next sequence can be closed
            yield from lay(closed()[0])
            sequence += 1
    while pool.size:
        pieces, left = closed()
        if left:
            break
        yield from lay(pieces)
        sequence += 1
    else:
        return
    remaining = capacity - left
    target = offset = 0
    for doc, start, ids, total in pieces:
        at = 0
        while at < len(ids):
            if offset == target:
                sequence += bool(target)
                target = 1 << (remaining.bit_length() - 1)
                remaining -= target
                offset = 0
            n = min(target - offset, len(ids) - at)
            yield piece(doc, start + at, ids[at : at + n], total, offset)
            at += n
            offset += n


def pack_documents(
    documents: DataFrame,
    tokenizer_path: str,
    pattern: str,
    capacity: int = 1024,
    end_id: int = 0,
    window: int = 256,
    with_ids: bool = False,
    added_tokens: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (, ids).

    ``window`` pieces wait in a task before the next sequence is filled.  ``ids`` are the
    piece's ids as little-endian unsigned 32-bit numbers.  ``added_tokens`` reads added tokens
    in a text as the library does by default.  The vocabulary file has to be
    at ``tokenizer_path`` on every executor.
    """
    fields = FIELDS + ([("ids", pa.binary())] if with_ids else [])
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path, pattern, added_tokens)

        def rows():
            for b in batches:
                yield from zip(b.column(0).to_pylist(), b.column(1).to_pylist())

        first = TaskContext.get().partitionId() << 40
        out: list[tuple] = []
        size = 0
        for row in pack_partition(rows(), encode, end_id, capacity, window, first):
            out.append(row)
            size += len(row[-1])
            if len(out) >= 20_000 or size > 1 << 25:
                yield _batch(out, schema)
                out, size = [], 0
        yield _batch(out, schema)

    texts = documents.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    ddl = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return texts.mapInArrow(run, ddl + (", ids binary" if with_ids else ""))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[]] * 8
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)


def sequences(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """(sequence_id, length, padding, ids): the packed sequences, of pieces with ids."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda p: p["ids"])
    length = F.sum("length")
    power = F.bit_count(length) == 1
    return pieces.groupBy("sequence_id").agg(
        length.alias("length"),
        F.when(power, F.lit(0)).otherwise(capacity - length).cast("long").alias("padding"),
        F.aggregate(parts, F.lit(b""), lambda a, b: F.concat(a, b)).alias("ids"),
    )
