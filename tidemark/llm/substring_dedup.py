"""Removing repeated substrings with suffix order and longest-previous-factor arrays.

A byte is removed if a string of ``length`` bytes that covers it also starts in a document
with a smaller id.  Documents are compared as UTF-8 bytes, and matches stay inside documents.

1. Anchors.  Each window of ``length`` bytes is keyed by the smallest hash of its
   ``anchor``-byte strings (its minimizer), so equal windows have equal keys; windows in
   a row with one key form a segment.  Tasks pack (key, document) entries by bucket, and
   the bucket's owner says which keys two documents share, in a packed row for each group
   of documents; a group's owner puts the shared keys of each document together.
2. Segments.  Only segments with a shared key are sent on, by key.  Equal segments are
   settled in the sending task, all but the first document's being repeats.  The windows
   of a key with more than ``hot`` documents are sent one by one under hashes of their
   own, so that a passage in a third of all documents is spread over the cluster.
3. Suffix order.  The owner of a key sorts the windows of its distinct segments, takes
   the common prefixes of neighbours, and finds for each the previous and the next one
   in suffix order that belongs to a smaller document.  The longer of the two matches is
   the longest previous factor; windows where it reaches ``length`` are removed.

Copies of a whole text are settled beforehand by SHA-256 and length, and need no segments.

Cases: a null text counts as empty; any 64-bit id is an id, and a null one counts as the
largest of them; rows with the same id are not earlier than each other, and each is judged
by itself (they are told apart by a 64-bit hash of the text); texts under ``length`` bytes
are left alone; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialize, partitions_for, text_or_empty
from tidemark.llm.near_dedup import mixed, rolling

_NO_ID = 2**63 - 1
_KEY_BITS = np.uint64(40)
_KEY_MASK = np.uint64(2**40 - 1)
_KEY_ODD = np.uint64(0x9E3779B97F4A7C15)
_CHUNK = 60_000
#: a key is hot only from one part in so many of all entries on, so there are fewer hot keys than this
HOT_PARTS = 1_000_000
#: bytes of text for each bucket; a task holds what is shared of about one bucket
BUCKET_BYTES = 128 << 20


def window_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w values in a row."""
    span = 1
    m = x
    while span * 2 <= w:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    return np.minimum(m[: len(x) - w + 1], m[w - span :]) if w > span else m


def segments(texts: list[bytes], length: int, anchor: int):
    """(text index, first window, number of windows, key) arrays over all texts, and the window hash array."""
    index = [i for i, t in enumerate(texts) if len(t) >= length]
    at = 0
    while at < len(index):
        stop, total = at, 0
        while stop < len(index) and (total < _CHUNK or stop == at):
            total += len(texts[index[stop]])
            stop += 1
        block = index[at:stop]
        at = stop
        raw = np.frombuffer(b"".join([texts[i] for i in block]), np.uint8)
        chars = raw.astype(np.uint64) + np.uint64(1)
        sizes = np.array([len(texts[i]) for i in block])
        first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        low = window_min(mixed(rolling(chars, anchor)), length - anchor + 1)
        counts = sizes - length + 1
        owner = np.repeat(np.arange(len(block)), counts)
        begin = np.concatenate([[0], np.cumsum(counts)[:-1]])
        offset = np.arange(len(owner)) - begin[owner]
        where = offset + first[owner]
        keys = low[where]
        fresh = np.ones(len(keys), bool)
        fresh[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
        heads = np.flatnonzero(fresh)
        n = np.diff(np.append(heads, len(keys)))
        yield np.array(block)[owner[heads]], offset[heads], n, keys[heads]


def planes(a: np.ndarray, n: int) -> bytes:
    """The n low bytes of each value, one byte position after the other (compresses well)."""
    return a.view(np.uint8).reshape(-1, 8).T[:n].tobytes()


def unplanes(raw: bytes, n: int, dtype=np.int64) -> np.ndarray:
    count = len(raw) // n
    out = np.zeros((count, 8), np.uint8)
    out[:, :n] = np.frombuffer(raw, np.uint8).reshape(n, count).T
    return out.reshape(-1).view(dtype)


def _among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of ``x`` are in the sorted array ``known``."""
    if not len(known):
        return np.zeros(len(x), bool)
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x


def _bucket(keys: np.ndarray, n: int) -> np.ndarray:
    return ((keys >> _KEY_BITS) % np.uint64(n)).astype(np.int64)


def _grouped(buckets: np.ndarray):
    """Order by bucket, and (bucket, from, to) of each."""
    order = np.argsort(buckets, kind="stable")
    b = buckets[order]
    at = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]])) if len(b) else np.zeros(0, int)
    return order, [(int(b[i]), i, j) for i, j in zip(at, [*at[1:], len(b)])]


def _to_bytes(col) -> list[bytes]:
    return [t.encode() for t in col.to_pylist()]


def _anchor_rows(keys, rids, n_buckets):
    """Rows (bucket, keys, members, rids, kinds) of one task.

    Kind 2 is a document whose key a smaller one of the task has too, 0 the only document with
    its key, and 3 + b the smallest of about 2 ** b documents with its key.
    """
    order = np.lexsort((rids, keys))
    keys, rids = keys[order], rids[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (rids[1:] != rids[:-1])
    keys, rids = keys[fresh], rids[fresh]
    head = np.ones(len(keys), bool)
    head[1:] = keys[1:] != keys[:-1]
    starts = np.flatnonzero(head)
    sizes = np.diff(np.append(starts, len(keys)))
    kinds = np.full(len(keys), 2, np.uint8)
    kinds[starts] = np.where(sizes > 1, 3 + np.log2(sizes).astype(np.int64), 0)
    order = np.argsort(rids, kind="stable")
    keys, rids, kinds = keys[order], rids[order], kinds[order]
    spread = np.where(kinds == 2, mixed(rids.view(np.uint64)), keys)
    order, parts = _grouped(_bucket(spread, n_buckets))
    keys, rids, kinds = keys[order], rids[order], kinds[order]
    for b, i, j in parts:
        # members travel with their whole key, in another bucket than their key's
        yield b, planes(keys[i:j][kinds[i:j] != 2], 5), planes(keys[i:j][kinds[i:j] == 2], 8), planes(rids[i:j], 8), kinds[i:j].tobytes()


def shared_anchors(docs: DataFrame, length: int, anchor: int, hot: int, n_buckets: int) -> DataFrame:
    """docs (u, text) to (g, packed): the shared keys of each document u, packed by document group.

    Group -1 holds the hot keys: those of more than about ``hot`` documents and more than one part in
    ``HOT_PARTS`` of all entries, so that they are fewer than ``HOT_PARTS`` whatever the input.
    """

    def emit(keys, rids):
        rows = list(_anchor_rows(np.concatenate(keys), np.concatenate(rids), n_buckets))
        cols = list(zip(*rows)) if rows else [[]] * 5
        kinds = [pa.int32(), *[pa.binary()] * 4]
        names = ["bucket", "keys", "members", "rids", "kinds"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=names)

    def scan(batches):
        keys, rids, n = [], [], 0
        for b in batches:
            ids = b.column(0).to_numpy()
            for at in range(0, len(ids), 1000):
                texts = _to_bytes(b.column(1).slice(at, 1000))
                for owner, _, _, key in segments(texts, length, anchor):
                    keys.append(key)
                    rids.append(ids[at + owner])
                    n += len(key)
                if n >= 1_500_000:
                    yield emit(keys, rids)
                    keys, rids, n = [], [], 0
        if n:
            yield emit(keys, rids)

    def judge(t: pa.Table) -> pa.Table:
        out_keys, out_rids = [], []
        keys, rids, known = [], [], []
        hottest = np.zeros(0, np.uint64)
        for k, m, r, kind in zip(*(t.column(c).to_pylist() for c in ("keys", "members", "rids", "kinds"))):
            kind = np.frombuffer(kind, np.uint8)
            r = unplanes(r, 8)
            out_keys.append(unplanes(m, 8, np.uint64) & _KEY_MASK)
            out_rids.append(r[kind == 2])
            keys.append(unplanes(k, 5, np.uint64))
            rids.append(r[kind != 2])
            known.append(kind[kind != 2])
        keys, rids, known = np.concatenate(keys), np.concatenate(rids), np.concatenate(known)
        order = np.argsort(keys, kind="stable")
        keys, rids, known = keys[order], rids[order], known[order]
        if len(keys):
            starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            sizes = np.diff(np.append(starts, len(keys)))
            several = np.minimum.reduceat(rids, starts) != np.maximum.reduceat(rids, starts)
            keep = np.repeat(several | (np.maximum.reduceat(known, starts) > 0), sizes)
            out_keys.append(keys[keep])
            out_rids.append(rids[keep])
            n_docs = np.add.reduceat(np.exp2(np.maximum(known, 3).astype(float) - 3), starts)
            part = n_docs.sum() * n_buckets / HOT_PARTS
            hottest = keys[starts[n_docs > max(hot, part)]]
        rows = [*_key_rows(np.concatenate(out_keys), np.concatenate(out_rids), n_buckets), (-1, planes(hottest, 5))]
        return pa.table({"g": pa.array([g for g, _ in rows], pa.int32()), "packed": pa.array([p for _, p in rows], pa.binary())})

    packed = docs.mapInArrow(scan, "bucket int, keys binary, members binary, rids binary, kinds binary")
    return packed.groupBy("bucket").applyInArrow(judge, "g int, packed binary")


def _key_rows(keys: np.ndarray, rids: np.ndarray, n_groups: int) -> Iterator[tuple[int, bytes]]:
    """(group, packed) rows of (key, document) entries: number of documents, documents, keys of each, keys."""
    group = (mixed(rids.view(np.uint64)) % np.uint64(n_groups)).astype(np.int64)
    order = np.lexsort((rids, group))
    keys, rids, group = keys[order], rids[order], group[order]
    cut = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, int)
    for i, j in zip(cut.tolist(), [*cut[1:].tolist(), len(group)]):
        own = rids[i:j]
        head = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        n = np.diff(np.append(head, len(own)))
        yield int(group[i]), len(head).to_bytes(8, "little") + planes(own[head], 8) + planes(n, 4) + planes(keys[i:j], 5)


def keys_by_document(anchors: DataFrame) -> DataFrame:
    """Packed rows of ``shared_anchors`` to (u, keys): the shared keys of each document, in order."""

    def merge(t: pa.Table) -> pa.Table:
        keys, rids = [], []
        for raw in t.column("packed").to_pylist():
            n = int.from_bytes(raw[:8], "little")
            own, counts = unplanes(raw[8 : 8 + 8 * n], 8), unplanes(raw[8 + 8 * n : 8 + 12 * n], 4)
            rids.append(np.repeat(own, counts))
            keys.append(unplanes(raw[8 + 12 * n :], 5, np.uint64))
        keys, rids = np.concatenate(keys), np.concatenate(rids)
        order = np.lexsort((keys, rids))
        keys, rids = keys[order], rids[order]
        fresh = np.ones(len(keys), bool)
        fresh[1:] = (keys[1:] != keys[:-1]) | (rids[1:] != rids[:-1])
        keys, rids = keys[fresh], rids[fresh]
        at = np.flatnonzero(np.concatenate([[True], rids[1:] != rids[:-1]]))
        packs = [planes(keys[i:j], 5) for i, j in zip(at.tolist(), [*at[1:].tolist(), len(rids)])]
        return pa.table({"u": pa.array(rids[at], pa.int64()), "keys": pa.array(packs, pa.binary())})

    return anchors.where("g >= 0").groupBy("g").applyInArrow(merge, "u long, keys binary")


def longest_previous_factor(windows: np.ndarray, owners: np.ndarray) -> np.ndarray:
    """For each row of ``windows`` (n x length bytes): the longest prefix it shares with a row of a smaller owner.

    Rows are put in suffix order; the common prefix with any row before or after is the least of the common
    prefixes in between, so the nearest smaller owner on either side gives the longest match.
    """
    n, length = windows.shape
    order = np.argsort(np.ascontiguousarray(windows).view(f"S{length}").ravel(), kind="stable")
    rows = windows[order]
    differ = rows[1:] != rows[:-1]
    common = np.where(differ.any(1), differ.argmax(1), length).tolist()
    who = owners[order].tolist()
    best = [0] * n
    for ranks in (range(n), range(n - 1, -1, -1)):
        stack: list[tuple[int, int]] = []  # (owner, common prefix with the row below it on the stack)
        last = None
        for r in ranks:
            reach = length if last is None else common[min(r, last)]
            last = r
            while stack and stack[-1][0] >= who[r]:
                reach = min(reach, stack.pop()[1])
            if stack:
                best[r] = max(best[r], reach)
            stack.append((who[r], reach))
    out = np.empty(n, np.int64)
    out[order] = best
    return out


def _mark_runs(first: int, covered: np.ndarray, length: int) -> Iterator[tuple[int, int]]:
    """Byte ranges of the covered windows of a segment."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], covered.view(np.int8), [0]])))
    for i, j in zip(edge[::2].tolist(), edge[1::2].tolist()):
        yield first + i, first + j - 1 + length


def _mark_rows(marks: list[tuple[int, int, int, int]], n_groups: int) -> Iterator[tuple[int, bytes]]:
    """(rid, th, from, to) to one packed row for each group of documents."""
    if marks:
        m = np.array(marks, np.int64)
        m = m[np.lexsort((m[:, 2], m[:, 1], m[:, 0]))]
        place = m[:, 0].view(np.uint64) * _KEY_ODD + m[:, 1].view(np.uint64)
        order, parts = _grouped((mixed(place) % np.uint64(n_groups)).astype(np.int64))
        m = m[order]
        for g, i, j in parts:
            yield g, b"".join(planes(np.ascontiguousarray(m[i:j, c]), 8) for c in range(4))


def merge_marks(sent: DataFrame) -> DataFrame:
    """Packed marks (g, packed) to (rid, th, ranges): the merged byte ranges of each document."""

    def merge(t: pa.Table) -> pa.Table:
        cols = []
        for raw in t.column("packed").to_pylist():
            n = len(raw) // 4
            cols.append([unplanes(raw[c * n : (c + 1) * n], 8) for c in range(4)])
        rid, th, start, end = (np.concatenate(x) for x in zip(*cols))
        order = np.lexsort((end, start, th, rid))
        rid, th, start, end = (x[order] for x in (rid, th, start, end))
        head = np.ones(len(rid), bool)
        head[1:] = (rid[1:] != rid[:-1]) | (th[1:] != th[:-1])
        # one line of numbers for all documents, so that a running maximum stays in its document
        base = np.cumsum(head) << 33
        reach = np.maximum.accumulate(base + end)
        fresh = np.ones(len(rid), bool)
        fresh[1:] = base[1:] + start[1:] > reach[:-1]
        at = np.flatnonzero(fresh)
        till = np.append(reach[at[1:] - 1], reach[-1:]) - base[at]
        ranges = np.stack([start[at], till], axis=1).astype(np.uint32)
        rid, th, head = rid[at], th[at], np.ones(len(at), bool)
        head[1:] = (rid[1:] != rid[:-1]) | (th[1:] != th[:-1])
        cut = np.flatnonzero(head)
        packs = [ranges[i:j].tobytes() for i, j in zip(cut.tolist(), [*cut[1:].tolist(), len(at)])]
        return pa.table(
            {"rid": pa.array(rid[cut], pa.int64()), "th": pa.array(th[cut], pa.int64()), "ranges": pa.array(packs, pa.binary())}
        )

    return sent.groupBy("g").applyInArrow(merge, "rid long, th long, ranges binary")


_SEGMENT_DDL = "bucket int, n int, packed binary"


def send_segments(docs: DataFrame, length: int, anchor: int, n_buckets: int, hot_keys: bytes) -> DataFrame:
    """docs (rid, th, text, keys) to ``n`` packed segments by bucket.

    Rows with a negative bucket -1 - g hold marks of group g that are settled already.
    """

    def emit(seen: dict, marks: list) -> Iterator[pa.RecordBatch]:
        by: dict[int, list] = {}
        for (key, raw), (rid, places) in seen.items():
            by.setdefault((key >> 40) % n_buckets, []).extend((key, rid, th, start, raw) for th, start in places)
        rows = []
        for b, found in by.items():
            key, rid, th, start, raw = zip(*found)
            parts = [
                planes(np.array(key, np.uint64), 8),
                planes(np.array(rid, np.int64), 8),
                planes(np.array(th, np.int64), 8),
                planes(np.array(start, np.int64), 8),
                planes(np.array([len(x) for x in raw], np.int64), 8),
                b"".join(raw),
            ]
            body = pa.compress(b"".join(parts), codec="zstd", asbytes=True)
            size = sum(map(len, parts))
            rows.append((b, len(raw), size.to_bytes(8, "little") + body))
        rows += [(-1 - g, 0, packed) for g, packed in _mark_rows(marks, n_buckets)]
        cols = list(zip(*rows)) if rows else [[]] * 3
        kinds = [pa.int32(), pa.int32(), pa.binary()]
        names = ["bucket", "n", "packed"]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=names)

    def run(batches):
        seen: dict[tuple[int, bytes], tuple[int, list[tuple[int, int]]]] = {}
        marks: list[tuple[int, int, int, int]] = []
        size = 0

        def put(key, raw, rid, th, start):
            """Keeps the places of the smallest id; places of larger ids are settled."""
            nonlocal size
            old = seen.get((key, raw))
            if old is None:
                seen[key, raw] = (rid, [(th, start)])
                size += len(raw) + 200
            elif old[0] < rid:
                marks.append((rid, th, start, start + len(raw)))
            elif old[0] == rid:
                old[1].append((th, start))
            else:
                seen[key, raw] = (rid, [(th, start)])
                marks.extend((old[0], p, at, at + len(raw)) for p, at in old[1])

        hot = np.sort(unplanes(hot_keys, 5, np.uint64))
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                b = batch.slice(at, 200)
                rids, ths = b.column("rid").to_pylist(), b.column("th").to_pylist()
                texts = _to_bytes(b.column("text"))
                keys = [unplanes(x, 5, np.uint64) for x in b.column("keys").to_pylist()]
                # documents number the high bits, so that one sorted array holds the keys of all of them
                wanted = np.concatenate([k | np.uint64(i << 40) for i, k in enumerate(keys)])
                for owner, first, n, key in segments(texts, length, anchor):
                    low = key & _KEY_MASK
                    asked = _among(owner.astype(np.uint64) << _KEY_BITS | low, wanted)
                    fine = _among(low[asked], hot).tolist()
                    for i, a, c, k, split in zip(*(x[asked].tolist() for x in (owner, first, n, key)), fine):
                        text = texts[i]
                        if split:
                            for w in range(a, a + c):
                                raw = text[w : w + length]
                                put(int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little"), raw, rids[i], ths[i], w)
                        else:
                            put(k, text[a : a + c + length - 1], rids[i], ths[i], a)
                if size > 48_000_000 or len(marks) > 500_000:
                    yield from emit(seen, marks)
                    seen, size = {}, 0
                    marks.clear()
        yield from emit(seen, marks)

    return docs.mapInArrow(run, _SEGMENT_DDL)


def unpack_segments(packed: bytes, n: int):
    size = int.from_bytes(packed[:8], "little")
    raw = pa.decompress(packed[8:], decompressed_size=size, codec="zstd", asbytes=True)
    cols = [unplanes(raw[8 * n * c : 8 * n * (c + 1)], 8, np.uint64 if c == 0 else np.int64) for c in range(5)]
    return (*cols, raw[40 * n :])


def settle_segments(sent: DataFrame, length: int, n_buckets: int) -> DataFrame:
    """Packed segments to (rid, marks): byte ranges to remove, one row a document that has any."""

    def settle(t: pa.Table) -> pa.Table:
        marks: list[tuple[int, int, int, int]] = []
        packs = [(p, n) for n, p in zip(t.column("n").to_pylist(), t.column("packed").to_pylist())]
        if packs:
            cols = [unpack_segments(p, n) for p, n in packs]
            key, rid, th, start, size = (np.concatenate(x) for x in list(zip(*cols))[:5])
            body = b"".join(c[5] for c in cols)
            del cols
            at = np.concatenate([[0], np.cumsum(size)[:-1]])
            order = np.argsort(key, kind="stable")
            key, rid, th, start, size, at = (x[order] for x in (key, rid, th, start, size, at))
            heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            ends = np.append(heads[1:], len(key))
            many = ends - heads > 1
            rids, ths, starts, sizes, ats = (x.tolist() for x in (rid, th, start, size, at))
            waiting: list[tuple] = []
            windows = 0
            for i, j in zip(heads[many].tolist(), ends[many].tolist()):
                distinct: dict[bytes, int] = {}
                for s in range(i, j):
                    raw = body[ats[s] : ats[s] + sizes[s]]
                    distinct[raw] = min(rids[s], distinct.get(raw, rids[s]))
                for s in range(i, j):
                    raw = body[ats[s] : ats[s] + sizes[s]]
                    if distinct[raw] < rids[s]:
                        marks.append((rids[s], ths[s], starts[s], starts[s] + sizes[s]))
                    elif len(distinct) > 1:
                        waiting.append((rids[s], ths[s], starts[s], raw))
                        windows += sizes[s] - length + 1
                if windows > 60_000:
                    _previous_factors(waiting, length, marks)
                    waiting, windows = [], 0
            _previous_factors(waiting, length, marks)
        rows = list(_mark_rows(marks, n_buckets))
        return pa.table({"g": pa.array([g for g, _ in rows], pa.int32()), "packed": pa.array([p for _, p in rows], pa.binary())})

    settled = sent.where("bucket >= 0").groupBy("bucket").applyInArrow(settle, "g int, packed binary")
    return merge_marks(settled.unionByName(sent.where("bucket < 0").select((-1 - F.col("bucket")).alias("g"), "packed")))


def _previous_factors(waiting: list[tuple], length: int, marks: list) -> None:
    if not waiting:
        return
    sizes = np.array([len(x[3]) for x in waiting])
    counts = sizes - length + 1
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    text = np.frombuffer(b"".join([x[3] for x in waiting]), np.uint8)
    owner = np.repeat(np.arange(len(waiting)), counts)
    head = np.concatenate([[0], np.cumsum(counts)[:-1]])
    where = np.arange(len(owner)) - head[owner] + begin[owner]
    rows = np.lib.stride_tricks.sliding_window_view(text, length)[where]
    rids = np.array([x[0] for x in waiting])
    covered = longest_previous_factor(rows, rids[owner]) >= length
    for s in np.unique(owner[covered]).tolist():
        rid, th, start, _ = waiting[s]
        for a, b in _mark_runs(start, covered[head[s] : head[s] + counts[s]], length):
            marks.append((rid, th, a, b))


def dedup_substrings(
    documents: DataFrame,
    length: int = 50,
    anchor: int = 20,
    hot: int = 5_000,
    n_buckets: int | None = None,
    with_text: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (, kept: the remaining bytes)."""
    rid = F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID))
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), rid.alias("rid"), text_or_empty(text_col).alias("text"))
    docs = docs.withColumn("th", F.xxhash64("text"))
    n_buckets = n_buckets or partitions_for(docs, F.octet_length("text"), BUCKET_BYTES)
    # rows without an id go by their text, so that they don't gather
    docs = docs.withColumn("u", F.when(F.col("rid") == _NO_ID, F.col("th")).otherwise(F.col("rid")))
    anchors = materialize(shared_anchors(docs.select("u", "text"), length, anchor, hot, n_buckets), "substring-anchors", drop_exchanges=True)
    # fewer than HOT_PARTS keys
    hot_keys = planes(np.concatenate([np.zeros(0, np.uint64), *[unplanes(r["packed"], 5, np.uint64) for r in anchors.where("g = -1").collect()]]), 5)
    slim = docs.select("rid", "th", "u", F.sha2("text", 256).alias("sha"), F.octet_length("text").alias("n"))
    earliest = slim.where(F.col("n") >= length).groupBy("sha", "n").agg(F.min("rid").alias("first_rid"), F.count("*").alias("c"))
    copies = materialize(
        slim.join(earliest.where("c > 1"), ["sha", "n"]).where("rid > first_rid").select("rid", "th", "u").distinct(), "substring-copies", drop_exchanges=True
    )
    wanted = keys_by_document(anchors).join(copies.groupBy("u").agg(F.collect_list("th").alias("copies")), "u", "left")
    is_copy = F.coalesce(F.array_contains("copies", F.col("th")), F.lit(False))
    candidates = docs.join(wanted, "u").where(~is_copy)
    sent = materialize(
        send_segments(candidates.select("rid", "th", "text", "keys"), length, anchor, n_buckets, hot_keys), "substring-segments", drop_exchanges=True
    )
    marks = settle_segments(sent, length, n_buckets).unionByName(copies.select("rid", "th", F.lit(None).cast("binary").alias("ranges")))
    marks = marks.withColumn("marked", F.lit(True))
    judged = docs.join(marks, ["rid", "th"], "left").select("doc_id", "text", "marked", "ranges")

    def cut(batches):
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text
        for b in batches:
            out = []
            for doc_id, text, marked, ranges in zip(*(c.to_pylist() for c in b.columns)):
                raw = text.encode()
                if not marked:
                    kept, n_spans = raw, 0
                elif ranges is None:  # a copy of a whole text
                    kept, n_spans = b"", 1
                else:
                    edges = [0, *np.frombuffer(ranges, np.uint32).tolist(), len(raw)]
                    kept = b"".join(raw[i:j] for i, j in zip(edges[::2], edges[1::2]))
                    n_spans = len(edges) // 2 - 1
                row = (doc_id, len(raw), len(raw) - len(kept), n_spans, hashlib.sha256(kept).hexdigest())
                out.append(row + (kept,) * with_text)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            cols = list(zip(*out)) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=names)

    ddl = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return judged.mapInArrow(cut, ddl)
