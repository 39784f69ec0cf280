"""From signatures to linked classes: runs of equal keys, verified links, components.

``candidate_runs`` turns items into (key, id) rows of every key that two or more ids
share.  A task packs its keys into a few binary rows for each bucket instead of one row
for each key, and sends on only the smallest id of a key; the other ids of that key are
already known to be in a run and travel in a bucket of their own, so that a key that a
third of all items share never gathers in one task.

``linked_classes`` then finds the classes of the verified link graph without writing out
all pairs of a run: each member is compared with the smallest id of its runs and
components are formed.  Where other members of a run are still in different classes, they are
compared inside tasks, in blocks of bounded size: a member is sent once, and blocks of large runs
are read from files of the shared folder.  A task leaves out pairs of one class, pairs that
an earlier key of both settles, and pairs whose sketches are too different, and returns
the links of a spanning forest only.  When that is done, every two members of a run are
either in one class or were found not to be linked.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow.fs import FileType as fs_type
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import files_for, materialize, open_fs, shared_dir, wide_partitions

#: rows of a few numbers, and of a text, that a task writes at least where the table's size is known
NUMBER_ROWS, TEXT_ROWS = 200_000, 20_000

#: signer(texts) -> (index of the text for each key, keys as uint64)
Signer = Callable[[list[str]], tuple[np.ndarray, np.ndarray]]

_FLUSH = 500_000
_LEADER, _LEADER_OF_RUN, _MEMBER = 0, 1, 2


def _sorted_pairs(keys: np.ndarray, ids: np.ndarray):
    """Distinct (key, id) in order, and the start of each key."""
    order = np.argsort(keys)
    keys, ids = keys[order], ids[order]
    again = keys[1:] == keys[:-1]
    tied = np.flatnonzero(np.append(again, False) | np.insert(again, 0, False)) if len(keys) else order  # few of a task's keys repeat
    ids[tied] = ids[tied][np.lexsort((ids[tied], keys[tied]))]
    if not len(keys):
        return keys, ids, np.zeros(0, np.int64)
    fresh = np.ones(len(keys), bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])
    keys, ids = keys[fresh], ids[fresh]
    return keys, ids, np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))


def packed_entries(keys: np.ndarray, ids: np.ndarray, n_buckets: int) -> Iterator[tuple[int, bytes, bytes, bytes]]:
    """(bucket, keys, ids, kinds) rows of one task's entries."""
    keys, ids, starts = _sorted_pairs(keys, ids)
    sizes = np.diff(np.append(starts, len(keys)))
    kinds = np.full(len(keys), _MEMBER, np.uint8)
    kinds[starts] = np.where(sizes > 1, _LEADER_OF_RUN, _LEADER)
    spread = np.where(kinds == _MEMBER, ids.view(np.uint64), keys)
    buckets = ((spread * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % n_buckets
    order = np.argsort(buckets.astype(np.min_scalar_type(n_buckets)), kind="stable")  # narrow numbers are sorted by digits
    buckets, keys, ids, kinds = buckets[order], keys[order], ids[order], kinds[order]
    at = np.flatnonzero(np.concatenate([[True], buckets[1:] != buckets[:-1]])) if len(buckets) else []
    for a, b in zip(at, [*at[1:], len(buckets)]):
        yield int(buckets[a]), keys[a:b].tobytes(), ids[a:b].tobytes(), kinds[a:b].tobytes()


def runs_of(keys: np.ndarray, ids: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, id) of the members and of the leaders whose key has another id anywhere."""
    lead = kinds != _MEMBER
    k, i, starts = _sorted_pairs(keys[lead], ids[lead])
    sizes = np.diff(np.append(starts, len(k)))
    of_run = np.unique(keys[kinds == _LEADER_OF_RUN])
    keep = np.repeat(sizes > 1, sizes)
    if len(of_run):
        keep |= of_run[np.minimum(np.searchsorted(of_run, k), len(of_run) - 1)] == k
    return np.concatenate([k[keep], keys[~lead]]), np.concatenate([i[keep], ids[~lead]])


def candidate_runs(items: DataFrame, make_signer: Callable[[], Signer], n_buckets: int | None = None) -> DataFrame:
    """Items (id long, text string) to (key long, id long): all ids of each key that two share."""
    n_buckets = n_buckets or 4 * wide_partitions(items.sparkSession)
    names = ["bucket", "keys", "ids", "kinds"]

    def emit(parts) -> pa.RecordBatch:
        rows = list(packed_entries(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), n_buckets))
        cols = list(zip(*rows)) if rows else [[], [], [], []]
        kinds = [pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=names)

    def sign(batches):
        signer, parts, n = make_signer(), [], 0
        for b in batches:
            ids, texts = b.column(0).to_numpy(), b.column(1)
            for at in range(0, len(ids), 500):
                index, keys = signer(texts.slice(at, 500).to_pylist())
                parts.append((keys, ids[at : at + 500][index].astype(np.int64)))
                n += len(keys)
                if n >= _FLUSH:
                    yield emit(parts)
                    parts, n = [], 0
        if parts:
            yield emit(parts)

    def gather(t: pa.Table) -> pa.Table:
        keys, ids, kinds = (
            np.frombuffer(b"".join(t.column(c).to_pylist()), d)
            for c, d in (("keys", np.uint64), ("ids", np.int64), ("kinds", np.uint8))
        )
        k, i = runs_of(keys, ids, kinds)
        return pa.table({"key": pa.array(k.view(np.int64)), "id": pa.array(i)})

    packed = items.mapInArrow(sign, "bucket int, keys binary, ids binary, kinds binary")
    return packed.groupBy("bucket").applyInArrow(gather, "key long, id long")


class Matcher:
    """How candidates are judged; made anew in each task.

    ``sketch(texts)`` gives for each text its keys and a row of minimum hashes (eight of their lower
    bits, as the upper ones of a minimum are mostly 0); ``stages`` has (n, share) pairs: with a smaller share
    of equals among the first n minimum hashes a pair isn't taken to be linked (several standard deviations
    under the threshold); ``check(text, text)`` decides, and ``check_all`` does so for a list of pairs.
    """

    stages: list[tuple[int, float]] = []

    def sketch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raise NotImplementedError

    def check(self, x: str, y: str) -> bool:
        raise NotImplementedError

    def check_all(self, pairs: list[tuple[str, str]]) -> Iterator[bool]:
        return (self.check(x, y) for x, y in pairs)


def near(p: np.ndarray, q: np.ndarray, stages: list[tuple[int, float]]) -> np.ndarray:
    """Numbers of the rows of minimum hashes that are alike enough at every stage."""
    left = np.arange(len(p))
    for n, share in stages:
        left = left[(p[left, :n] == q[left, :n]).mean(1) >= share]
    return left


def with_sketches(payload: DataFrame, make_matcher: Callable[[], Matcher]) -> DataFrame:
    """(id, text) to (id, text, keys, mins)."""

    def run(batches):
        matcher = make_matcher()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                b = batch.slice(at, 500)
                keys, mins = matcher.sketch(b.column("text").to_pylist())
                cols = [b.column("id"), b.column("text")]
                cols += [pa.array([r.tobytes() for r in m], pa.binary()) for m in (keys, mins)]
                yield pa.RecordBatch.from_arrays(cols, names=["id", "text", "keys", "mins"])

    return payload.select("id", "text").mapInArrow(run, "id long, text string, keys binary, mins binary")


def verified(pairs: DataFrame, payload: DataFrame, make_matcher: Callable[[], Matcher]) -> DataFrame:
    """The pairs (a, b) whose texts are linked; payload as made by ``with_sketches``."""

    def run(batches):
        matcher = make_matcher()
        for batch in batches:
            if not batch.num_rows:
                continue
            p, q = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("p", "q"))
            left = near(p, q, matcher.stages)
            linked = []
            for at in range(0, len(left), 1000):
                part = pa.array(left[at : at + 1000])
                x, y = (batch.column(c).take(part).to_pylist() for c in ("x", "y"))
                linked += itertools.compress(part.to_pylist(), matcher.check_all(list(zip(x, y))))
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(linked, pa.int64())) for c in ("a", "b")], names=["a", "b"])

    left = payload.select(F.col("id").alias("a"), F.col("text").alias("x"), F.col("mins").alias("p"))
    right = payload.select(F.col("id").alias("b"), F.col("text").alias("y"), F.col("mins").alias("q"))
    both = pairs.join(left, "a").join(right, "b")
    return both.select("a", "x", "p", "b", "y", "q").mapInArrow(run, "a long, b long")


def _near_pairs(order: np.ndarray, run: np.ndarray, split: np.ndarray, own, classes, parent, key, keys, mins, stages):
    """Pairs (i, j) worth checking: of one run and of different classes.

    ``classes`` are numbers into ``parent``, the union-find array, which may be joined further while pairs are taken.

    ``order`` lists positions by run and class, ``run`` and ``split`` belong to it.  Left out are pairs on one
    side where two sides meet, pairs that share an earlier key, and pairs with too few equal minimum hashes.
    """
    c = classes[order]
    n = len(order)
    new_run = np.concatenate([[True], run[1:] != run[:-1]])
    new_class = new_run | np.concatenate([[True], c[1:] != c[:-1]])
    # for each place the end of its class in the run, and the end of the run: it meets those in between
    heads, tops = np.append(np.flatnonzero(new_class), n), np.append(np.flatnonzero(new_run), n)
    class_end, run_end = heads[np.cumsum(new_class)], tops[np.cumsum(new_run)]
    reach = np.cumsum(run_end - class_end)
    at = 0
    while at < n:
        stop = max(at + 1, int(np.searchsorted(reach, (reach[at - 1] if at else 0) + 50_000, side="right")))
        count = (run_end - class_end)[at:stop]
        left = np.repeat(np.arange(at, stop), count)
        begin = np.cumsum(count) - count
        right = np.arange(len(left)) - np.repeat(begin - class_end[at:stop], count)
        keep = ~split[left] | (own[order[left]] != own[order[right]])
        i, j = order[left[keep]], order[right[keep]]
        apart = parent[classes[i]] != parent[classes[j]]
        i, j = i[apart], j[apart]
        for n_mins, share in stages:
            alike = (mins[i, :n_mins] == mins[j, :n_mins]).mean(1) >= share
            i, j = i[alike], j[alike]
        first = (keys[i] == keys[j]).argmax(1)
        mine = keys[i, first] == key[i]
        yield from zip(i[mine].tolist(), j[mine].tolist())
        while (parent != parent[parent]).any():
            parent[:] = parent[parent]
        at = stop


def _spanning(order, run, split, own, key, c, keys, mins, text_of, matcher) -> list[tuple[int, int]]:
    """Linked pairs of positions, no more than join the classes ``c`` that are linked at all."""
    classes = np.unique(c, return_inverse=True)[1]
    parent = np.arange(classes.max(initial=0) + 1)

    def find(x):
        while (up := int(parent[x])) != x:
            x = up
        return x

    out = []
    for i, j in _near_pairs(order, run, split, own, classes, parent, key, keys, mins, matcher.stages):
        a, b = find(classes[i]), find(classes[j])
        if a != b and matcher.check(text_of(i), text_of(j)):
            parent[max(a, b)] = min(a, b)
            out.append((i, j))
    return out


_BLOCK_COLUMNS = ["id", "c", "keys", "mins"]


class _Block:
    """Members of a part of a run, from its file; their texts are read when the first is asked for."""

    def __init__(self, path: str):
        self.path = path
        t = self._columns(_BLOCK_COLUMNS)
        self.ids, self.c = t["id"].to_numpy(), t["c"].to_numpy()
        self.keys = np.frombuffer(b"".join(t["keys"].to_pylist()), np.int64).reshape(len(self.ids), -1)
        self.mins = np.frombuffer(b"".join(t["mins"].to_pylist()), np.uint8).reshape(len(self.ids), -1)
        self.texts = None

    def _columns(self, names: list[str]) -> pa.Table:
        fs, path = open_fs(self.path)
        return pq.read_table(path, filesystem=fs, columns=names)

    def text(self, i: int) -> str:
        if self.texts is None:
            self.texts = self._columns(["text"])["text"]
        return self.texts[i].as_py()


def _between(key: int, x: _Block, y: _Block | None, roots: dict[int, int], matcher: Matcher) -> list[tuple[int, int]]:
    """Links (id, id) within a block or between two; ``roots`` is the union-find of the classes met so far."""

    def root(c: int) -> int:
        while (up := roots.setdefault(c, c)) != c:
            c = up
        return c

    both = [x] if y is None else [x, y]
    ids, c, keys, mins = (np.concatenate([getattr(b, n) for b in both]) for n in ("ids", "c", "keys", "mins"))
    c = np.array([root(v) for v in c.tolist()], np.int64)
    own = np.repeat(np.arange(len(both)), [len(b.ids) for b in both])
    order = np.lexsort((ids, c))
    one = np.zeros(len(ids), np.int64)
    found = _spanning(
        order, one, np.full(len(ids), y is not None), own, np.full(len(ids), key), c, keys, mins,
        lambda i: x.text(i) if i < len(x.ids) else y.text(i - len(x.ids)), matcher,
    )
    for i, j in found:
        a, b = root(int(c[i])), root(int(c[j]))
        roots[max(a, b)] = min(a, b)
    return [(int(ids[i]), int(ids[j])) for i, j in found]


def _pairs_table(pairs: list[tuple[int, int]]) -> pa.Table:
    cols = list(zip(*pairs)) if pairs else [[], []]
    return pa.table({"a": pa.array(cols[0], pa.int64()), "b": pa.array(cols[1], pa.int64())})


def large_run_links(dealt: DataFrame, payload: DataFrame, make_matcher: Callable[[], Matcher]) -> DataFrame:
    """Links of runs in several parts (key, id, c, part, parts).

    Every member is sent once, to the task that writes its part's file in the shared folder.  A part then meets half of
    the others, whose sketches it reads from their files one after the other; their texts only where sketches agree.
    """
    folder = f"{shared_dir(dealt.sparkSession)}/run-parts-{uuid.uuid4().hex}"

    def store(t: pa.Table) -> pa.Table:
        key, part, parts = (t[c][0].as_py() for c in ("key", "part", "parts"))
        fs, root = open_fs(folder)
        fs.create_dir(root)
        name = f"{root}/{key}-{part}"
        staged = f"{name}.{uuid.uuid4().hex}"
        pq.write_table(t.select([*_BLOCK_COLUMNS, "text"]).sort_by("id"), staged, filesystem=fs)
        fs.move(staged, name)
        return pa.table({"key": pa.array([key], pa.int64()), "part": pa.array([part], pa.int32()), "parts": pa.array([parts], pa.int32())})

    def meet(batches):
        matcher = make_matcher()
        for batch in batches:
            for key, part, parts in zip(*(batch.column(c).to_pylist() for c in range(3))):
                # the files are there: a member of a part is a member of the run, so no part of a run is unknown here
                own, roots = _Block(f"{folder}/{key}-{part}"), {}
                links = _between(key, own, None, roots, matcher)
                for step in range(1, parts // 2 + 1):
                    if 2 * step == parts and part >= step:
                        continue  # the other one of the two meets this one
                    other = f"{folder}/{key}-{(part + step) % parts}"
                    fs, path = open_fs(other)
                    if fs.get_file_info(path).type != fs_type.NotFound:  # by chance, no member fell into that part
                        links += _between(key, own, _Block(other), roots, matcher)
                yield _pairs_table(links).combine_chunks().to_batches()[0] if links else _EMPTY_PAIRS

    members = dealt.join(payload, "id").select("key", "part", "parts", *_BLOCK_COLUMNS, "text")
    parts = materialize(members.groupBy("key", "part").applyInArrow(store, "key long, part int, parts int"), "run-parts", files=files_for(dealt, TEXT_ROWS))
    spread = parts.repartition(4 * wide_partitions(dealt.sparkSession), "key", "part")
    return spread.mapInArrow(meet, "a long, b long")


_EMPTY_PAIRS = pa.RecordBatch.from_pydict({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})


def run_links(placed: DataFrame, payload: DataFrame, make_matcher: Callable[[], Matcher], block: int = 1000, files: int | None = None) -> DataFrame:
    """Runs (key, id, c) to links (a, b) between members of different classes c.

    Runs of one class are left out. Runs of up to ``block`` members meet in one task each, many in one group; larger ones are cut into
    parts (``large_run_links``).  A member is sent once for each of its keys.
    """
    n_buckets = 4 * wide_partitions(placed.sparkSession)
    sizes = placed.groupBy("key").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"), F.min("c").alias("lo"), F.max("c").alias("hi"))
    dealt = placed.join(sizes.where("lo <> hi"), "key").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts").cast("long")).cast("int"))
    dealt = materialize(dealt.select("key", "id", "c", "part", "parts"), "dealt", files=files)

    def meet(t: pa.Table) -> pa.Table:
        key, ids, c = (t.column(x).to_numpy() for x in ("key", "id", "c"))
        keys = np.frombuffer(b"".join(t.column("keys").to_pylist()), np.int64).reshape(len(ids), -1)
        mins = np.frombuffer(b"".join(t.column("mins").to_pylist()), np.uint8).reshape(len(ids), -1)
        texts = t.column("text")
        order = np.lexsort((ids, c, key))
        k = key[order]
        run = np.cumsum(np.concatenate([[True], k[1:] != k[:-1]]))
        one = np.zeros(len(ids), bool)
        found = _spanning(order, run, one, one, key, c, keys, mins, lambda i: texts[i].as_py(), make_matcher())
        return _pairs_table([(int(ids[i]), int(ids[j])) for i, j in found])

    bucket = F.pmod(F.xxhash64("key"), F.lit(n_buckets)).cast("int").alias("bucket")
    small = dealt.where("parts = 1").select("key", "id", "c", bucket).join(payload, "id")
    links = small.groupBy("bucket").applyInArrow(meet, "a long, b long")
    large = dealt.where("parts > 1")
    if not large.limit(1).count():
        return links
    return links.unionByName(large_run_links(large, payload, make_matcher))


def components(edges: DataFrame) -> DataFrame:
    """(id, component): smallest id of the component, for every id with an edge.

    Union-find over tables: in every round an id takes the smallest label at the end of its
    own label chain and of its neighbours' (pointer jumping), and so does the root that it
    points to, so that whole trees are hooked and the rounds grow with the logarithm of a
    chain's length.  Labels only fall and rounds end when none does, at one label a
    component.  Every round is written to the shared folder.
    """
    edges = materialize(edges.where("a <> b").select("a", "b"), "edges")
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    files = files_for(both, NUMBER_ROWS)
    labels = materialize(
        both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("component")),
        "labels",
        files=files,
    )
    while True:
        ends = labels.select(F.col("id").alias("component"), F.col("component").alias("end"))
        jumped = labels.join(ends, "component").select("id", F.col("component").alias("old"), "end")
        near = (
            both.join(jumped.select(F.col("id").alias("b"), "end"), "b")
            .groupBy(F.col("a").alias("id"))
            .agg(F.min("end").alias("near"))
        )
        own = F.struct("id", "old", F.least("end", "near").alias("component"))
        root = F.struct(F.col("old").alias("id"), F.lit(None).cast("long").alias("old"), F.least("end", "near").alias("component"))
        labels = materialize(
            jumped.join(near, "id")
            .select(F.inline(F.array(own, root)))
            .groupBy("id")
            .agg(F.max("old").alias("old"), F.min("component").alias("component")),
            "labels",
            files=files,
        )
        if not labels.where("component <> old").limit(1).count():
            return labels.select("id", "component")
        labels = labels.drop("old")


def linked_classes(runs: DataFrame, payload: DataFrame, make_matcher: Callable[[], Matcher]) -> DataFrame:
    """(id, component) of the verified link graph over candidate runs; single ids are left out.

    runs (key, id) and payload (id, text) are read several times and should be written tables.
    """
    payload = materialize(with_sketches(payload, make_matcher), "sketched")
    files = files_for(runs, NUMBER_ROWS)
    leaders = runs.groupBy("key").agg(F.min("id").alias("a"))
    members = materialize(runs.join(leaders, "key").where("id <> a"), "members", files=files)
    stars = members.select("a", F.col("id").alias("b")).distinct()
    first = materialize(verified(stars, payload, make_matcher), "links")
    classes = components(first)
    # without the smallest id of a run: it was compared with each of the others
    placed = materialize(members.join(classes, "id", "left").select("key", "id", F.coalesce("component", "id").alias("c")), "placed", files=files)
    second = materialize(run_links(placed, payload, make_matcher, files=files), "links")
    if not second.limit(1).count():
        return classes
    return joined_classes(classes, second)


def joined_classes(classes: DataFrame, links: DataFrame) -> DataFrame:
    """The classes (id, component) after further links (a, b); only the graph of the classes is walked again."""
    ends = links.select(F.col("a").alias("id")).unionByName(links.select(F.col("b").alias("id"))).distinct()
    fresh = ends.join(classes, "id", "left_anti").withColumn("component", F.col("id"))
    known = materialize(classes.select("id", "component").unionByName(fresh), "classes", files=files_for(classes, NUMBER_ROWS))
    left = known.select(F.col("id").alias("a"), F.col("component").alias("x"))
    right = known.select(F.col("id").alias("b"), F.col("component").alias("y"))
    between = links.join(left, "a").join(right, "b").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
    moved = components(between).select(F.col("id").alias("component"), F.col("component").alias("to"))
    return known.join(moved, "component", "left").select("id", F.coalesce("to", "component").alias("component"))
