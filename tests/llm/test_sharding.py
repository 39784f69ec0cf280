"""Size-tiered shards: exact round trip, tiers and runs, versions, atomic commit."""

import random
import tempfile
from collections import Counter

import pytest
from tests.llm.util import ODD, SMALL, docs

from tidemark.llm import sharding


def content(df):
    return Counter(tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in df.collect())


def test_round_trip_and_versions(spark):
    root = tempfile.mkdtemp(prefix="spark-")
    documents = spark.read.parquet(f"{SMALL}/documents.parquet").repartition(4)
    store = sharding.ShardStore(spark, root)
    assert store.version() == 0 and store.manifest().count() == 0
    assert store.append(documents.where("doc_id % 2 = 0"), rows_per_file=5) == 1
    assert store.append(documents.where("doc_id % 2 = 1"), rows_per_file=5) == 2
    before = store.manifest().collect()
    assert max(r["n_docs"] for r in before) <= 5 and {r["added_in"] for r in before} == {1, 2}
    assert len({r["shard"] for r in before}) == len(before)
    assert store.compact(target_bytes=60_000) == 3
    after = store.manifest().collect()
    assert len(after) < len(before) / 2
    assert sum(r["n_docs"] for r in after) == documents.count()
    assert content(store.read()) == content(documents)
    assert content(store.read(1)) == content(documents.where("doc_id % 2 = 0"))
    assert {(r["path"], r["shard"]) for r in store.manifest(2).collect()} == {(r["path"], r["shard"]) for r in before}
    got = sharding.assignment(store).collect()
    sizes = Counter(r["shard"] for r in got)
    assert all(sizes[r["shard"]] == r["n_docs"] for r in after)


def test_runs_are_of_one_tier_and_target_sized(spark):
    root = tempfile.mkdtemp(prefix="spark-")
    store = sharding.ShardStore(spark, root)
    store.append(spark.read.parquet(f"{SMALL}/documents.parquet").repartition(3), rows_per_file=3)
    files = {r["path"]: r for r in store.manifest().collect()}
    runs = {}
    for r in store.plan(40_000, 2, 1000).collect():
        runs.setdefault(r["run"], []).append(files[r["path"]])
    assert runs
    for members in runs.values():
        assert len(members) >= 2 and len({m["tier"] for m in members}) == 1
        sizes = [m["n_bytes"] for m in members]
        assert max(sizes) < 4.01 * min(sizes) and sum(sizes) < 40_000 + max(sizes)
    assert len({r["path"] for r in store.plan(40_000, 2, 7).collect()}) <= 7


def test_plan_against_a_loop(spark):
    rng = random.Random(8)
    for target, min_run, most in ((1000, 2, 10_000), (1000, 4, 10_000), (300, 2, 25), (50, 2, 10_000)):
        rows = [(f"f{i}", i, rng.choice([None, rng.randint(0, 30)]), 1, rng.choice([30, 90, 250, 999, 1000, 5000]), rng.randint(0, 2), 1) for i in range(80)]
        store = sharding.ShardStore(spark, "/none")
        store.manifest = lambda version=None, rows=rows: spark.createDataFrame(rows, sharding.MANIFEST)
        small = [r for r in rows if r[4] < target]
        small.sort(key=lambda r: (r[5], r[2] is not None, r[2] or 0, r[0]))  # as the plan takes them: nulls first
        runs = {}
        for tier in (0, 1, 2):
            before = 0
            mine = [r for r in small[:most] if r[5] == tier]
            for r in sorted(mine, key=lambda r: (r[2] is None, r[2] or 0, r[0])):
                runs.setdefault(f"{tier}-{before // target}", []).append(r[0])
                before += r[4]
        want = {(path, run) for run, paths in runs.items() if len(paths) >= min_run for path in paths}
        assert {(r["path"], r["run"]) for r in store.plan(target, min_run, most).collect()} == want


def test_commit_is_exclusive_and_nothing_due(spark):
    root = tempfile.mkdtemp(prefix="spark-")
    store = sharding.shard_documents(docs(spark, ODD).coalesce(1), root)
    assert store.version() == 1 and store.compact() == 1
    assert content(store.read()) == content(docs(spark, ODD))
    with pytest.raises(RuntimeError):
        store._commit(store.manifest(), 1)
    assert store.append(docs(spark, ODD).limit(0)) == 2
    assert content(store.read()) == content(docs(spark, ODD))


def test_clashing_columns(spark):
    root = tempfile.mkdtemp(prefix="spark-")
    df = docs(spark, ODD).selectExpr("*", "1 as run", "2 as path")
    store = sharding.ShardStore(spark, root)
    store.append(df.repartition(4), rows_per_file=1)
    store.compact()
    back = store.read(columns=["doc_id", "run", "path"])
    assert back.count() == len(ODD) and {r["run"] for r in back.collect()} == {1}


def test_two_writers_that_interleave(spark):
    root = tempfile.mkdtemp(prefix="spark-")
    sharding.ShardStore(spark, root).append(docs(spark, ODD[:2]))
    slow, fast = sharding.ShardStore(spark, root), sharding.ShardStore(spark, root)
    commit, taken = slow._commit, []

    def late(files, version):
        taken.append(fast.append(docs(spark, ODD[2:4])))  # between the slow writer's data and its commit
        return commit(files, version)

    slow._commit = late
    with pytest.raises(RuntimeError):
        slow.append(docs(spark, ODD[4:6]))
    assert taken == [2] and fast.version() == 2
    assert content(fast.read()) == content(docs(spark, ODD[:4]))
    assert sharding.ShardStore(spark, root).append(docs(spark, ODD[4:6])) == 3
    assert content(fast.read()) == content(docs(spark, ODD[:6]))


def test_columns_named_like_the_store_s_own(spark):
    root = tempfile.mkdtemp(prefix="spark-")
    df = docs(spark, ODD).selectExpr("*", "1 as __run", "2 as shard", "3 as tier", "4 as cell")
    store = sharding.shard_documents(df.repartition(3), root, rows_per_file=2)
    assert {(r[0], r[1]) for r in store.read(columns=["doc_id", "__run"]).select("__run", "doc_id").collect()} == {(1, i) for i, _, _ in ODD}
    assert sharding.assignment(store).count() == len(ODD)
