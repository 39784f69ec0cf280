"""Every query with SQL gives the SQL's rows on the smallest tables; the subpackage stays optional."""

import decimal
import math
import os
import subprocess
import sys

import duckdb
import pytest

from tidemark.plans import catalog

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

#: queries over standardised changes share one long plan; these stand for all of them here, the driver runs every one
OVER_CHANGES = {
    "contract_z", "cell_aggregate", "cumsum_index", "shock_confirm", "subset_share_of_shock", "signal_chain", "split_signal_additive",
    "placebo_run", "key_month", "weekend_change", "hourly_index",
}
KEYS = sorted(k for k, q in catalog.ORACLES.items() if "zz0 AS" not in q or k in OVER_CHANGES)


def norm(rows):
    def one(v):
        if isinstance(v, (float, decimal.Decimal)):
            return None if math.isnan(v) else float(f"{v:.7g}")
        return v if v is None or isinstance(v, (bool, int)) else str(v)

    return sorted([tuple(one(v) for _, v in sorted(r.items())) for r in rows], key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in os.listdir(SF):
        if f.endswith(".parquet"):
            p = f"{SF}/{f}"
            c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


@pytest.mark.parametrize("key", KEYS)
def test_matches_sql(spark, con, key):
    got = [r.asDict() for r in catalog.QUERIES[key](spark, SF).collect()]
    cur = con.execute(catalog.ORACLES[key])
    names = [d[0] for d in cur.description]
    assert norm(got) == norm([dict(zip(names, r)) for r in cur.fetchall()])


def sql_rows(path, key):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in os.listdir(path):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{path}/{f}/*.parquet'")
    cur = c.execute(catalog.ORACLES[key])
    names = [d[0] for d in cur.description]
    return norm([dict(zip(names, r)) for r in cur.fetchall()])


@pytest.mark.parametrize("key", ["asof_le", "asof_lt", "asof_next", "weekend_gap"])
def test_nulls_match_nothing(spark, tmp_path, key):
    from pyspark.sql import functions as F

    holes = {"orders": ("o_totalprice", ["o_custkey", "o_orderdate", "o_orderkey"]), "lineitem": ("l_extendedprice", ["l_suppkey", "l_shipdate"]), "events": ("event_id", ["event_type", "ts", "value"])}
    for t, (by, columns) in holes.items():
        rows = spark.read.parquet(f"{SF}/{t}.parquet")
        rows = rows.select(*[F.when(F.xxhash64(F.col(by), F.lit(c)) % 3 != 0, F.col(c)).alias(c) if c in columns else c for c in rows.columns])
        rows.write.parquet(f"{tmp_path}/{t}.parquet")
    assert norm([r.asDict() for r in catalog.QUERIES[key](spark, str(tmp_path)).collect()]) == sql_rows(tmp_path, key)


@pytest.mark.parametrize("key", ["asof_le", "asof_lt", "asof_next"])
def test_equal_lines_are_one_row(spark, tmp_path, key):
    lines = spark.read.parquet(f"{SF}/lineitem.parquet")
    lines.unionByName(lines.where("l_linenumber = 1")).unionByName(lines.where("l_linenumber < 3")).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.read.parquet(f"{SF}/orders.parquet").write.parquet(f"{tmp_path}/orders.parquet")
    want = sql_rows(tmp_path, key)
    assert norm([r.asDict() for r in catalog.QUERIES[key](spark, str(tmp_path)).collect()]) == want
    assert len(want) == lines.distinct().count()


def test_every_day_has_its_largest_moves(spark):
    from pyspark.sql import functions as F

    from tidemark.plans import q_series

    moves = q_series.changed(spark, SF).where("dv is not null").groupBy("day").agg(F.count("*").alias("n")).collect()
    got = catalog.QUERIES["top_moves_per_group"](spark, SF).groupBy("day").agg(F.count("*").alias("n"), F.min("day_rank").alias("lo"), F.max("day_rank").alias("hi")).collect()
    assert len(moves) > 8 and {r["day"]: r["n"] for r in got} == {r["day"]: min(3, r["n"]) for r in moves}
    assert sorted(r["lo"] for r in got) == list(range(1, len(moves) + 1)) and all(r["lo"] == r["hi"] for r in got)


def test_late_rows_are_counted_and_stale_markets_told(spark, tmp_path):
    import datetime as dt

    from tidemark.streaming import tape as stream

    schema = "platform string, platform_id string, ts timestamp, event_id long, price double, size double, is_yes boolean"
    at = dt.datetime(2024, 1, 1)
    batches = [[("p", "1", at, 1), ("p", "2", at, 2)], [("p", "1", at + dt.timedelta(days=9), 3)], [("p", "1", at + dt.timedelta(days=9, minutes=1), 6)], [("p", "2", at + dt.timedelta(days=1), 4), ("p", "1", at + dt.timedelta(days=9, hours=1), 5)]]
    for i, rows in enumerate(batches):
        spark.createDataFrame([(*r, 0.5, 10.0, True) for r in rows], schema).coalesce(1).write.parquet(f"{tmp_path}/in/b{i}")
    read = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    _, late = stream.run_counted(stream.snapshot_panel(read()), "complete", f"{tmp_path}/o1", f"{tmp_path}/c1")
    assert late == 0  # complete mode keeps its state, so nothing is dropped
    _, late = stream.run_counted(stream.hourly_last(read()), "append", f"{tmp_path}/o2", f"{tmp_path}/c2")
    assert late == 1  # rows are held against the watermark of the batch before
    rows = stream.run_once(stream.stale_state(read()), "append", f"{tmp_path}/o3", f"{tmp_path}/c3").collect()
    assert {r["platform_id"] for r in rows if r["stale"]} >= {"2"}
    assert max(r["last_ts"] for r in rows if r["platform_id"] == "1") == at + dt.timedelta(days=9, hours=1)


def test_entry_imports_without_the_subpackage():
    code = (
        "import sys\n"
        "for m in ('tidemark.llm', 'corpus_pipeline'): sys.modules[m] = None\n"
        "import __spark_entry__ as e\n"
        "q = e.queries(); assert 'market_day_panel' in q and 'pipeline' not in q and not any(k.startswith('op1') for k in q)\n"
        "assert set(e.oracle_sql()) <= set(q)\n"
    )
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT).returncode == 0
