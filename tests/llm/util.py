import glob
import os

import duckdb

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    """rows: (doc_id, text, source)"""
    return spark.createDataFrame([(i, t, "en", s, None) for i, t, s in rows], SCHEMA)


def oracle(sql, sf_dir=SMALL, tables=("documents",), frames=None):
    """Rows of ``sql`` as dicts."""
    con = duckdb.connect()
    for t in tables:
        if frames and t in frames:
            con.register(t, frames[t])
            continue
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    cur = con.execute(sql)
    names = [x[0] for x in cur.description]
    return [dict(zip(names, r)) for r in cur.fetchall()]


def same(a, b):
    """Equal as multisets of rows, doubles to nine digits."""

    def norm(rows):
        return sorted(
            repr(sorted((k, float(f"{v:.9g}") if isinstance(v, float) else v) for k, v in r.items())) for r in rows
        )

    return norm(a) == norm(b)


ODD = [
    (1, None, None),
    (2, "", "a"),
    (3, "same text here", "a"),
    (4, "same text here", "b"),
    (4, "same text here", "b"),
    (None, "same text here", None),
    (None, "lonely", "c"),
    (7, "word " * 30000, "a"),
    (8, "\u0001 odd \u0002 ééé 😀 password = hunter2hunter2", "z"),
]
