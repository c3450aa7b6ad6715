"""A query's rows beside those of its SQL in DuckDB."""

import glob
import os

import duckdb


def tables(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def key(value):
    return (f"{value:.9g}" if isinstance(value, float) else str(value)) if value is not None else ""


def compare(frame, sql, sf_dir):
    found = tables(sf_dir).execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(frame.columns)
    want = sorted(tuple(key(r[names.index(c)]) for c in frame.columns) for r in found.fetchall())
    got = sorted(tuple(key(v) for v in r) for r in frame.collect())
    assert got == want
    return len(got)
