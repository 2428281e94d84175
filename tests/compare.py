"""Comparison of a query's rows with DuckDB's on the same tables."""

import math
import os

import duckdb

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str = DATA):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return float(f"{v:.9g}") + 0.0 if math.isfinite(v) else str(v)
    if isinstance(v, list | tuple):
        return tuple(norm(x) for x in v)
    return v


def rows_of(names, rows):
    cols = sorted(names)
    return cols, sorted((tuple(norm(r[list(names).index(c)]) for c in cols) for r in rows), key=repr)


def check(spark, query, sql, sf_dir: str = DATA):
    df = query(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    want = duck(sf_dir).sql(sql)
    assert got == rows_of(want.columns, want.fetchall())
