"""Runs SQL over the Parquet tables with DuckDB and compares rows."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


def rows_of(names, rows):
    at = sorted(range(len(names)), key=lambda i: names[i])
    clean = lambda v: round(v, 6) if isinstance(v, float) and math.isfinite(v) else v
    return sorted((tuple(clean(r[i]) for i in at) for r in rows), key=repr)


def same(df, sf, sql):
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    q = duck(sf).execute(sql)
    want = rows_of([x[0] for x in q.description], q.fetchall())
    assert sorted(df.columns) == sorted(x[0] for x in q.description)
    assert got == want
