"""Comparing a Spark result with DuckDB's, rows in any order."""

import decimal
import math
import os


def plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float) and math.isnan(v):
        return None
    return v


def duck(data_dir):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(data_dir):
        p = f"{data_dir}/{f}"
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def agree(df, rel):
    assert sorted(df.columns) == sorted(rel.columns)
    cols = sorted(df.columns)
    at = [rel.columns.index(c) for c in cols]
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    want = sorted((tuple(plain(x[i]) for i in at) for x in rel.fetchall()), key=repr)
    assert got == want
