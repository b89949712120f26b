"""Runs a query in Spark and its SQL in DuckDB and compares their rows."""

import decimal
import glob
import math
import os

import duckdb


def connect(folder):
    con = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}{'/*.parquet' if os.path.isdir(f) else ''}'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)) and not hasattr(v, "asDict"):
        return tuple(plain(x) for x in v)
    if hasattr(v, "asDict"):
        return plain(v.asDict(True))
    if isinstance(v, dict):
        return tuple((k, plain(x)) for k, x in sorted(v.items()))
    return v


def same(df, con, sql):
    columns = sorted(df.columns)
    ours = sorted((tuple(map(plain, r)) for r in df.select(*columns).collect()), key=repr)
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    theirs = sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=repr)
    assert len(ours) == len(theirs)
    for a, b in zip(ours, theirs):
        assert a == b
