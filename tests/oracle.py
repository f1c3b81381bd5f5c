"""Runs a query in Spark and its oracle in DuckDB and compares the rows."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os

import duckdb

from townhall.plans.fixtures import TABLES

DATA = os.environ.get("TOWNHALL_DATA", "/root/testdata/sf0.01")


def connect(folder: str = DATA):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (int, float, decimal.Decimal)):
        f = float(v)
        return "nan" if math.isnan(f) else f"{f:.9g}"
    if isinstance(v, dt.datetime):
        return v.isoformat(sep=" ")
    return str(v)


def rows_of(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


def compare(spark, con, key, queries, oracles, folder: str = DATA):
    """None when equal, else a short description of the difference."""
    df = queries[key](spark, folder)
    left = rows_of(df.columns, [tuple(r) for r in df.collect()])
    rel = con.execute(oracles[key])
    cols = [c[0] for c in rel.description]
    if sorted(cols) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(cols)}"
    right = rows_of(cols, rel.fetchall())
    if left == right:
        return None
    ls, rs = set(left), set(right)
    only_l = [r for r in left if r not in rs][:2]
    only_r = [r for r in right if r not in ls][:2]
    return f"{len(left)} rows vs {len(right)}; {sorted(cols)}\n  spark only {str(only_l)[:900]}\n  oracle only {str(only_r)[:900]}"
