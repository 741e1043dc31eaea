"""Side-by-side comparison of a query with its SQL twin: names, row counts and values."""

from __future__ import annotations

import os
from collections import Counter
from datetime import datetime

import duckdb

NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for n in NAMES:
        path = f"{sf_dir}/{n}.parquet"
        c.execute(f"create view {n} as select * from read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return c


def _value(x):
    if isinstance(x, float):
        return round(x, 9) + 0.0
    if isinstance(x, datetime):
        return x.replace(tzinfo=None)
    return x


def _rows(names, rows) -> Counter:
    order = sorted(range(len(names)), key=lambda k: names[k])
    return Counter(tuple(_value(r[k]) for k in order) for r in rows)


def differences(spark, query, sql: str, sf_dir: str, con=None) -> str:
    """Empty if both give the same rows."""
    con = con or connect(sf_dir)
    found = con.sql(sql)
    names, want = found.columns, found.fetchall()
    df = query(spark, sf_dir)
    if sorted(df.columns) != sorted(names):
        return f"columns {df.columns} and {names}"
    got, want = _rows(df.columns, df.collect()), _rows(names, want)
    if got == want:
        return ""
    return f"{sum(got.values())} rows and {sum(want.values())}; only here {list((got - want).items())[:3]}; only there {list((want - got).items())[:3]}"
