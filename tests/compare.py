"""Comparison of a query's rows with DuckDB's, by value and without regard to order."""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os
from collections import Counter

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        source = f"{path}/*.parquet" if os.path.isdir(path) else path
        if glob.glob(source):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{source}')")
    return con


def plain(v):
    """A value in a form that both engines share."""
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, decimal.Decimal | float):
        return "nan" if isinstance(v, float) and math.isnan(v) else round(float(v), 9)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    return v


def rows_of(names: list[str], rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def differences(df, sql: str, con) -> str:
    """Empty if the rows agree, else what differs first."""
    cur = con.execute(sql)
    want_names = [c[0] for c in cur.description]
    want = rows_of(want_names, cur.fetchall())
    got = rows_of(df.columns, df.collect())
    if sorted(df.columns) != sorted(want_names):
        return f"columns {sorted(df.columns)} and {sorted(want_names)}"
    if got != want:
        return f"{sum(got.values())} and {sum(want.values())} rows; only here {list((got - want).items())[:3]}; only there {list((want - got).items())[:3]}"
    return ""
