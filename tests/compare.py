"""Compares registered queries with their SQL in DuckDB, as bags of rows."""

from __future__ import annotations

import datetime
import math
import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if type(v).__name__ == "Decimal":
        return float(f"{float(v):.9g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    return v


def same(df, con, sql):
    """None, or the first differences."""
    cols = sorted(df.columns)
    a = Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())
    rel = con.sql(sql)
    if sorted(rel.columns) != cols:
        return f"columns {cols} against {sorted(rel.columns)}"
    at = [rel.columns.index(c) for c in cols]
    b = Counter(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
    return None if a == b else f"{cols}: only Spark {list((a - b).items())[:3]}, only SQL {list((b - a).items())[:3]}, rows {a.total()} {b.total()}"
