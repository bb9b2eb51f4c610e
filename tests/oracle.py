"""Runs a query and its DuckDB statement on the same tables and compares the rows."""

import datetime
import math
from collections import Counter
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: Path) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return c


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x + 0.0:.9g}"
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    return str(x) if not isinstance(x, (int, bool)) or isinstance(x, bool) else str(x)


def compare(df, sql: str, con) -> str:
    """'' if columns and rows agree, else what differs."""
    rel = con.sql(sql)
    mine, theirs = sorted(df.columns), sorted(rel.columns)
    if mine != theirs:
        return f"columns {mine} and {theirs}"
    a = Counter(tuple(plain(r[c]) for c in mine) for r in df.collect())
    names = rel.columns
    b = Counter(tuple(plain(dict(zip(names, r))[c]) for c in mine) for r in rel.fetchall())
    if a != b:
        return f"rows {sum(a.values())} and {sum(b.values())}; only here {list((a - b))[:3]}; only there {list((b - a))[:3]}"
    return ""
