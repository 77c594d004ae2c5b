"""Compares a query with DuckDB's rows of its SQL."""

from __future__ import annotations

import decimal
import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def same_rows(df, sql: str, folder: str) -> None:
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/*.parquet'" if os.path.isdir(path) else f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    out = c.execute(sql)
    names = [d[0] for d in out.description]
    want = Counter(tuple(plain(r[names.index(n)]) for n in sorted(names)) for r in out.fetchall())
    got = Counter(tuple(plain(r[n]) for n in sorted(df.columns)) for r in df.collect())
    assert sorted(df.columns) == sorted(names)
    assert got == want
