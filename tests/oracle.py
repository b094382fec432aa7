"""Compares a query's rows with those of its SQL in DuckDB."""

from __future__ import annotations

import math
import os
from collections import Counter
from functools import lru_cache

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@lru_cache(2)
def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def rows_of(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def check(spark, sf_dir: str, query, sql: str) -> int:
    """Asserts equal columns and equal rows, repeated ones counted; returns their number."""
    got = query(spark, sf_dir)
    found = database(sf_dir).cursor().execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(got.columns) == sorted(names)
    a, b = rows_of(got.columns, got.collect()), rows_of(names, found.fetchall())
    assert a == b, f"only here: {list((a - b).items())[:3]}; only in SQL: {list((b - a).items())[:3]}"
    return sum(a.values())
