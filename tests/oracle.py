"""Holding a Spark result against DuckDB."""

from __future__ import annotations

import decimal
import math
import os

import duckdb

from florilege.session import TABLES


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v.isoformat() if hasattr(v, "isoformat") else v


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        path = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def same(df, con, sql: str) -> None:
    rows, rel = df.collect(), con.sql(sql)
    names, want = sorted(df.columns), rel.fetchall()
    assert names == sorted(rel.columns)
    at = [rel.columns.index(c) for c in names]
    got = sorted((tuple(plain(r[c]) for c in names) for r in rows), key=repr)
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in want), key=repr)
