"""Holds a query's rows against its SQL in DuckDB."""

from __future__ import annotations

import glob
import os

import duckdb

from quarry.sources import TABLES


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = f"{folder}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'") if glob.glob(p) else None
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(v[k] for k in order) for v in values), key=repr), [columns[k] for k in order]


def assert_same(spark, df, sql, con):
    got, names = rows(df.columns, [tuple(r) for r in df.collect()])
    rel = con.execute(sql)
    expected, their = rows([c[0] for c in rel.description], rel.fetchall())
    assert names == their
    assert len(got) == len(expected)
    for a, b in zip(got, expected, strict=True):
        assert a == b
