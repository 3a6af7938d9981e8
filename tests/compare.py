"""Compares Spark rows with DuckDB's."""

from __future__ import annotations

import math
from decimal import Decimal
from pathlib import Path

import duckdb

SF = "/root/testdata/sf0.001"


def plain(value):
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}") + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([plain(r[i]) for i in order] for r in data), key=lambda r: [(x is None, str(x)) for x in r])


def duck(folder: str = SF):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def assert_same(df, sql: str, con) -> None:
    relation = con.execute(sql)
    names = [d[0] for d in relation.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, relation.fetchall())
