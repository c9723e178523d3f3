"""Spark results against DuckDB's for the same query, as sorted rows of plain values."""

from __future__ import annotations

import datetime
import decimal
import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        path = Path(sf_dir, f"{name}.parquet")
        if path.exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}{'/*' if path.is_dir() else ''}')")
    return con


def plain(x: object) -> object:
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, (float, decimal.Decimal)):
        return None if math.isnan(x) else round(float(x), 5) + 0.0
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    return x


def tidy(rows: list[tuple], names: list[str]) -> list[tuple]:
    by = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in by) for r in rows), key=repr)


def both(spark, sf_dir: str, query, sql: str) -> tuple[list[str], list[tuple], list[str], list[tuple]]:
    df = query(spark, sf_dir)
    con = connect(sf_dir)
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    return sorted(df.columns), tidy([tuple(r) for r in df.collect()], df.columns), sorted(names), tidy(found.fetchall(), names)
