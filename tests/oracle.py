"""Holds a query's rows against those of its DuckDB statement."""

from __future__ import annotations

import datetime
import decimal
import glob
import os

import duckdb


def views(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    """A value that is equal for both engines; doubles keep nine digits."""
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, (int, float, decimal.Decimal)):
        return f"{float(value):.9g}" if float(value) != 0 else "0"
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)) and not hasattr(value, "asDict"):
        return "[" + ", ".join(map(_plain, value)) + "]"
    if hasattr(value, "asDict"):
        value = value.asDict()
    if isinstance(value, dict):
        return "{" + ", ".join(f"{k}: {_plain(v)}" for k, v in sorted(value.items())) + "}"
    return str(value)


def rows(columns: list[str], values) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(v[i]) for i in order) for v in values)


def difference(df, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """Empty if both have the same columns and rows."""
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    expected, got = rows(names, found.fetchall()), rows(df.columns, df.collect())
    if len(expected) != len(got):
        return f"{len(got)} rows, {len(expected)} expected"
    apart = [(a, b) for a, b in zip(got, expected, strict=True) if a != b]
    return f"{len(apart)} of {len(got)} rows differ, such as {apart[0]}" if apart else ""
