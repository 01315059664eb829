"""Holding a query's rows against those of its SQL, whatever their order."""

from __future__ import annotations

import datetime
import decimal
import math
from collections import Counter
from pathlib import Path

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for p in sorted(Path(folder).glob("*.parquet")):
        at = f"{p}/*.parquet" if p.is_dir() else str(p)
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{at}')")
    return c


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (float, decimal.Decimal)):
        return None if isinstance(v, float) and math.isnan(v) else f"{float(v):.4f}".replace("-0.0000", "0.0000")
    if isinstance(v, int):
        return f"{float(v):.4f}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, datetime.date):
        return datetime.datetime(v.year, v.month, v.day).isoformat()
    return str(v)


def difference(columns: list[str], rows: list, other_columns: list[str], others: list) -> str:
    """'' if both have the same columns and rows."""
    if sorted(columns) != sorted(other_columns):
        return f"columns {sorted(columns)} and {sorted(other_columns)}"
    a = Counter(tuple(plain(r[columns.index(c)]) for c in sorted(columns)) for r in rows)
    b = Counter(tuple(plain(r[other_columns.index(c)]) for c in sorted(columns)) for r in others)
    return "" if a == b else f"{sum(a.values())} and {sum(b.values())} rows; only here {list((a - b).items())[:3]}; only in SQL {list((b - a).items())[:3]}"
