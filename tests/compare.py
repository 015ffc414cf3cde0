"""Queries beside their SQL: same columns, rows and values."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def run_sql(directory: str, sql: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in sorted(Path(directory).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    cur = con.execute(sql)
    return [c[0] for c in cur.description], cur.fetchall()


def _key(row: tuple) -> tuple:
    return tuple("\0" if v is None else f"{v:.5f}" if isinstance(v, float) and not math.isnan(v) else str(v) for v in row)


def same(df, directory: str, sql: str) -> str:
    """Empty if equal, else what differs."""
    names, expected = run_sql(directory, sql)
    cols = sorted(names)
    if sorted(df.columns) != cols:
        return f"columns {sorted(df.columns)} and {cols}"
    got = sorted(_key(tuple(r[c] for c in cols)) for r in df.collect())
    want = sorted(_key(tuple(r[names.index(c)] for c in cols)) for r in expected)
    if len(got) != len(want):
        return f"{len(got)} rows, expected {len(want)}"
    for g, w in zip(got, want):
        if any(a != b and not _near(a, b) for a, b in zip(g, w)):
            return f"{g} instead of {w}"
    return ""


def _near(a: str, b: str) -> bool:
    try:
        return abs(float(a) - float(b)) <= 2e-5
    except ValueError:
        return False
