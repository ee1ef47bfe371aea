"""Compares a query's rows with its SQL's in DuckDB, columns by name, rows in any order."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(sf_dir: str):
    db = duckdb.connect()
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.basename(path).removesuffix(".parquet")
        source = f"{path}/*.parquet" if os.path.isdir(path) else path
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{source}')")
    return db


def _plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}") + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(_plain(v) for v in x)
    if hasattr(x, "asDict"):
        return tuple(sorted((k, _plain(v)) for k, v in x.asDict().items()))
    return x


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def difference(df, sql: str, db) -> str:
    """What differs, empty if nothing does."""
    got = rows_of(df.columns, df.collect())
    result = db.execute(sql)
    names = [d[0] for d in result.description]
    want = rows_of(names, result.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if got != want:
        only_got, only_want = [r for r in got if r not in set(want)][:2], [r for r in want if r not in set(got)][:2]
        return f"{len(got)} and {len(want)} rows; only here {only_got}; only in SQL {only_want}"
    return ""
