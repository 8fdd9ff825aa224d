"""Run a registered query and its SQL on the same tables and compare every value."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

NAMES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in NAMES:
        if Path(f"{folder}/{name}.parquet").exists():
            con.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return con


def cell(v):
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else repr(v + 0.0)
    return str(v)


def differences(df, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    names = sorted(df.columns)
    mine = sorted(tuple(cell(r[n]) for n in names) for r in df.collect())
    result = con.execute(sql)
    theirs_names = [c[0] for c in result.description]
    if sorted(theirs_names) != names:
        return [f"columns {names} against {sorted(theirs_names)}"]
    at = [theirs_names.index(n) for n in names]
    theirs = sorted(tuple(cell(r[i]) for i in at) for r in result.fetchall())
    if len(mine) != len(theirs):
        return [f"{len(mine)} rows against {len(theirs)}", f"{mine[:2]}", f"{theirs[:2]}"]
    wrong = [(a, b) for a, b in zip(mine, theirs) if a != b]
    notes = [f"{a} against {b}" for a, b in wrong[:3]]
    return [f"{len(wrong)} of {len(mine)} rows differ", *notes] if wrong else []
