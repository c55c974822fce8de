"""Runs a query and its SQL over the same tables and compares all rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else repr(round(x, 9) + 0.0)
    if isinstance(x, (list, tuple)):
        return "[" + ",".join(map(plain, x)) + "]"
    if isinstance(x, bool) or x is None:
        return str(x)
    if hasattr(x, "as_integer_ratio"):
        return repr(round(float(x), 9) + 0.0)
    return str(x)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


def mismatch(df, sql: str, con: duckdb.DuckDBPyConnection) -> str:
    """What differs between a frame and the SQL's result; nothing if they are the same."""
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(sql)
    columns = [c[0] for c in res.description]
    want = rows(columns, res.fetchall())
    if sorted(columns) != sorted(df.columns):
        return f"columns {df.columns} and {columns}"
    if got != want:
        odd = [x for x in got if x not in set(want)][:2], [x for x in want if x not in set(got)][:2]
        return f"{len(got)} and {len(want)} rows; only here {odd[0]}; only there {odd[1]}"
    return ""
