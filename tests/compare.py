"""The driver's comparison: row count, column names, and values regardless of order."""

from __future__ import annotations

import glob
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if glob.glob(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return ""
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return f"{float(v):.6f}".rstrip("0").rstrip(".").replace("-0", "0") if float(v) == 0 else f"{float(v):.6f}".rstrip("0").rstrip(".")
    return str(v)


def rows_of(columns: list[str], rows) -> list[tuple[str, ...]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def differences(spark_df, con, sql: str) -> str:
    """Empty if both give the same."""
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    theirs = rows_of(names, got.fetchall())
    ours = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} and {sorted(names)}"
    if len(ours) != len(theirs):
        return f"{len(ours)} and {len(theirs)} rows; {list(set(ours) - set(theirs))[:2]} {list(set(theirs) - set(ours))[:2]}"
    odd = [(a, b) for a, b in zip(ours, theirs, strict=True) if a != b]
    return f"{len(odd)} rows differ, such as {odd[0]}" if odd else ""
