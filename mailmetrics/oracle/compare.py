"""Run a Spark result and a DuckDB query and compare them order-insensitively.

Used by the tests; the same comparison the correctness gate makes: row
count, column names, and the multiset of rows.
"""

from __future__ import annotations

import datetime as dt
import math
import os

from pyspark.sql import DataFrame

DRIVER_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
)


def duckdb_connection(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in DRIVER_TABLES:
        path = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return v
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        try:
            return _norm(v.item())
        except (ValueError, AttributeError):
            pass
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    return v


def _key(row):
    return tuple((x is None, str(type(x).__name__), x if x is not None else 0) for x in row)


def spark_rows(df: DataFrame) -> tuple[list[str], list[tuple]]:
    cols = sorted(df.columns)
    rows = [tuple(_norm(r[c]) for c in cols) for r in df.collect()]
    return cols, sorted(rows, key=_key)


def duck_rows(con, sql: str) -> tuple[list[str], list[tuple]]:
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    data = cur.fetchall()
    order = sorted(range(len(names)), key=lambda i: names[i])
    cols = [names[i] for i in order]
    rows = [tuple(_norm(r[i]) for i in order) for r in data]
    return cols, sorted(rows, key=_key)


def compare(df: DataFrame, con, sql: str) -> list[str]:
    """Return a list of differences (empty when equal)."""
    scols, srows = spark_rows(df)
    dcols, drows = duck_rows(con, sql)
    problems = []
    if scols != dcols:
        problems.append(f"columns differ: spark={scols} duckdb={dcols}")
        return problems
    if len(srows) != len(drows):
        problems.append(f"row count: spark={len(srows)} duckdb={len(drows)}")
    if srows != drows:
        sset, dset = set(srows), set(drows)
        only_s = [r for r in srows if r not in dset][:3]
        only_d = [r for r in drows if r not in sset][:3]
        problems.append(f"rows differ; spark-only {only_s}; duckdb-only {only_d}")
    return problems
