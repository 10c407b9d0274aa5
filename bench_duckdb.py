"""
queries (the oracle SQL) run by DuckDB over the same staged Parquet tables.

Usage: python bench_duckdb.py <staged-folder> [threads]; the staged folder
is what bench.py writes (one Parquet folder per source table).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from mailmetrics.oracle.reports_sql import REPORT_SQL, report_sql  # noqa: E402
from mailmetrics.sources.schemas import SCHEMAS  # noqa: E402


def main() -> None:
    import duckdb

    root = sys.argv[1]
    threads = int(sys.argv[2]) if len(sys.argv) > 2 else 8
    con = duckdb.connect()
    con.execute(f"SET threads={threads}")
    con.execute("SET TimeZone='UTC'")
    for t in SCHEMAS:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{root}/{t}/*.parquet')")
    out = {}
    for name in REPORT_SQL:
        sql = report_sql(name, over_fixtures=False)
        best = None
        for i in range(4):
            t0 = time.perf_counter()
            con.execute(sql).fetchall()
            dt = time.perf_counter() - t0
            if i:
                best = dt if best is None else min(best, dt)
        out[name] = round(best, 4)
    print(json.dumps({"engine": "duckdb", "threads": threads, "value": round(sum(out.values()), 4),
                      "queries": out}))


if __name__ == "__main__":
    main()
