"""Time each oracle query on DuckDB (the in-process engine the audited app uses).

Usage: python tools/duckdb_yardstick.py [sf_dir]
Prints one JSON line like bench.py. This is an engine-only lower bound for a
single process: it fetches each result but does none of the app's per-row
pandas / JSON work.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from eventlens.registry import ORACLE_SQL  # noqa: E402
from tools.check_oracle import TABLES  # noqa: E402


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    con = duckdb.connect()
    con.execute("SET threads TO 8")
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    timings = {}
    for name, sql in ORACLE_SQL.items():
        best = None
        for _ in range(3):
            t0 = time.perf_counter()
            con.execute(sql).fetchall()
            dt = time.perf_counter() - t0
            best = dt if best is None else min(best, dt)
        timings[name] = round(best, 4)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "duckdb_total_query_seconds", "value": round(sum(timings.values()), 3),
                      "unit": "sec", "queries": timings, "sf": float(m.group(1)) if m else None}))


if __name__ == "__main__":
    main()
