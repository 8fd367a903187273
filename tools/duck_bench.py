"""Time the oracle SQL of the headline queries in DuckDB on the same files.

Usage: python tools/duck_bench.py [sf_dir] [query ...]
Same protocol as bench.py: one warm-up, then the median of $BENCH_RUNS runs;
each run materialises the full result (fetchall). Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

from bench import HEADLINE  # noqa: E402
from labeltext.plans.oracle import ORACLE  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[2:] or [q for q in HEADLINE if q in ORACLE]
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    con = duckdb.connect()
    con.execute(f"SET threads = {int(os.environ.get('BENCH_CPUS', '8'))}")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    times = {}
    for name in names:
        def once() -> float:
            t0 = time.perf_counter()
            con.sql(ORACLE[name]).fetchall()
            return time.perf_counter() - t0
        once()
        times[name] = round(statistics.median(once() for _ in range(runs)), 3)
    print(json.dumps({"engine": "duckdb", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": Path(sf).name.removeprefix("sf"), "runs": runs}))


if __name__ == "__main__":
    main()
