"""Bench: headline queries, median of three runs after a warm-up run, one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose
the data and the local parallelism.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame

from furrow.catalog import all_queries
from furrow.session import get_session

HEADLINE = [
    "features_53", "baseline_forecast", "backtest", "ks_drift", "ffill_weather",
    "upsert_prices", "alerts_due",
]
RUNS = 3


def drain(df: DataFrame) -> None:
    """Run the whole plan without moving the result anywhere."""
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(f"local[{cpus}]", int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    names = sys.argv[1:] or HEADLINE
    seconds = {}
    for name in names:
        drain(queries[name](spark, sf_dir))  # warm the files and the JVM
        runs = []
        for _ in range(RUNS):
            start = time.perf_counter()
            drain(queries[name](spark, sf_dir))
            runs.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(runs), 3)
    print(
        json.dumps(
            {
                "metric": "headline_total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
