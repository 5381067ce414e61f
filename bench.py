"""Times the headline queries and prints one JSON line.

Every query is run to a sink that keeps nothing, so that the time is Spark's alone. After a
warm-up pass over all queries, BENCH_RUNS passes (4) are timed; the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidewatch.queries import QUERIES  # noqa: E402


def timed(spark: SparkSession, name: str, folder: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    passes = int(os.environ.get("BENCH_RUNS", "4"))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or sorted(QUERIES)
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("tidewatch-bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    taken = []
    while len(taken) <= passes:
        taken.append({name: timed(spark, name, folder) for name in names})
        print(f"pass {len(taken)}: {sum(taken[-1].values()):.1f} s", file=sys.stderr, flush=True)
    counted = taken[1:] or taken
    times = {n: round(statistics.median(p[n] for p in counted), 3) for n in names}
    spread = {n: round(statistics.stdev([p[n] for p in counted]), 3) if len(counted) > 1 else None for n in names}
    for name in names:
        print(f"{name:22s} {times[name]:8.3f}", file=sys.stderr)
    spark.stop()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "stddev": spread, "runs": len(counted), "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
    }))


if __name__ == "__main__":
    main()
