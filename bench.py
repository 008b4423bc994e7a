"""Runs the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from opswell import session
from opswell.plans import load

# One or more per family: words, shares, rates of failure, exact percentiles, buckets, ranks, sliding frames,
# counters, logs, collector lines, matching, closure, stream twins, differences, findings, cascades, incidents.
HEADLINE = [
    "agg01", "agg07", "agg09", "agg10", "agg16", "agg18", "agg23", "agg28", "agg30", "agg33", "agg40", "agg42", "agg47",
    "joi03", "joi19", "joi22", "joi27",
    "win03", "win05", "win08", "win10_hours", "win11", "win16", "win20",
    "log01", "log03", "log05", "cls05",
    "str03", "str03_batch", "str09", "str10", "str14", "str17", "str19",
    "rec05", "rec09", "ent01", "ent05", "inc01", "inc02", "fun06", "scl24", "src18",
]


def run(spark, query, folder) -> float:
    start = time.perf_counter()
    query(spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = session.build(
        f"local[{cpus}]", "opswell-bench",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"), "spark.ui.showConsoleProgress": "false", "spark.checkpoint.dir": tempfile.mkdtemp(prefix="run-")},
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = load()
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    run(spark, queries["agg09"], folder)  # the first job starts the engine; it is not counted
    runs = int(os.environ.get("BENCH_RUNS", "1"))  # more than one: the median counts
    seconds = {n: round(statistics.median(run(spark, queries[n], folder) for _ in range(runs)), 3) for n in names}
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
