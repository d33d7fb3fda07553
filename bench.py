"""Benchmark: run the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]
and print one JSON line.

Each query is executed to completion with the ``noop`` sink (every row is
produced, nothing is collected to the driver). Times are wall-clock seconds
per query, measured after one warm-up query that starts the JVM paths.
Set BENCH_QUERIES=name,name to run a subset; BENCH_EVENT_LOG=1 writes Spark's
event log to a fresh scratch folder for stage/task times.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "aspect_counts",  # flagship: clauses -> main aspect -> counts
    "match_word",
    "match_substring",
    "split_clauses",
    "clean_text",
    "prepare_triples",
    "tfidf",
    "nb_predict",
    "nb_report",
    "bootstrap_balance",
    "balanced_union",
    "fuse_weighted",
    "class_report",
    "infer_aspects",
    "infer_all_hits",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE

    from pyspark.sql import SparkSession

    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("aspectra-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(max(8, int(cpus) * 2)))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", "16g")
    )
    if os.environ.get("BENCH_EVENT_LOG"):
        log_dir = tempfile.mkdtemp(prefix="aspectra-events-")
        builder = builder.config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", log_dir)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")

    from aspectra.plans.catalog import all_queries
    from aspectra.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    queries = all_queries()

    # Warm-up: first JVM use of the scan and regex paths.
    queries["lexicon_set"](spark, sf_dir).write.format("noop").mode("overwrite").save()

    times: dict[str, float] = {}
    for name in names:
        t0 = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
        print(f"# {name}: {times[name]} s", file=sys.stderr, flush=True)

    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": sf,
                "cpus": int(cpus),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
