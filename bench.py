"""Time the headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from tocsin.catalog.queries import QUERIES
from tocsin.session import build_session

HEADLINE = [
    "transition_probability", "direction_stats", "time_pattern", "incident_features", "graph_nodes",
    "graph_edges", "nearest_in_sector", "sector_scan", "corridor_places", "speed_stats",
    "bayes_forecast", "stat_forecast", "graph_forecast", "trajectory_forecast", "report_week",
    "type_class", "place_mentions", "exact_dups", "near_dup_pairs", "retained_messages",
    "token_context", "tfidf_context", "source_history", "incident_assign", "linked_incidents",
    "session_incidents", "auto_close",
]


def timed(spark, sf_dir: str, name: str) -> float:
    t = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus,
                          spark__ui__enabled="false", spark__driver__memory="12g",
                          spark__ui__showConsoleProgress="false",
                          spark__sql__adaptive__coalescePartitions__minPartitionSize="64k")
    spark.sparkContext.setLogLevel("ERROR")
    timed(spark, sf_dir, "report_places")
    times = {}
    for n in names:
        times[n] = round(statistics.median(timed(spark, sf_dir, n) for _ in range(runs)), 3)
        print(n, times[n], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
