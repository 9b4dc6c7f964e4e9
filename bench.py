"""Headline queries at ``$BENCH_SF_DIR``; prints one JSON line.

Each query runs once to warm up and then three times; the median counts. The time
includes planning and all jobs a query starts itself.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from termwell.plans import load_queries  # noqa: E402
from termwell.session import local_session  # noqa: E402

HEADLINES = [
    "bm25_topk", "hybrid_topk", "dense_topk", "near_dup_queries", "resolve_conflicts", "run_stats",
    "make_chunks", "chunk_upsert", "expand_query", "intent_struct", "guard_verdict", "guard_repeat_documents",
    "search_catalog", "validate_search", "p95_nearest", "failure_runs", "breaker_states", "stage_cost", "client_rate",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    rounds = int(os.environ.get("BENCH_ROUNDS", "3"))
    only = sys.argv[1:]
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    queries = load_queries()
    seconds = {}
    for name in HEADLINES:
        if only and name not in only:
            continue
        spent = []
        for _ in range(rounds + 1):
            start = time.perf_counter()
            queries[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            spent.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(spent[1:]), 3)
        print(name, [round(s, 2) for s in spent], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": Path(sf_dir).name.removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
