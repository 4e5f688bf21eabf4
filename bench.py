"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm up and then $BENCH_RUNS times (default 1); the time
is the median. Results are consumed in full by Spark's noop sink.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from reelweave import catalog
from reelweave.session import local_session

HEADLINE = [
    "rank_fusion_lineitem",
    "diversified_lineitem",
    "top_k_orders_per_customer",
    "vector_top_k",
    "example_vector_search",
    "in_video_top_n",
    "bm25_rescored_search",
    "caption_idf_search",
    "nearest_event",
    "nearest_boundaries",
    "neighbour_sum_events",
    "interval_sampling",
    "event_bounds_lineitem",
    "sequence_alignment",
    "cheapest_option_chain",
    "team_queue",
    "known_item_search_visual",
]


def main() -> int:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), "reelweave-bench")
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = catalog.load()
    times: dict[str, float] = {}
    for name in names:
        seen = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seen.append(time.perf_counter() - start)
        times[name] = round(statistics.median(seen[1:]), 3)
        print(f"{name} {seen}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    return 0


if __name__ == "__main__":
    sys.exit(main())
