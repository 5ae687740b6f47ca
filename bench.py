"""Times headline queries on local Spark and prints one JSON line.

BENCH_SF_DIR, BENCH_CPUS and BENCH_RUNS choose tables, cores and timed runs (the median counts).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks.catalog import QUERIES  # noqa: E402
from seqdrift.session import local_session  # noqa: E402

HEADLINE = [
    "order_gaps",
    "feature_stats",
    "size_frequencies",
    "sketched_quantizer",
    "quantize_global",
    "profile_order1",
    "kl_delta_uniform",
    "kl_cumulative_order1",
    "assembled_flows",
    "discard_reasons",
    "generate_order0",
    "sample_rows",
    "export_raw",
    "export_quantized",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = local_session(cpus)
    times = {}
    for name in HEADLINE:
        taken = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        # the first run loads classes and compiles code
        times[name] = round(statistics.median(taken[1:]), 3)
    print(json.dumps({"metric": "warm_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1], "cpus": cpus, "runs": runs}))


if __name__ == "__main__":
    main()
