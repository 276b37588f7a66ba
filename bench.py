"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is executed in full with the ``noop`` sink (every row computed,
nothing collected to the driver). Every query first runs once on the smallest
data set (sf0.001) so code generation, JIT and Python worker start-up are paid
before timing; the timed run measures steady-state work at the target scale.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tablefold.plans.registry import QUERIES  # noqa: E402
from tablefold.session import local_session  # noqa: E402

HEADLINE = [
    "scoreboard",             # flagship: parse + score + group metrics + task scores
    "scored_rows",            # per-row answer extraction and scoring
    "error_detect_metrics",   # set scorer with macro P/R/F1
    "prompt_build",           # cells -> serialise -> template fill -> token count
    "budget_report",          # token budget over documents
    "compare_result_lists",   # table comparison
    "fd_part",                # D1 dependency discovery
    "key_foreign_keys",       # D4 key / foreign-key discovery
    "reshape_stack",          # reshape on cells
    "near_value_errors",      # D8 deletion-neighbourhood join
]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", "16")))
    warm_dir = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
    for name in names:
        run(QUERIES[name](spark, warm_dir))      # warm-up: codegen, JIT, Python workers
    times = {}
    for name in names:
        t0 = time.time()
        run(QUERIES[name](spark, sf_dir))
        times[name] = round(time.time() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total_wall", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
