"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR  folder with the parquet tables (default /root/testdata/sf0.1)
BENCH_CPUS    local threads (default 8)
BENCH_RUNS    timed runs per query, the median counts (default 3)
BENCH_ALL     set to 1 to time every registered query
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tuneframe.plans import catalog  # noqa: E402
from tuneframe.session import build_session  # noqa: E402

HEADLINE = """
build_distil_cls build_sft_tool read_tooluse fewshot_subset validate_indices one_per_name seeded_shuffle
repeat_sampler microbatch_slices dedup_expand drop_duplicate_prompts padded_batches completion_lengths
score_cls eval_cls score_tool eval_tool leak_report leak_cross forward_kl generalized_jsd high_entropy_mask
sequence_loss importance_stats blend_vectors metric_rollup best_checkpoint method_comparison read_run_log
""".split()


def seconds(spark, name: str, folder: str) -> float:
    start = time.perf_counter()
    catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = list(catalog.QUERIES) if os.environ.get("BENCH_ALL") == "1" else HEADLINE
    spark = build_session(
        f"local[{cpus}]",
        "tuneframe-bench",
        **{
            "spark.sql.shuffle.partitions": str(cpus),
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    # Start the session, its Python workers and the file cache before the first timed query.
    for name in ("eval_cls", "score_tool"):
        seconds(spark, name, folder)
    timings = {}
    for name in names:
        seconds(spark, name, folder)
        timings[name] = round(statistics.median(seconds(spark, name, folder) for _ in range(runs)), 4)
    print(
        json.dumps(
            {
                "metric": "headline query time, sum of medians",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
