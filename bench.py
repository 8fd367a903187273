"""Benchmark the headline queries.

Runs each query in ``HEADLINE`` on ``$BENCH_SF_DIR`` (default
/root/testdata/sf0.1) with ``local[$BENCH_CPUS]``: one warm-up, then the
median of ``$BENCH_RUNS`` (default 3) runs into the ``noop`` sink. Prints one
JSON line; ``value`` is the sum of the medians.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from labeltext.session import local_session  # noqa: E402
from labeltext.plans.queries import REGISTRY  # noqa: E402

HEADLINE = [
    "clean_text",
    "clean_postings",
    "cleaning_report",
    "drop_funnel",
    "labeled_dataset",
    "split_dataset",
    "fold_labels_at_size",
    "attach_labels",
    "length_stats",
    "load_eval_set",
    "encode_examples",
    "compare_models",
    "classification_report",
    "batch_predict",
    "pipeline_summary",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    wanted = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, shuffle_partitions=max(8, 2 * int(cpus) if cpus.isdigit() else 16))
    times = {}
    for name in wanted:
        fn = REGISTRY[name]

        def once() -> float:
            t0 = time.perf_counter()
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            return time.perf_counter() - t0

        once()  # warm-up: JIT, Python workers, file listing
        times[name] = round(statistics.median(once() for _ in range(runs)), 3)
    sf = Path(sf_dir).name.removeprefix("sf")
    print(json.dumps({"metric": "sum_of_median_query_seconds", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf, "cpus": cpus, "runs": runs}))
    spark.stop()


if __name__ == "__main__":
    main()
