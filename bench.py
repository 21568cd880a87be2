"""Times headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

HEADLINE = (
    "label_balance_report transform_rows normalize_rows classifier_lines equal_count_bins balance sample_by_rate reshard "
    "annotation_agreement keyed_diff value_statistics weighted_percentiles classification_report auc_with_ties rank_correlations "
    "reliability_bins minhash_deduplicate render_conversations annotate_documents"
).split()


def main() -> None:
    from pyspark.sql import SparkSession

    from lodestone.plans import registry

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    runs, took = int(os.environ.get("BENCH_RUNS", "3")), {}
    for name in [n for n in HEADLINE if n in registry.QUERIES]:
        each = []
        for _ in range(runs + 1):  # the first warms up
            t = time.perf_counter()
            registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            each.append(time.perf_counter() - t)
        took[name] = round(statistics.median(each[1:]), 3)
    sf = re.search(r"sf([\d.]+)", sf_dir)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(sf[1]) if sf else None}))
    spark.stop()


if __name__ == "__main__":
    main()
