"""Times the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

from labelcorr.plans.catalog import QUERIES
from labelcorr.session import scratch

HEADLINES = [
    "conditional_distribution",
    "dense_matrix",
    "label_association",
    "normalize_text",
    "encode_strict",
    "class_weights",
    "weighted_cross_entropy",
    "evaluate",
    "hash_split",
    "split_rest",
    "test_rest",
    "stratified_kfold",
    "fold_files",
    "holdout_group",
    "row_ids",
    "row_ids_with_ties",
    "build_vocabulary",
    "encode_tokens",
    "encode_tokens_joined",
    "batch_tokenize",
    "csv_posts",
    "csv_mixed_headers",
    "train_predict_matrix",
    "transfer_matrix",
    "select_best",
    "stream_matrix",
    "stream_metrics",
]


def run(spark: SparkSession, name: str, sf_dir: str) -> float:
    started = time.perf_counter()
    with scratch(spark):
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("labelcorr-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="labelcorr-bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in sys.argv[1:] or HEADLINES:
        run(spark, name, sf_dir)  # warm-up: class loading and compilation
        seconds[name] = round(run(spark, name, sf_dir), 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
