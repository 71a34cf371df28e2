"""Wall time of the headline queries: prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from gridloom.plans import all_queries
from gridloom.session import build_session, scratch_scope

HEADLINE = [
    "document_features", "one_hot_returnflag", "feature_vectors", "min_max_scaled", "z_scores", "vocabulary", "encode_tokens",
    "word_piece_tokens", "length_buckets", "padded_batches", "masked_instances", "softmax_rows", "matrix_product", "gram_matrix",
    "median_percentile", "sort_axis_global", "cumulative_sum", "evaluator_levels", "loss_of_batches", "metric_percentiles", "series_convolution",
    "recent_buffer", "user_sessions", "suppress_boxes", "match_anchors", "detection_losses", "multi_scale_detector", "map_regions",
    "image_resize", "batch_scores", "tabular_classes", "tree_scores", "train_linear", "train_flag_network", "train_classifiers", "random_split_rows",
    "sequential_batches", "stream_window_metrics", "csv_gzip",
]


def main(names: list[str]) -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "2"))
    known = all_queries()
    spark = build_session(cores, shuffle_partitions=int(cores) if cores.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    # One unmeasured query starts the JVM's code paths and the Python workers.
    known["batch_scores"].run(spark, folder).write.format("noop").mode("overwrite").save()
    for name in names or HEADLINE:
        spent = []
        for _ in range(repeats):
            with scratch_scope(spark):
                start = time.perf_counter()
                known[name].run(spark, folder).write.format("noop").mode("overwrite").save()
                spent.append(time.perf_counter() - start)
            spark.catalog.clearCache()
        times[name] = round(min(spent), 3)
        print(name, times[name], file=sys.stderr, flush=True)
    rows = {name: spark.read.parquet(f"{folder}/{name}.parquet").count() for name in ("lineitem", "documents", "embeddings")}
    spark.stop()
    # Rows (times passes) per second of queries that go over whole tables.
    passes = {"train_flag_network": ("lineitem", 3), "train_linear": ("lineitem", 2), "tree_scores": ("lineitem", 1),
              "tabular_classes": ("lineitem", 1), "min_max_scaled": ("lineitem", 1), "document_features": ("documents", 1),
              "word_piece_tokens": ("documents", 1), "batch_scores": ("embeddings", 1)}
    speed = {n: round(rows[table] * k / times[n]) for n, (table, k) in passes.items() if n in times}
    print(json.dumps({
        "metric": "total wall time of the headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "median": round(statistics.median(times.values()), 3), "rows_per_sec": speed, "sf": os.path.basename(folder).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main(sys.argv[1:])
