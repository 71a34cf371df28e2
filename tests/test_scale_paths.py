"""The ways taken by large inputs, forced on small ones by tiny limits, against the same SQL."""

import pytest
from pyspark.sql import functions as F

from gridloom.operators import detection, lookup, ordering, regions
from gridloom.plans import all_queries, files
from tests.oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"
NAMES = [
    "document_features", "encode_tokens", "word_piece_tokens", "median_percentile", "decode_until_end", "embedded_tokens", "feature_vectors", "first_seen_index", "matrix_product",
    "broadcast_arithmetic", "sort_axis_global", "cumulative_sum", "series_convolution", "metric_percentiles", "length_buckets",
    "padded_batches", "random_split_sizes", "swapped_sentences", "detection_decode", "map_regions", "coco_annotations", "min_max_scaled",
]


@pytest.fixture
def tiny_limits(monkeypatch, spark):
    monkeypatch.setattr(lookup, "BROADCAST_ROWS", 5)
    monkeypatch.setattr(ordering, "ROWS_PER_SLOT", 40)
    monkeypatch.setattr(detection, "MAX_GROUP", 30)
    monkeypatch.setattr(regions, "MAX_EDGES", 0)
    for key in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
        spark.conf.set(key, "-1")
    yield
    for key in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
        spark.conf.unset(key)


@pytest.mark.parametrize("name", NAMES)
def test_query_with_tiny_limits(spark, tiny_limits, name):
    query = all_queries()[name]
    problem = compare(query.run(spark, FOLDER).toPandas(), connect(FOLDER).execute(query.sql).df())
    assert problem is None, problem


@pytest.mark.parametrize("name, most", [("idx_files", 50 * 64 + 16), ("colour_record_files", 50 * 3073)])
def test_packed_files_stay_small(spark, monkeypatch, name, most):
    """The number of files follows the rows; the rows that are read back are those of one file per remainder."""
    sizes = []

    def write(df, folder, name, content):
        sizes.extend(r[0] for r in df.select(F.octet_length(content)).collect())
        return write_files(df, folder, name, content)

    write_files = files.K.write_files
    monkeypatch.setattr(files.K, "write_files", write)
    monkeypatch.setattr(files, "PER_FILE", 50, raising=False)
    query, folder = all_queries()[name], FOLDER
    assert compare(query.run(spark, folder).toPandas(), connect(folder).execute(query.sql).df()) is None
    assert max(sizes) <= most and len(sizes) > 8
