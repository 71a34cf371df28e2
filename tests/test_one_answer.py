"""Operators with a way for small and one for large inputs give the same rows on both."""

import math

import pytest
from pyspark.sql import functions as F

from gridloom.operators import detection
from gridloom.operators.detection import suppress
from gridloom.operators.ordering import ordered_prefix
from gridloom.operators.regions import regions
from gridloom.operators.vocabulary import decode, encode, word_pieces

LISTS = [
    (1, ["a", "b", "zz"]), (2, []), (3, None), (4, [None, "a"]), (None, ["b", "", "a"]), (6, ["\U0001f600" * 120, "ab"]), (7, ["a"] * 5), (8, ["" ]),
]


@pytest.fixture
def lists(spark):
    return spark.createDataFrame(LISTS, "id long, tokens array<string>")


@pytest.fixture
def vocabulary(spark):
    rows = [("[UNK]", 0), ("a", 1), ("b", 2), ("##b", 3), ("ab", 4), ("\U0001f600", 5), ("##\U0001f600", 6)]
    return spark.createDataFrame(rows, "token string, id long")


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_encode(lists, vocabulary):
    small = rows_of(encode(lists, "tokens", vocabulary, "id", unknown="[UNK]"), "id", "ids")
    large = rows_of(encode(lists, "tokens", vocabulary, "id", unknown="[UNK]", max_rows=2), "id", "ids")
    assert small == large
    assert dict(small) == {1: [1, 2, 0], 2: [], 3: None, 4: [0, 1], None: [2, 0, 1], 6: [0, 4], 7: [1] * 5, 8: [0]}


def test_word_pieces(lists, vocabulary):
    small = rows_of(word_pieces(lists, "tokens", vocabulary, "id"), "id", "pieces")
    large = rows_of(word_pieces(lists, "tokens", vocabulary, "id", max_rows=2), "id", "pieces")
    assert small == large
    got = dict(small)
    assert got[1] == ["a", "b", "[UNK]"] and got[2] == [] and got[3] is None and got[4] == ["[UNK]", "a"]
    assert got[None] == ["b", "a"] and got[6] == ["[UNK]", "ab"] and got[8] == []


@pytest.mark.parametrize("threshold", [0.3, 0.5, 1.0])
@pytest.mark.parametrize("kind", ["long", "string"])
def test_suppress(spark, threshold, kind):
    boxes = [(1, i, float(i % 7), float(i % 3), float(i % 5) / 2, 4.0 + i % 2, 4.0) for i in range(40)]
    boxes += [(1, 100, 0.9, None, 1.0, 2.0, 2.0), (1, 101, 0.9, math.nan, 1.0, 2.0, 2.0), (1, 102, 0.1, math.inf, 1.0, 2.0, 2.0)]
    boxes += [(1, 103, None, 1.0, 1.0, 4.0, 4.0), (1, 104, math.nan, 1.0, 1.0, 4.0, 4.0), (1, 105, 0.5, 1.0, 1.0, 0.0, 4.0), (None, 106, 0.5, 1.0, 1.0, 1.0, 4.0)]
    df = spark.createDataFrame(boxes, "g long, id long, score double, x double, y double, w double, h double")
    df = df.withColumn("id", F.col("id").cast(kind))
    small = rows_of(suppress(df, ["g"], "id", "score", threshold), "g", "id")
    large = rows_of(suppress(df, ["g"], "id", "score", threshold, max_group=3), "g", "id")
    assert small == large
    assert {(1, "100"), (1, "101"), (1, "102")} <= {(g, str(i)) for g, i in small}


def test_a_large_null_group_is_not_solved_in_one_task(spark, monkeypatch):
    boxes = [(g, i, float(i % 7), float(3 * i), 0.0, 4.0, 4.0) for g in (None, 2) for i in range(12)]
    df = spark.createDataFrame(boxes, "g long, id long, score double, x double, y double, w double, h double")
    small, sizes, local = rows_of(suppress(df, ["g"], "id", "score", 0.1), "g", "id"), [], detection._suppress_local

    def counted(part, group, *rest):
        sizes.extend(r["count"] for r in part.groupBy(*group).count().collect())
        return local(part, group, *rest)

    monkeypatch.setattr(detection, "_suppress_local", counted)
    assert rows_of(suppress(df, ["g"], "id", "score", 0.1, max_group=3), "g", "id") == small
    assert max(sizes, default=0) <= 3 and {g for g, _ in small} == {None, 2}


def test_suppress_threshold_is_checked_first(spark):
    df = spark.createDataFrame([], "g long, id long, score double, x double, y double, w double, h double")
    for threshold in (0.0, 1.5):
        with pytest.raises(ValueError):
            suppress(df, ["g"], "id", "score", threshold)


VALUES = {
    "double": [math.inf, -math.inf, math.nan, None, 0.0, 3.5, -2.0, *map(float, range(20)), math.nan, 3.5, 3.5, 3.5, 3.5, 3.5, 3.5],
    "all null double": [None] * 30,
    "long": [None, 5, 5, 5, 5, 5, 5, 5, 5, 5, 5, 5, 5, *range(15)],
    "string": [None, *(f"https://example.org/path-{i % 17:05d}" for i in range(40)), "https://example.org/"],
    "shared string": ["prefix-0001"] * 20 + ["prefix-0002"] * 20,
}


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("wide", [False, True])
@pytest.mark.parametrize("name", list(VALUES))
def test_order(spark, name, descending, wide):
    df = spark.createDataFrame(list(enumerate(VALUES[name])), f"id long, v {name.split()[-1]}")
    whole = rows_of(ordered_prefix(df, "v", "id", descending=descending), "id", "row_id")
    cut = rows_of(ordered_prefix(df, "v", "id", descending=descending, rows_per_slot=5, wide=wide), "id", "row_id")
    assert [r for _, r in sorted(whole)] == [r for _, r in sorted(cut)]
    assert sorted(r for _, r in cut) == list(range(len(VALUES[name])))


def test_equal_heads_do_not_share_a_slot(spark):
    """Keys with a long common beginning, and keys that differ late only, are spread over slots."""
    from gridloom.operators.ordering import BYTES, _bytes_number, _directed, _place, _shared_bytes, order_number

    df = spark.range(400).select(F.format_string("prefix-of-the-key-%06d", "id").alias("v"))
    skip = _shared_bytes(df, "v")
    numbered = df.withColumn("_lead", _directed(order_number(F.col("v"), df.schema["v"].dataType, skip), False))
    numbered = numbered.withColumn("_next", _bytes_number(F.col("v"), skip + BYTES))
    sizes = [r["count"] for r in _place(numbered, 40, True).groupBy("_slot", "_sub").count().collect()]
    assert max(sizes) <= 40


def test_scratch_tables_can_be_dropped(spark):
    import os

    from gridloom.session import cut_lineage, scratch_paths, scratch_scope

    before = scratch_paths(spark)
    with scratch_scope(spark):
        cut_lineage(spark.range(5)).count()
        made = scratch_paths(spark)[len(before):]
        assert made and all(os.path.exists(p) for p in made)
    assert scratch_paths(spark) == before and not any(os.path.exists(p) for p in made)


def test_percentiles_skip_nulls_and_keep_null_groups(spark):
    from gridloom.operators.evaluation import floor_rank_percentiles, percentiles

    rows = [("a", i, float(i)) for i in range(3)] + [("a", 10 + i, None) for i in range(7)] + [(None, 1, 5.0), ("b", 1, None)]
    rows += [("hot", i, float(i % 7)) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, id long, v double")
    got = {r["g"]: r["p50"] for r in percentiles(df, ["g"], "v", "id", {"p50": 0.5}).collect()}
    assert got == {"a": 1.0, None: 5.0, "b": None, "hot": 3.0}
    ranks = {r["g"]: (r["p50"], r["p100"]) for r in floor_rank_percentiles(df, "g", "v", "id", [50, 100]).collect()}
    assert ranks["a"] == (1.0, 2.0) and ranks[None] == (5.0, 5.0) and ranks["b"] == (None, None)


def test_length_buckets(spark):
    from gridloom.operators.batching import bucket_batches, length_bucket

    df = spark.range(50).selectExpr("id", "cast(id % 9 as int) AS n")
    assert length_bucket(df.limit(0), "n", 3).count() == 0
    plain = bucket_batches(df, "n", 3, 4, "id").collect()
    mixed = bucket_batches(df, "n", 3, 4, "id", seed=1).collect()
    assert sorted((r["bucket_key"], r["batch_no"], r["pos"]) for r in plain) == sorted((r["bucket_key"], r["batch_no"], r["pos"]) for r in mixed)
    places = {(r["bucket_key"], r["batch_no"]): r["position"] for r in mixed}
    assert sorted(places.values()) == list(range(len(places))) and list(places.values()) != sorted(places.values())


def test_idx_files_are_paired_by_name(spark, tmp_path):
    from gridloom.sources.images import read_idx

    for k in range(2):
        for kind, body in (("images", bytes(16) + bytes([k, k, 9, 9])), ("labels", bytes(8) + bytes([k, 7]))):
            (tmp_path / kind).mkdir(exist_ok=True)
            (tmp_path / kind / f"part-{k}").write_bytes(body)
    rows = sorted((r["file"], r["index"], r["label"], r["pixels"]) for r in read_idx(spark, str(tmp_path / "images"), str(tmp_path / "labels"), 2).collect())
    assert rows == [(0, 0, 0, [0, 0]), (0, 1, 7, [9, 9]), (1, 0, 1, [1, 1]), (1, 1, 7, [9, 9])]


@pytest.mark.parametrize("limit", [0, None])
def test_decode_keeps_every_row(spark, limit):
    rows = [(1, [7, 8, 9]), (2, []), (3, None), (None, [8, 99])]
    words = spark.createDataFrame([(7, "a"), (8, "b"), (9, "<eos>")], "id long, token string")
    got = decode(spark.createDataFrame(rows, "k int, ids array<long>"), "ids", words, "k", stop="<eos>", unknown="?", max_rows=limit)
    assert {r["k"]: r["tokens"] for r in got.collect()} == {1: ["a", "b"], 2: [], 3: None, None: ["b", "?"]}


@pytest.mark.parametrize("most", [0, 1_000])
def test_cells_of_a_null_map_are_one_map(spark, most):
    cells = [(m, 0, j) for m in (None, 7) for j in range(6)]
    got = regions(spark.createDataFrame(cells, "m int, i int, j int"), "m", 3, most)
    assert got.columns == ["m", "i", "j", "region"]
    assert sorted((str(r["m"]), r["j"], r["region"]) for r in got.collect()) == sorted((str(m), j, 0) for m, _, j in cells)
