"""Steps that once grew faster than their input: lookups in place, salts for frequent keys only, added vectors, records by range."""

import math

import pytest
from pyspark.sql import functions as F

from gridloom.functions import text as X
from gridloom.operators import lookup as L
from gridloom.operators import vocabulary as V
from gridloom.plans import all_queries


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_colour_records_are_never_broadcast(spark, tmp_path):
    rows = [(i, i % 10, [0.01 * (i % 90)] * 64) for i in range(40)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    found = all_queries()["colour_record_files"].run(spark, str(tmp_path))
    assert found.count() == 40
    text = plan(found)
    for part in text.split("BroadcastExchange")[1:]:
        nested = part.split("\n")
        depth = len(text.split("BroadcastExchange")[0].split("\n")[-1])
        below = [line for line in nested[1:]]
        until = next((i for i, line in enumerate(below) if len(line) - len(line.lstrip(" :+-")) < depth), len(below))
        assert not any("MapInArrow" in line for line in below[:until])


def test_only_frequent_keys_are_salted(spark, monkeypatch):
    monkeypatch.setattr(L, "HOT_ROWS", 100)
    left = spark.range(2_000).select(F.when(F.col("id") < 1_000, 7).otherwise(F.col("id")).cast("long").alias("k"), F.col("id").alias("r"))
    left = left.unionByName(spark.range(500).select(F.lit(None).cast("long").alias("k"), (F.col("id") + 5_000).alias("r")))
    right = spark.range(1_500).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for how in ("left", "inner", "left_semi", "left_anti"):
        far = L.checked_lookup(left, right, ["k"], ["r"], how=how, max_rows=0)
        near = left.join(right, ["k"], how)
        assert sorted(map(tuple, far.collect()), key=str) == sorted(map(tuple, near.collect()), key=str)
    found = L._hot_buckets(left, F.pmod(F.xxhash64("k"), F.lit(L.BUCKETS)))
    assert len(found) == 2
    assert L._hot_buckets(right, F.pmod(F.xxhash64("k"), F.lit(L.BUCKETS))) == []
    monkeypatch.setattr(L, "HOT_ROWS", 10_000)
    assert "_salt" not in plan(L.checked_lookup(left, right, ["k"], ["r"], max_rows=0))


def test_decoding_moves_no_tokens(spark):
    vocabulary = spark.createDataFrame([("a", 0), ("b", 1), ("end", 2)], "token string, id long")
    rows = [(1, [0, 1, 9, None, 2, 0]), (2, None), (3, []), (None, [1]), (4, [None]), (5, [2])]
    df = spark.createDataFrame(rows, "k long, ids array<long>")
    found = V.decode(df, "ids", vocabulary, "k", stop="end")
    assert "Exchange" not in plan(found)
    expected = {1: ["a", "b", "<unk>"], 2: None, 3: [], None: ["b"], 4: [], 5: []}
    assert {r["k"]: r["tokens"] for r in found.collect()} == expected
    joined = V.decode(df, "ids", vocabulary, "k", stop="end", max_rows=0)
    assert {r["k"]: r["tokens"] for r in joined.collect()} == expected


def test_rows_of_a_repeated_key_are_decoded_as_by_the_join(spark):
    vocabulary = spark.createDataFrame([("a", 0), ("b", 1)], "token string, id long")
    df = spark.createDataFrame([(1, [0, 0]), (1, [1, 1]), (2, [1])], "k long, ids array<long>")
    near, far = (V.decode(df, "ids", vocabulary, "k", max_rows=n) for n in (None, 0))
    assert sorted((r["k"], r["tokens"]) for r in near.collect()) == sorted((r["k"], r["tokens"]) for r in far.collect())


@pytest.mark.parametrize("size", [2, 500_000])
def test_lookups_in_slices(spark, monkeypatch, size):
    import pyarrow as pa

    monkeypatch.setattr(V, "SLICE_TOKENS", size)
    flat = pa.array(["a", "x", None, "b", "a"])
    assert V._places(flat, pa.array(["a", "b"]), 2).tolist() == [0, 2, 2, 1, 0]
    assert V._places(pa.array([5, None, 6, 7]), pa.array([7, 5]), 2).tolist() == [1, 2, 2, 0]
    assert V._places(pa.array([], pa.string()), pa.array(["a"]), 1).tolist() == []


def test_normal_forms_in_slices(spark):
    texts = ["a" * 700_000, "é" * 300_000, None, "", "plain", "Å"] * 2
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1)
    import unicodedata

    found = {r["i"]: r["n"] for r in df.select("i", X.unicode_normal(F.col("t"), "NFC").alias("n")).collect()}
    assert found == {i: t if t is None else unicodedata.normalize("NFC", t) for i, t in enumerate(texts)}


def vectors_and_rows(spark):
    vectors = spark.createDataFrame(
        [("<unk>", [9.0, 9.0]), ("a", [1.0, 2.0]), ("b", [3.0]), ("c", [None, 5.0]), ("a", [10.0, 20.0]), ("d", None)],
        "token string, vector array<double>",
    )
    rows = [(1, ["a", "b", "a"]), (2, ["c"]), (3, []), (None, ["zz", None]), (4, None), (5, ["d", "c", "b"]), (1, ["b"])]
    return vectors, spark.createDataFrame(rows, "k long, t array<string>")


def test_rare_tokens_alone_are_shuffled_to_their_vectors(spark, monkeypatch):
    vectors, df = vectors_and_rows(spark)
    whole = V.embed(df, "t", vectors, "k")
    split = V.embed(df, "t", vectors, "k", max_rows=2)
    assert sorted(map(str, whole.collect())) == sorted(map(str, split.collect()))


@pytest.mark.parametrize("size", [1, 100_000])
def test_added_vectors_have_the_mean_of_all_rows(spark, monkeypatch, size):
    monkeypatch.setattr(V, "SLICE_TOKENS", size)
    monkeypatch.setattr(V, "PAIRS_AT_ONCE", size)
    monkeypatch.setattr(V, "VECTOR_BLOCK", size)
    vectors, df = vectors_and_rows(spark)
    plain = V.mean_embedding(V.embed(df, "t", vectors, "k"), "k")
    added = V.mean_embedding(V.embed(df, "t", vectors, "k", added=True), "k")
    first, second = ({(r["k"], r["dim"]): r["value"] for r in x.collect()} for x in (plain, added))
    assert first.keys() == second.keys()
    for at, value in first.items():
        assert value == second[at] if value is None else math.isclose(value, second[at])
