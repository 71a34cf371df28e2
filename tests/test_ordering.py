"""Exact order, running sums and neighbours on skewed data and with tiny slots."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridloom.operators import lookup as L
from gridloom.operators import ordering as O
from gridloom.operators import series as SE


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(1)
    lead = np.where(rng.random(3000) < 0.4, 7, rng.integers(-50, 50, 3000))
    frame = pd.DataFrame({"lead": lead, "tie": rng.permutation(3000), "g": np.where(rng.random(3000) < 0.6, "hot", rng.choice(list("abc"), 3000)), "v": rng.integers(0, 100, 3000).astype(float)})
    return frame, spark.createDataFrame(frame).repartition(5).cache()


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("per_slot", [50, 10_000])
def test_global_index_and_sum(skewed, per_slot, descending):
    frame, df = skewed
    out = O.ordered_prefix(df, "lead", "tie", sums={"run": "v"}, descending=descending, rows_per_slot=per_slot).toPandas()
    expected = frame.sort_values(["lead", "tie"], ascending=[not descending, True]).reset_index(drop=True)
    got = out.sort_values("row_id").reset_index(drop=True)
    assert (got["row_id"] == np.arange(len(frame))).all()
    assert (got[["lead", "tie"]] == expected[["lead", "tie"]]).all().all()
    assert np.allclose(got["run"], expected["v"].cumsum())


@pytest.mark.parametrize("per_slot", [50, 10_000])
def test_index_within_a_hot_group(skewed, per_slot):
    frame, df = skewed
    out = O.ordered_prefix(df, "lead", "tie", within=["g"], index="i", rows_per_slot=per_slot).toPandas()
    expected = frame.sort_values(["lead", "tie"])
    expected["i"] = expected.groupby("g").cumcount()
    merged = out.merge(expected, on="tie", suffixes=("", "_x"))
    assert (merged["i"] == merged["i_x"]).all()


def test_slots_bound_every_window(skewed):
    """A value held by 40 % of the rows is split by the tie-breaker."""
    _, df = skewed
    plan = O.ordered_prefix(df, "lead", "tie", rows_per_slot=50)
    window = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "_slot" in window and "_sub" in window
    assert plan.count() == 3000


def test_string_lead_and_negative_zero(spark):
    words = ["b", "a", "aa", "", "é", "z", "ab", "abcdefgh", "abcdefgi"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    out = O.ordered_prefix(df, "w", index="i", rows_per_slot=2).orderBy("i").toPandas()
    assert out["w"].tolist() == sorted(words, key=lambda s: s.encode())


def test_result_does_not_depend_on_partitions(skewed):
    _, df = skewed
    one = O.random_split(df.coalesce(1), [5, 4, 1], 9, "tie").toPandas().set_index("tie")["split"].sort_index()
    seven = O.random_split(df.repartition(7), [5, 4, 1], 9, "tie").toPandas().set_index("tie")["split"].sort_index()
    assert (one == seven).all()


def test_split_of_a_hundred(spark):
    df = spark.range(100)
    sizes = O.random_split(df, [5, 4, 1], 1, "id").groupBy("split").count().toPandas().set_index("split")["count"]
    assert sizes.to_dict() == {0: 50, 1: 40, 2: 10}
    part = O.sub_range(df, 10, 25, "id").toPandas()["id"]
    assert len(part) == 15 and part.min() == 10


def test_batches_drop_last(spark):
    full = O.batches(spark.range(10), 4, "id").groupBy("batch_id").count().toPandas()
    assert sorted(full["count"]) == [2, 4, 4]
    assert O.batches(spark.range(10), 4, "id", drop_last=True).count() == 8


@pytest.mark.parametrize("chunk", [3, 10, 1000])
def test_neighbours_across_chunks(skewed, chunk):
    frame, df = skewed
    placed = O.ordered_prefix(df, "lead", "tie", within=["g"], index="i")
    out = O.chunked_neighbours(
        placed, "i", 2, 1, {"back": lambda w: F.lag("v", 2).over(w), "ahead": lambda w: F.lead("v", 1).over(w)}, ["g"], chunk=chunk
    ).toPandas()
    expected = frame.sort_values(["lead", "tie"])
    expected["back"] = expected.groupby("g")["v"].shift(2)
    expected["ahead"] = expected.groupby("g")["v"].shift(-1)
    merged = out.merge(expected, on="tie", suffixes=("", "_x"))
    assert len(out) == len(frame)
    for name in ("back", "ahead"):
        assert np.allclose(merged[name], merged[f"{name}_x"], equal_nan=True)


@pytest.mark.parametrize("max_rows", [0, 1000])
@pytest.mark.parametrize("how", ["left", "inner", "left_anti", "left_semi"])
def test_checked_lookup_both_ways(skewed, spark, max_rows, how):
    frame, df = skewed
    names = spark.createDataFrame([("hot", 1), ("a", 2)], "g string, n int")
    out = L.checked_lookup(df, names, ["g"], ["tie"], how=how, max_rows=max_rows).toPandas()
    known = frame["g"].isin(["hot", "a"])
    assert len(out) == {"left": len(frame), "inner": known.sum(), "left_anti": (~known).sum(), "left_semi": known.sum()}[how]
    if how == "left":
        assert out["n"].notna().sum() == known.sum()


def test_convolution_against_numpy(spark):
    rng = np.random.default_rng(3)
    frame = pd.DataFrame({"s": np.repeat([1, 2], [300, 17]), "t": np.arange(317), "v": rng.random(317)})
    df = spark.createDataFrame(frame)
    kernel, stride, padding, dilation = [0.5, -1.0, 2.0], 2, 1, 2
    out = SE.convolve(df.withColumn("tie", F.col("t")), "v", ["s"], "t", "tie", kernel, stride, padding, dilation).toPandas()
    for s, part in frame.groupby("s"):
        x = np.pad(part["v"].to_numpy(), padding)
        span = dilation * 2 + 1
        expected = [sum(kernel[k] * x[o + k * dilation] for k in range(3)) for o in range(0, len(x) - span + 1, stride)]
        assert np.allclose(out[out["s"] == s].sort_values("t")["v"], expected)


def test_sessions_at_the_gap(spark):
    times = [0, 50, 100, 161, 221, 300]
    df = spark.createDataFrame([(1, t) for t in times], "k int, s long").withColumn("ts", F.timestamp_seconds("s"))
    out = SE.sessions(df, "k", "ts", 60).orderBy("start").toPandas()
    assert out["rows"].tolist() == [3, 2, 1]
    same = df.groupBy("k", F.session_window("ts", "60 seconds")).count().toPandas()
    assert sorted(same["count"]) == sorted(out["rows"])
