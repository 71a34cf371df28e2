"""Text models, random search, checkpoints, transform steps and size checks."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridloom.operators import batching as B
from gridloom.operators import lookup as L
from gridloom.operators import optimizers as OP
from gridloom.operators import tensors as T
from gridloom.operators import text_models as TM
from gridloom.operators import training as TR
from gridloom.operators import transforms as ST
from gridloom.session import Tables, cut_lineage, spread


@pytest.fixture(scope="module")
def reviews(spark):
    rng = np.random.default_rng(0)
    good, bad, other = ["fine", "great", "lovely"], ["poor", "awful", "sad"], ["the", "film", "plot", "cast"]
    rows = []
    for i in range(200):
        label = i % 2
        words = list(rng.choice(other, 6)) + list(rng.choice(good if label else bad, 3))
        rng.shuffle(words)
        rows.append((i, [str(w) for w in words], float(label)))
    return spark.createDataFrame(rows, "id int, tokens array<string>, label double")


def test_text_classifier_learns(reviews):
    model = TM.fit_classifier(reviews, "tokens", "label", buckets=1024, epochs=20)
    out = TM.classify(reviews, model, ["bad", "good"], 2).toPandas()
    best = out["top"].map(lambda top: top[0]["class"])
    assert ((best == "good") == (out["label"] == 1)).mean() == 1.0
    assert np.allclose(out["top"].map(lambda top: top[0]["prob"] + top[1]["prob"]), 1.0)


def test_word_vectors(reviews):
    vectors = TM.fit_word_vectors(reviews, "tokens", size=4, min_count=1, partitions=1).getVectors()
    assert vectors.count() == 10 and len(vectors.first()["vector"]) == 4


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 2))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    return spark.createDataFrame(pd.DataFrame({"id": range(400), "x": list(x), "y": y})).repartition(4).cache()


def test_network_learns_and_search_picks_the_best(points):
    trial = TR.Trial(TR.Mlp(2, 16, 2), OP.Adam(0.1), seed=1)
    TR.fit(points, "x", "y", [trial], 40)
    assert trial.history[-1]["loss"] < 0.5 * trial.history[0]["loss"] and trial.history[-1]["accuracy"] > 0.9
    build = lambda s: TR.Trial(TR.Mlp(2, 8, 2), OP.Sgd(s["rate"]), seed=1)
    best, report = TR.search(points, points, "x", "y", {"rate": ("choice", [0.0, 0.5])}, build, 6, 5, seed=2)
    assert report.sort_values("loss").iloc[0]["rate"] == best.optimizer.rate(1) == 0.5


def test_partitions_do_not_change_training(points):
    runs = [TR.fit(points.repartition(n), "x", "y", [TR.Trial(TR.Mlp(2, 4, 2), OP.Sgd(0.1), seed=3)], 3)[0] for n in (1, 7)]
    assert all(np.allclose(runs[0].parameters[k], runs[1].parameters[k]) for k in runs[0].parameters)


def test_listeners_and_checkpoints(spark, points, tmp_path):
    seen = []
    trial = TR.Trial(TR.Linear(2, 2, "softmax"), OP.Sgd(0.1), seed=1)
    listeners = [lambda event, details: seen.append(event), TR.save_every_epoch(spark, str(tmp_path), trial)]
    TR.fit(points, "x", "y", [trial], 2, listeners=listeners, validate=points)
    assert seen == ["begin", "step", "epoch", "step", "epoch", "end"]
    stored = spark.read.parquet(str(tmp_path))
    back = TR.load_parameters(stored, 1, {"weight": (2, 2), "bias": (2,)})
    assert np.allclose(back["weight"], trial.parameters["weight"])
    assert stored.filter("loss is null or accuracy is null").count() == 0


def test_transform_steps(spark):
    df = spark.createDataFrame([(2.0, "b")], "a double, t string")
    steps = ST.Steps().add(lambda c: c + 1).add(lambda c: c * 10, "a").insert(0, lambda c: c - 2, 0)
    out = ST.prepare(df, ["a"], ["t"], steps, ST.Steps().add(F.upper, "t")).first()
    assert tuple(out) == (10.0, "B")
    with pytest.raises(ValueError):
        ST.Steps().add(F.upper, "x").apply(df, ["a"])


def test_stacking_checks_shapes(spark):
    same = spark.createDataFrame([(0, 0, [1.0, 2.0]), (0, 1, [3.0, 4.0])], "b int, p int, x array<double>")
    assert B.stack(same, "x", "b", "p").first()["stacked"] == [[1.0, 2.0], [3.0, 4.0]]
    mixed = same.union(spark.createDataFrame([(0, 2, [5.0])], same.schema))
    with pytest.raises(Exception, match="differ in shape"):
        B.stack(mixed, "x", "b", "p").collect()
    with pytest.raises(Exception, match="longer than"):
        B.pad_batches(mixed, "x", "b", F.lit(0.0), width=1).collect()
    padded = B.pad_batches(mixed, "x", "b", F.lit(0.0), width=3).orderBy("p").collect()
    assert [r["padded"] for r in padded] == [[1.0, 2.0, 0.0], [3.0, 4.0, 0.0], [5.0, 0.0, 0.0]]
    uneven = spark.range(5).select(B.split_slices(F.col("id"), F.lit(5), 2, even=True).alias("s"))
    with pytest.raises(Exception, match="evenly"):
        uneven.collect()


def test_broadcast_needs_few_rows_and_few_bytes(spark, monkeypatch):
    df = spark.createDataFrame([(i, "x" * 100, [1.0] * 10) for i in range(50)], "k int, t string, a array<double>")
    assert L.fits_broadcast(df) and not L.fits_broadcast(df, 49)
    monkeypatch.setattr(L, "BROADCAST_BYTES", 5000)
    assert not L.fits_broadcast(df) and L.fits_broadcast(df.select("k"))


def test_explode_does_not_repeat_its_input(spark):
    """The array expression appears once in the plan, whatever filters the optimizer adds."""
    df = spark.createDataFrame([(1, "a b"), (2, "")], "k int, t string").withColumn("w", F.split("t", " "))
    out = T.explode_rows(df, "w", ["k"], value="word")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1
    assert sorted(r["word"] for r in out.collect()) == ["", "a", "b"]


def test_scan_reads_only_what_is_used(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    plan = t.lineitem.filter(F.col("l_quantity") > 10).select("l_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan and "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity" in plan


def test_spread_and_cut(spark):
    few = spark.range(100).coalesce(1)
    assert spread(few, "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    many = spark.range(0, 100, 1, 50)
    assert spread(many, "id").rdd.getNumPartitions() == 50
    held = cut_lineage(many.select("id", F.struct("id").alias("s")))
    assert held.count() == 100 and "FileScan" in held._jdf.queryExecution().executedPlan().toString()


def test_gram_and_matmul(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(30, 4))
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "r int, x array<double>").repartition(3)
    g = T.gram(df, "x").toPandas().pivot(index="i", columns="j", values="v").to_numpy()
    assert np.allclose(g, x.T @ x)
    cells = T.explode_cells(df, "x", ["r"], index="c")
    w = spark.createDataFrame([(c, k, float(c + k)) for c in range(4) for k in range(2)], "c int, k int, v double")
    product = T.matmul(cells, w, "r", "c", "k").toPandas().pivot(index="r", columns="k", values="v").to_numpy()
    assert np.allclose(product, x @ np.array([[0, 1], [1, 2], [2, 3], [3, 4]]))


@pytest.mark.parametrize("rows,slices", [(0, 1), (0, 4), (2, 8)])
def test_tables_and_slices_without_rows(points, rows, slices):
    trial = TR.Trial(TR.Mlp(2, 4, 2), OP.Sgd(0.1), seed=3)
    before = {name: value.copy() for name, value in trial.parameters.items()}
    some = points.where(f"id < {rows}")
    TR.fit(some, "x", "y", [trial], 1, key="id", slices=slices, validate=points.limit(0))
    assert sum(step["rows"] for step in trial.history) == rows
    assert any(not np.array_equal(before[k], v) for k, v in trial.parameters.items()) == (rows > 0)
    assert all(np.isnan(x) for x in TR.evaluate_model(points.limit(0), "x", "y", [(trial.model, trial.parameters)])[0])
