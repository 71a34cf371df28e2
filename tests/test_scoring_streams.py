"""Scorers, trees and streams: a stream gives what the batch gives."""

import itertools
import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridloom.operators import scoring as SC
from gridloom.operators import series as SE
from gridloom.operators import trees as TX
from gridloom.plans.models import ENSEMBLE
from gridloom.streaming import operators as S
from gridloom.streaming import runs as R


class Half(SC.Scorer):
    schema = "half double"

    def setup(self):
        self.ready = True

    def check(self, rows):
        return rows["v"].map(lambda v: "negative" if v < 0 else None)

    def score(self, batch):
        assert self.ready
        if (batch["v"] == 13).any():
            raise RuntimeError("unlucky")
        return batch["v"] / 2

    def post(self, output, rows):
        return pd.DataFrame({"half": output.to_numpy()})


@pytest.mark.parametrize("batch_size", [None, 1, 3])
def test_guarded_scoring(spark, batch_size):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate([4, -1, 13, 6, 8])], "k long, v double").coalesce(1)
    rows = SC.score(df, Half(), ["k"], batch_size=batch_size, guard=True).orderBy("k").toPandas()
    assert rows["status"].tolist() == ["ok", "bad request", "engine error", "ok", "ok"]
    assert rows["half"].fillna(-1).tolist() == [2.0, -1, -1, 3.0, 4.0]
    assert rows["error"][2] == "RuntimeError: unlucky"


def test_unguarded_failure_and_timing(spark):
    df = spark.createDataFrame([(1, 13.0)], "k long, v double")
    with pytest.raises(Exception, match="unlucky"):
        SC.score(df, Half(), ["k"]).collect()
    timed = SC.score(spark.createDataFrame([(1, 2.0)], "k long, v double"), Half(), ["k"], timing=True).first()
    assert timed["half"] == 1.0 and timed["total_nanos"] >= timed["score_nanos"] > 0


def test_trees(spark):
    nodes = TX.node_table(ENSEMBLE)
    df = spark.createDataFrame([(1, [10.0, 20000.0, 0.01]), (2, [float("nan"), float("nan"), float("nan")])], "k int, x array<double>")
    x = F.col("x")
    out = df.select(
        "k", TX.predict_trees(spark, x, nodes, "margin").alias("m"), TX.predict_trees(spark, x, nodes, "leaf").alias("l"),
        TX.predict_trees(spark, x, nodes, "default", objective="reg:squarederror").alias("d"),
    ).orderBy("k").collect()
    assert out[0]["m"] == 0.5 + 0.75 - 1.0 == out[0]["d"] and list(out[0]["l"]) == [3, 1, 1]
    assert list(out[1]["l"]) == [3, 5, 1]
    sparse = df.select(TX.dense_from_sparse(F.array(F.lit(2)), F.array(F.lit(5.0)), 3).alias("x")).first()["x"]
    assert np.isnan(sparse[0]) and sparse[2] == 5.0


def test_tree_contributions_against_shapley(spark):
    """Brute force over feature subsets; absent features follow both branches by cover."""
    dump = json.loads(ENSEMBLE)
    deep = {"nodeid": 0, "split": "f0", "split_condition": 1.0, "yes": 1, "no": 2, "missing": 2, "cover": 10.0, "children": [
        {"nodeid": 1, "split": "f1", "split_condition": 0.0, "yes": 3, "no": 4, "missing": 3, "cover": 6.0, "children": [
            {"nodeid": 3, "split": "f0", "split_condition": 0.5, "yes": 5, "no": 6, "missing": 6, "cover": 2.0, "children": [
                {"nodeid": 5, "leaf": 3.0, "cover": 0.5}, {"nodeid": 6, "leaf": -2.0, "cover": 1.5}]},
            {"nodeid": 4, "leaf": 1.0, "cover": 4.0}]},
        {"nodeid": 2, "split": "f2", "split_condition": 2.0, "yes": 7, "no": 8, "missing": 8, "cover": 4.0, "children": [
            {"nodeid": 7, "leaf": 0.25, "cover": 1.0}, {"nodeid": 8, "leaf": -1.0, "cover": 3.0}]}]}
    trees = [deep, dump[1]]
    rows = [[0.2, -1.0, 3.0], [0.7, 1.0, 0.0], [30.0, float("nan"), float("nan")], [float("nan"), 0.5, 0.01]]

    def expected(node, x, known):
        if "leaf" in node:
            return node["leaf"]
        yes, no = node["children"]
        f = int(node["split"][1:])
        if f not in known:
            return (yes["cover"] * expected(yes, x, known) + no["cover"] * expected(no, x, known)) / node["cover"]
        side = node["missing"] if np.isnan(x[f]) else node["yes"] if x[f] < node["split_condition"] else node["no"]
        return expected(yes if side == yes["nodeid"] else no, x, known)

    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "k int, x array<double>")
    got = df.select("k", TX.predict_trees(spark, F.col("x"), TX.node_table(json.dumps(trees)), "contribution").alias("c")).orderBy("k").collect()
    for x, result in zip(rows, got, strict=True):
        total = lambda known, x=x: sum(expected(t, x, known) for t in trees)
        shares = []
        for f in range(3):
            others = [g for g in range(3) if g != f]
            subsets = [set(s) for n in range(3) for s in itertools.combinations(others, n)]
            shares.append(sum(math.factorial(len(s)) * math.factorial(2 - len(s)) / 6 * (total(s | {f}) - total(s)) for s in subsets))
        assert np.allclose(result["c"], [*shares, total(set())])
        assert np.isclose(sum(result["c"]), total({0, 1, 2}))


@pytest.fixture(scope="module")
def arrivals(spark, tmp_path_factory):
    rng = np.random.default_rng(4)
    frame = pd.DataFrame({"id": range(600), "user": rng.integers(0, 5, 600), "v": rng.random(600), "s": np.sort(rng.integers(0, 20000, 600))})
    frame.loc[frame.index % 3 == 0, "user"] = 99
    df = spark.createDataFrame(frame).withColumn("ts", F.timestamp_seconds("s"))
    path = str(tmp_path_factory.mktemp("arrivals") / "t")
    # Files arrive in time order, one after the other, so that no row is late.
    for part in range(4):
        df.filter(F.floor(F.col("s") / 5000) == part).coalesce(1).write.mode("append").parquet(path)
    return df, path


def test_stream_equals_batch_scores(spark, arrivals):
    df, path = arrivals
    scored = R.run_to_table(S.score_stream(R.folder_stream(spark, path), Half(), ["id"]), "t").toPandas()
    assert len(scored) == 600 and np.allclose(scored.sort_values("id")["half"], df.toPandas().sort_values("id")["v"] / 2)


def test_buffer_over_many_batches(spark, arrivals):
    df, path = arrivals
    got = S.recent_buffer(R.folder_stream(spark, path), "t", "user", "ts", "id", 4).select("user", "id").toPandas()
    expected = SE.recent(df, "user", "ts", "id", 4).select("user", "id").toPandas()
    key = ["user", "id"]
    assert got.sort_values(key).to_numpy().tolist() == expected.sort_values(key).to_numpy().tolist()


def test_windows_and_sessions(spark, arrivals):
    df, path = arrivals
    mark = df.agg(F.max("s")).first()[0] - 600
    stream = R.folder_stream(spark, path)
    windows = R.run_to_table(S.window_metrics(stream, "ts", "user", "v", "10 minutes"), "w").toPandas()
    batch = df.groupBy(F.window("ts", "10 minutes").alias("w"), "user").agg(F.count("*").alias("n")).filter(F.unix_timestamp("w.end") <= mark)
    assert windows["n"].sum() == batch.agg(F.sum("n")).first()[0] and len(windows) == batch.count()
    closed = R.run_to_table(S.session_stream(R.folder_stream(spark, path), "user", "ts", "2 minutes"), "s").toPandas()
    every = SE.sessions(df, "user", "ts", 120).filter(F.unix_timestamp("last") + 120 <= mark).toPandas()
    assert sorted(closed["rows"]) == sorted(every["rows"])


def test_answers_once(spark, arrivals):
    _, path = arrivals
    twice = R.folder_stream(spark, path).withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    out = R.run_to_table(S.answer_once(twice, "id", "ts"), "a")
    assert out.count() == 600 and out.select("id").distinct().count() == 600


def test_dead_letters(spark, arrivals):
    _, path = arrivals
    stream = R.folder_stream(spark, path).withColumn("v", F.when(F.col("id") % 50 == 0, -1.0).otherwise(F.col("v")))
    good, bad = S.split_failures(S.score_stream(stream, Half(), ["id"], guard=True), "d")
    assert (good.count(), bad.count()) == (588, 12)
    assert bad.select("error").distinct().collect()[0]["error"] == "negative"


def test_streams_go_on_after_a_stop(spark, arrivals, tmp_path):
    """Half of the files, a stop, then the rest: nothing is lost or repeated."""
    df, path = arrivals
    inbox, table, buffer = str(tmp_path / "in"), str(tmp_path / "table"), str(tmp_path / "buffer")
    early, late = df.filter("s < 9000"), df.filter("s >= 9000")
    for part in (early, late):
        part.coalesce(1).write.mode("append").parquet(inbox)
        scored = R.run_to_table(S.score_stream(R.folder_stream(spark, inbox), Half(), ["id"]), "t", folder=table)
        kept = S.recent_buffer(R.folder_stream(spark, inbox), "t", "user", "ts", "id", 4, folder=buffer)
    assert scored.count() == scored.select("id").distinct().count() == 600
    expected = SE.recent(df, "user", "ts", "id", 4).select("user", "id").toPandas()
    key = ["user", "id"]
    assert kept.select("user", "id").toPandas().sort_values(key).to_numpy().tolist() == expected.sort_values(key).to_numpy().tolist()
    query = R.start_table(R.folder_stream(spark, inbox).select("id"), str(tmp_path / "on"), processingTime="1 second")
    query.processAllAvailable()
    query.stop()
    assert spark.read.parquet(str(tmp_path / "on" / "rows")).count() == 600
