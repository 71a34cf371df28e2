"""Values at ranks by narrowing fences, held against sorted lists."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from gridloom.operators import evaluation, selection

SCHEMA = "g string, v double, id long"


def at(values: list[float], rank: int) -> float:
    return sorted(values, key=lambda x: (math.isnan(x), x))[rank]


def same(a, b) -> bool:
    return a == b or (a is not None and b is not None and math.isnan(a) and math.isnan(b))


def rows_of_all_kinds() -> list[tuple]:
    draw = random.Random(5)
    hot = [draw.choice([-1, 1]) * 10 ** draw.uniform(-300, 300) for _ in range(18_000)]
    few = [float(draw.randrange(3)) for _ in range(1_500)]
    odd = [math.nan] * 400 + [math.inf] * 300 + [-math.inf] * 200 + [draw.random() for _ in range(300)]
    groups = {"hot": hot, "few": few, "odd": odd, None: [draw.gauss(0, 1) for _ in range(700)], "one": [7.0]}
    rows = [(g, v) for g, values in groups.items() for v in values] + [("hot", None), ("nulls", None), ("nulls", None)]
    draw.shuffle(rows)
    return [(g, v, i) for i, (g, v) in enumerate(rows)]


@pytest.mark.parametrize("fenced", [40, 1_000_000])
def test_ranks_equal_a_sort(spark, fenced):
    rows = rows_of_all_kinds()
    n = F.col("_n")
    ranks = [F.lit(0), F.floor(n / 3), F.floor(n * 0.9), n - 1]
    found = {r["g"]: r for r in selection.at_ranks(spark.createDataFrame(rows, SCHEMA), ["g"], "v", "id", ranks, fenced).collect()}
    assert set(found) == {"hot", "few", "odd", None, "one", "nulls"}
    for g, row in found.items():
        values = [v for key, v, _ in rows if key == g and v is not None]
        assert row["_n"] == len(values)
        places = [0, len(values) // 3, math.floor(len(values) * 0.9), len(values) - 1]
        wanted = [at(values, p) for p in places] if values else [None] * 4
        assert all(same(a, b) for a, b in zip(row["_at"], wanted, strict=True)), (g, row["_at"], wanted)


def test_a_missed_fence_is_mended_by_counts(spark, monkeypatch):
    # Sketches of two parts that always show the same value fence in nothing.
    monkeypatch.setattr(selection, "PARTS", 8)
    monkeypatch.setattr(selection, "_sketch", lambda value, kind: F.array(*[F.max(value)] * 9))
    values = [float(i) for i in range(500)]
    df = spark.createDataFrame([("a", v, int(v)) for v in values], SCHEMA)
    found = selection.at_ranks(df, ["g"], "v", "id", [F.lit(250), F.lit(3)], fenced=10).first()
    assert found["_at"] == [250.0, 3.0]


def test_whole_table_empty_table_and_plan(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert [tuple(r) for r in selection.at_ranks(empty, [], "v", "id", [F.lit(0)]).collect()] == [(0, [None])]
    assert selection.at_ranks(empty, ["g"], "v", "id", [F.lit(0)]).collect() == []
    df = spark.createDataFrame([("a", float(i % 10), i) for i in range(100)], SCHEMA)
    out = evaluation.percentiles(df, [], "v", "id", {"half": 0.5, "most": 0.999})
    assert [round(x, 6) for x in out.first()] == [4.5, 9.0]
    plan = evaluation.floor_rank_percentiles(df, "g", "v", "id", [50])._jdf.queryExecution().executedPlan().toString()
    assert "Window [" not in plan and "- Sort [" not in plan, plan
