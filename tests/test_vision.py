"""Suppression, anchors and regions against brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridloom.functions import arrays as A
from gridloom.functions import boxes as BX
from gridloom.operators import detection as D
from gridloom.operators import images as I
from gridloom.operators import regions as R


def overlap(a, b):
    wide = min(a.x + a.w, b.x + b.w) - max(a.x, b.x)
    high = min(a.y + a.h, b.y + b.h) - max(a.y, b.y)
    common = max(wide, 0) * max(high, 0)
    union = a.w * a.h + b.w * b.h - common
    return common / union if union > 0 else 0.0


def brute(frame, threshold, keep_equal):
    kept = []
    for row in frame.sort_values(["score", "id"], ascending=[False, True]).itertuples():
        values = [overlap(row, k) for k in kept if k.g == row.g]
        if all((v <= threshold) if keep_equal else (v < threshold) for v in values):
            kept.append(row)
    return sorted(k.id for k in kept)


@pytest.fixture(scope="module")
def crowd():
    rng = np.random.default_rng(5)
    n = 160
    frame = pd.DataFrame({
        "g": np.where(rng.random(n) < 0.7, 0, rng.integers(1, 4, n)), "id": np.arange(n), "score": rng.integers(0, 50, n) / 50,
        "x": rng.random(n), "y": rng.random(n), "w": np.exp(rng.normal(-1.5, 0.6, n)), "h": np.exp(rng.normal(-1.5, 0.6, n)),
    })
    frame.loc[:12, ["x", "y", "w", "h"]] = [0.3, 0.3, 0.2, 0.2]
    frame.loc[13:15, "w"] = 0.0
    return frame


@pytest.mark.parametrize("threshold,keep_equal,max_group", [
    (0.4, False, 0), (0.45, True, 30), (0.7, False, 30), (0.15, False, 30), (0.4, False, 10_000), (0.45, True, 10_000),
])
def test_suppression(spark, crowd, threshold, keep_equal, max_group):
    df = spark.createDataFrame(crowd)
    kept = D.suppress(df, ["g"], "id", "score", threshold, keep_equal, max_group=max_group)
    assert sorted(r["id"] for r in kept.select("id").collect()) == brute(crowd, threshold, keep_equal)


def test_suppression_rows_do_not_pair(spark, crowd):
    """A group of identical boxes leaves one, without forming pairs."""
    same = pd.DataFrame({"g": 1, "id": np.arange(3000), "score": np.arange(3000) / 3000, "x": 0.1, "y": 0.1, "w": 0.5, "h": 0.5})
    kept = D.suppress(spark.createDataFrame(same), ["g"], "id", "score", 0.4, max_group=100).collect()
    assert [r["id"] for r in kept] == [2999]


def test_prior_counts(spark):
    grid = D.PriorGrid.of(512, 512, [0.2, 0.272], [1.0, 2.0, 0.5])
    assert grid.size() == 1048576
    assert grid.table(spark).count() == 1048576
    first = grid.table(spark).orderBy("anchor_id").first()
    assert (first["w"], first["h"]) == (0.2, 0.2) and abs(first["cx"] - 0.5 / 512) < 1e-12


def test_default_boxes(spark):
    boxes = D.default_boxes(spark, 300, [38, 19, 10, 5, 3, 1], [8, 16, 32, 64, 100, 300], [21, 45, 99, 153, 207, 261, 315], [[2], [2, 3], [2, 3], [2, 3], [2], [2]])
    assert boxes.count() == 8732
    assert boxes.select("prior_id").distinct().count() == 8732
    row = boxes.filter("prior_id = 1").first()
    assert abs(row["cx"] - 1.5 * 8 / 300) < 1e-12 and abs(row["w"] - 21 / 300) < 1e-12
    faces = D.face_boxes(spark, 640, 480, [[10, 16, 24], [32, 48], [64, 96], [128, 192, 256]], [8, 16, 32, 64])
    assert faces.count() == 80 * 60 * 3 + 40 * 30 * 2 + 20 * 15 * 2 + 10 * 8 * 3


def test_offsets_round_trip(spark):
    df = spark.createDataFrame([(0.2, 0.3, 0.4, 0.1)], "x double, y double, w double, h double")
    prior = F.struct(F.lit(0.5).alias("cx"), F.lit(0.4).alias("cy"), F.lit(0.25).alias("w"), F.lit(0.2).alias("h"))
    box = BX.box(*map(F.col, "xywh"))
    back = BX.decode_offsets(BX.encode_offsets(box, prior), prior)
    row = df.select(back.alias("b")).first()["b"]
    assert np.allclose([row.x, row.y, row.w, row.h], [0.2, 0.3, 0.4, 0.1])


def components(cells):
    todo, out = set(cells), []
    while todo:
        stack, found = [todo.pop()], []
        while stack:
            i, j = stack.pop()
            found.append((i, j))
            for near in ((i + 1, j), (i - 1, j), (i, j + 1), (i, j - 1)):
                if near in todo:
                    todo.remove(near)
                    stack.append(near)
        out.append(sorted(found))
    return sorted(out)


@pytest.mark.parametrize("tile,max_edges", [(3, 1_000_000), (6, 0), (16, 1_000_000), (256, 0)])
def test_regions(spark, tile, max_edges):
    rng = np.random.default_rng(8)
    grid = rng.random((40, 50)) < 0.58
    snake = np.zeros((40, 50), dtype=bool)
    snake[::2] = True
    snake[1::4, -1] = True
    snake[3::4, 0] = True
    rows = [(m, int(i), int(j)) for m, g in ((1, grid), (2, snake)) for i, j in zip(*np.nonzero(g), strict=True)]
    df = spark.createDataFrame(rows, "m int, i int, j int")
    out = R.regions(df, "m", tile, max_edges).toPandas()
    assert len(out) == len(rows)
    for m in (1, 2):
        got = out[out["m"] == m].groupby("region")[["i", "j"]].apply(lambda p: sorted(map(tuple, p.to_numpy().tolist())))
        assert sorted(got.tolist()) == components([(i, j) for k, i, j in rows if k == m])
    big = R.region_boxes(R.regions(df, "m", tile, max_edges), "m").filter("m = 2").toPandas()
    assert big[["i0", "j0", "i1", "j1"]].to_numpy().tolist() == [[0, 0, 39 if snake[39].any() else 38, 49]]


def test_image_steps(spark):
    pixels = list(range(12))
    df = spark.createDataFrame([(1, [float(x) for x in pixels])], "id long, p array<double>")
    p, two = F.col("p"), F.lit(2)
    row = df.select(
        I.flip(p, 2, 2, 3, True).alias("lr"), I.flip(p, 2, 2, 3, False).alias("tb"), I.to_tensor(p, 2, 2, 3).alias("t"),
        I.resize(p, two, two, 3, two, two).alias("same"), I.resize(p, two, two, 3, F.lit(4), F.lit(4), "nearest").alias("double"),
        I.colour_jitter(p, 1, F.col("id")).alias("calm"),
    ).first()
    image = np.arange(12.0).reshape(2, 2, 3)
    assert np.allclose(row["lr"], image[:, ::-1].ravel())
    assert np.allclose(row["tb"], image[::-1].ravel())
    assert np.allclose(row["t"], image.transpose(2, 0, 1).ravel() / 255)
    assert np.allclose(row["same"], pixels)
    assert np.allclose(row["double"], image.repeat(2, 0).repeat(2, 1).ravel())
    assert np.allclose(row["calm"], pixels)


def test_short_edge(spark):
    h, w = I.short_edge_size(F.col("h"), F.col("w"))
    df = spark.createDataFrame([(300, 400), (300, 900)], "h int, w int").select(h.alias("h"), w.alias("w"))
    assert [tuple(r) for r in df.collect()] == [(600, 800), (333, 1000)]


def test_random_augmentation_repeats(spark):
    df = spark.createDataFrame([(i, [float(x) for x in range(12)]) for i in range(200)], "id long, p array<double>")
    pick = lambda d: d.select("id", I.random_flip(F.col("p"), 2, 2, 3, 5, F.col("id")).alias("p")).toPandas().sort_values("id")["p"].map(list).tolist()
    one, two = pick(df.coalesce(1)), pick(df.repartition(6))
    assert one == two
    flipped = sum(list(p) != [float(x) for x in range(12)] for p in one)
    assert 60 < flipped < 140
    window = I.random_crop_window(8, 10, 3, F.col("id"))
    ok = df.select(*[c.alias(n) for n, c in window.items()]).filter(
        "top < 0 or left < 0 or crop_height < 1 or crop_width < 1 or top + crop_height > 8 or left + crop_width > 10"
    )
    assert ok.count() == 0


def test_arg_max_first(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0],)], "a array<double>")
    row = df.select(A.arg_max(F.col("a")).alias("m"), A.arg_sort(F.col("a"), False).alias("s")).first()
    assert row["m"] == 1 and row["s"] == [1, 2, 0]
