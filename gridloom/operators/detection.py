"""Prior boxes, anchor targets and non-maximum suppression on box tables."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.functions import boxes as BX
from gridloom.operators.lookup import checked_lookup
from gridloom.session import cut_lineage

MAX_GROUP = 20_000


@dataclass(frozen=True)
class PriorGrid:
    """A regular grid of anchor centres, each with the same list of shapes (w, h)."""

    rows: int
    columns: int
    shapes: tuple[tuple[float, float], ...]
    step: tuple[float, float]
    offset: tuple[float, float] = (0.5, 0.5)

    @staticmethod
    def of(rows: int, columns: int, sizes: list[float], ratios: list[float], steps: tuple[float, float] | None = None,
           offsets: tuple[float, float] = (0.5, 0.5)) -> PriorGrid:
        """Every size with the first ratio, then the first size with the other ratios."""
        pairs = [(s, ratios[0]) for s in sizes] + [(sizes[0], r) for r in ratios[1:]]
        aspect = rows / columns
        shapes = tuple((s * aspect * math.sqrt(r), s / math.sqrt(r)) for s, r in pairs)
        return PriorGrid(rows, columns, shapes, steps or (1.0 / rows, 1.0 / columns), offsets)

    def size(self) -> int:
        return self.rows * self.columns * len(self.shapes)

    def shape_array(self) -> Column:
        return F.array(*[
            F.struct(F.lit(k).alias("k"), F.lit(w).alias("w"), F.lit(h).alias("h")) for k, (w, h) in enumerate(self.shapes)
        ])

    def centre(self, i: Column, j: Column) -> tuple[Column, Column]:
        """(cx, cy) of grid row ``i`` and grid column ``j``."""
        return (j + self.offset[1]) * self.step[1], (i + self.offset[0]) * self.step[0]

    def table(self, spark: SparkSession, clip: bool = False) -> DataFrame:
        """(anchor_id, cx, cy, w, h, x0, y0, x1, y1), ids by row, column and shape."""
        cells = spark.range(self.rows * self.columns).select(
            F.floor(F.col("id") / self.columns).alias("i"), (F.col("id") % self.columns).alias("j"), "id"
        )
        cx, cy = self.centre(F.col("i"), F.col("j"))
        out = cells.withColumn("s", F.explode(self.shape_array())).select(
            (F.col("id") * len(self.shapes) + F.col("s.k")).alias("anchor_id"), cx.alias("cx"), cy.alias("cy"),
            F.col("s.w").alias("w"), F.col("s.h").alias("h"),
        )
        corners = {"x0": F.col("cx") - F.col("w") / 2, "y0": F.col("cy") - F.col("h") / 2,
                   "x1": F.col("cx") + F.col("w") / 2, "y1": F.col("cy") + F.col("h") / 2}
        for name, value in corners.items():
            out = out.withColumn(name, F.greatest(F.least(value, F.lit(1.0)), F.lit(0.0)) if clip else value)
        return out


def default_boxes(spark: SparkSession, image: float, cells: list[int], steps: list[int], scales: list[int],
                  ratios: list[list[int]]) -> DataFrame:
    """Default boxes of a multi-scale detector, (prior_id, cx, cy, w, h) clipped to [0, 1]."""
    levels = []
    for level, count in enumerate(cells):
        small, large = scales[level] / image, scales[level + 1] / image
        middle = math.sqrt(small * large)
        shapes = [(small, small), (middle, middle)]
        for ratio in ratios[level]:
            wide, flat = small * math.sqrt(ratio), small / math.sqrt(ratio)
            shapes += [(wide, flat), (flat, wide)]
        levels.append((count, steps[level] / image, shapes))
    return _levels(spark, levels, shape_first=True)


def face_boxes(spark: SparkSession, width: int, height: int, scales: list[list[int]], steps: list[int]) -> DataFrame:
    """Default boxes of a face detector: grid cells in the outer, scales in the inner loop."""
    parts, before = [], 0
    for sizes, step in zip(scales, steps, strict=True):
        rows, columns = math.ceil(height / step), math.ceil(width / step)
        grid = PriorGrid(rows, columns, tuple((s / width, s / height) for s in sizes), (step / height, step / width))
        parts.append(grid.table(spark).select((F.col("anchor_id") + before).alias("prior_id"), "cx", "cy", "w", "h"))
        before += grid.size()
    return _clipped(parts)


def _levels(spark: SparkSession, levels, shape_first: bool) -> DataFrame:
    parts, before = [], 0
    for count, step, shapes in levels:
        grid = PriorGrid(count, count, tuple(shapes), (step, step))
        table = grid.table(spark).withColumn("shape", F.col("anchor_id") % len(shapes)).withColumn("cell", F.floor(F.col("anchor_id") / len(shapes)))
        number = F.col("shape") * (count * count) + F.col("cell") if shape_first else F.col("anchor_id")
        parts.append(table.select((number + before).alias("prior_id"), "cx", "cy", "w", "h"))
        before += grid.size()
    return _clipped(parts)


def _clipped(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    bounded = [F.greatest(F.least(F.col(c), F.lit(1.0)), F.lit(0.0)).alias(c) for c in ("cx", "cy", "w", "h")]
    return out.select("prior_id", *bounded)


def match_priors(truths: DataFrame, grid: PriorGrid, image: str, truth: str, threshold: float = 0.5) -> DataFrame:
    """Positive anchors (image, anchor_id, truth, iou): anchors overlapping a truth box enough take their best
    one, and every truth box claims its best anchor whatever the overlap.

    ``truths`` has columns x, y, w, h. Anchors stand on a regular grid, so the range of grid cells that can
    reach the threshold follows from the box itself: candidates are generated, not joined.
    """
    b = F.col("_b")
    shaped = truths.select(image, truth, BX.box(*map(F.col, "xywh")).alias("_b"), F.explode(grid.shape_array()).alias("_s"))
    shaped = shaped.withColumn("_cx", b["x"] + b["w"] / 2).withColumn("_cy", b["y"] + b["h"] / 2)

    def nearest(centre: Column, axis: int, count: int) -> Column:
        place = F.floor(centre / grid.step[axis] - grid.offset[axis] + 0.5)
        return F.greatest(F.lit(0), F.least(F.lit(count - 1), place))

    def reach(axis: int, count: int, centre: Column, size_t: Column, size_a: Column) -> Column:
        slack = (size_t + size_a) / 2 - F.lit(threshold) * F.greatest(size_t, size_a) + F.lit(1e-9)
        low = F.ceil((centre - slack) / grid.step[axis] - grid.offset[axis])
        high = F.floor((centre + slack) / grid.step[axis] - grid.offset[axis])
        low, high = F.greatest(low, F.lit(0)), F.least(high, F.lit(count - 1))
        near = F.sequence(F.least(low, high), high)
        return F.when((slack >= 0) & (low <= high), near).otherwise(F.array().cast("array<bigint>"))

    def scored(df: DataFrame) -> DataFrame:
        cx, cy = grid.centre(F.col("_i"), F.col("_j"))
        anchor = BX.box(cx - F.col("_s.w") / 2, cy - F.col("_s.h") / 2, F.col("_s.w"), F.col("_s.h"))
        number = (F.col("_i") * grid.columns + F.col("_j")) * len(grid.shapes) + F.col("_s.k")
        return df.select(image, truth, number.alias("anchor_id"), BX.iou(anchor, b).alias("iou"))

    # A box's best anchor is found in its own row. Equal overlaps (a box inside several anchors) go to the nearest centre,
    # then to the lowest id.
    def placed(shape: Column) -> Column:
        i, j = nearest(F.col("_cy"), 0, grid.rows), nearest(F.col("_cx"), 1, grid.columns)
        cx, cy = grid.centre(i, j)
        overlap = BX.iou(BX.box(cx - shape["w"] / 2, cy - shape["h"] / 2, shape["w"], shape["h"]), b)
        number = (i * grid.columns + j) * len(grid.shapes) + shape["k"]
        return F.struct(F.round(overlap, 9).alias("o"), (-number).alias("a"), overlap.alias("iou"))

    centred = truths.select(image, truth, BX.box(*map(F.col, "xywh")).alias("_b"))
    centred = centred.withColumns({"_cx": b["x"] + b["w"] / 2, "_cy": b["y"] + b["h"] / 2})
    best = centred.select(image, truth, F.array_max(F.transform(grid.shape_array(), placed)).alias("_m"))
    claims = best.select(image, truth, (-F.col("_m.a")).alias("anchor_id"), F.col("_m.iou").alias("iou"), F.lit(1).alias("claimed"))
    near = shaped.withColumn("_i", F.explode(reach(0, grid.rows, F.col("_cy"), b["h"], F.col("_s.h"))))
    near = near.withColumn("_j", F.explode(reach(1, grid.columns, F.col("_cx"), b["w"], F.col("_s.w"))))
    over = scored(near).filter(F.col("iou") >= threshold).withColumn("claimed", F.lit(0))
    rank = F.struct("claimed", "iou", (-F.col(truth)).alias("t"))
    return (
        claims.unionByName(over)
        .groupBy(image, "anchor_id")
        .agg(F.max(rank).alias("_m"))
        .select(image, "anchor_id", (-F.col("_m.t")).alias(truth), F.col("_m.iou").alias("iou"))
    )


def all_anchor_targets(images: DataFrame, positives: DataFrame, classes: DataFrame, grid: PriorGrid, image: str, truth: str) -> DataFrame:
    """One row per image and anchor: ``target`` is 0 for background, else 1 + class of the matched box."""
    named = positives.join(classes, [image, truth]).select(image, "anchor_id", truth, "class")
    numbers = F.sequence(F.lit(0).cast("long"), F.lit(grid.size() - 1).cast("long"))
    every = images.select(image).distinct().withColumn("anchor_id", F.explode(numbers))
    return every.join(named, [image, "anchor_id"], "left").withColumn("target", F.coalesce(F.col("class") + 1, F.lit(0)))


def hard_negatives(targets: DataFrame, image: str, confidence: str, ratio: float, threshold: float = 0.5, minimum: int = 0) -> DataFrame:
    """Mark anchors for training: positives, and per image the hardest negatives up to ``ratio`` per positive.

    ``confidence`` is the predicted background probability; a negative counts when it is below ``threshold``.
    All others get ``target`` -1. An image has a fixed number of anchors, so its window is bounded.
    """
    positives = F.sum((F.col("target") > 0).cast("int")).over(Window.partitionBy(image))
    hard = (F.col("target") == 0) & (F.col(confidence) < threshold)
    order = Window.partitionBy(image).orderBy(hard.desc(), F.col(confidence).asc(), F.col("anchor_id").asc())
    allowed = F.greatest(F.lit(minimum).cast("double"), F.col("_p") * ratio)
    return (
        targets.withColumn("_p", positives)
        .withColumn("_r", F.row_number().over(order))
        .withColumn("target", F.when((F.col("target") > 0) | (hard & (F.col("_r") <= allowed)), F.col("target")).otherwise(-1))
        .drop("_p", "_r")
    )


def suppress(
    df: DataFrame, group: list[str], key: str, score: str, threshold: float, keep_equal: bool = False,
    max_group: int | None = None,
) -> DataFrame:
    """Greedy non-maximum suppression per group over columns x, y, w, h; ties by ``key``.

    A box is dropped when its overlap with an already kept, better box reaches ``threshold`` (with
    ``keep_equal``: exceeds it). Null and NaN scores come last; boxes with a null, NaN or infinite coordinate are kept and drop
    none. Groups of normal size run in one Arrow group each. Larger ones are solved
    together by :func:`_suppress_spread`; both give the same boxes.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must lie above 0 and not above 1")
    max_group = MAX_GROUP if max_group is None else max_group
    # A box without a place meets no other: it is kept, whatever the size of its group.
    placed = reduce(and_, (F.coalesce(F.abs(F.col(c)) < float("inf"), F.lit(False)) for c in "xywh"))
    loose, df = df.where(~placed), df.where(placed)
    return _suppress_placed(df, group, key, score, threshold, keep_equal, max_group).unionByName(loose)


def _suppress_placed(df: DataFrame, group: list[str], key: str, score: str, threshold: float, keep_equal: bool, max_group: int) -> DataFrame:
    # Groups are compared as structs, which are equal even where they hold null.
    grouped = df.withColumn("_group", F.struct(*group))
    hot = grouped.groupBy("_group").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > max_group).select("_group")
    if hot.isEmpty():
        return _suppress_local(df, group, key, score, threshold, keep_equal)
    hot = cut_lineage(hot)
    normal = checked_lookup(grouped, hot, ["_group"], [key], how="left_anti").select(*df.columns)
    large = checked_lookup(grouped, hot, ["_group"], [key], how="left_semi")
    kept = _suppress_spread(large, group, key, score, threshold, keep_equal, max_group).select(*df.columns)
    return _suppress_local(normal, group, key, score, threshold, keep_equal).unionByName(kept)


def _suppress_local(df: DataFrame, group: list[str], key: str, score: str, threshold: float, keep_equal: bool) -> DataFrame:
    def greedy(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values([score, key], ascending=[False, True])
        x, y, w, h = (part[c].to_numpy(dtype=float) for c in "xywh")
        alive = np.ones(len(part), dtype=bool)
        for i in range(len(part)):
            if not alive[i]:
                continue
            rest = np.flatnonzero(alive[i + 1 :]) + i + 1
            wide = np.minimum(x[i] + w[i], x[rest] + w[rest]) - np.maximum(x[i], x[rest])
            high = np.minimum(y[i] + h[i], y[rest] + h[rest]) - np.maximum(y[i], y[rest])
            common = np.maximum(wide, 0.0) * np.maximum(high, 0.0)
            union = w[i] * h[i] + w[rest] * h[rest] - common
            overlap = np.divide(common, union, out=np.zeros_like(common), where=union > 0)
            alive[rest[(overlap > threshold) if keep_equal else (overlap >= threshold)]] = False
        return part[alive]

    return df.groupBy(*group).applyInPandas(greedy, df.schema)


def _suppress_spread(df: DataFrame, group: list[str], key: str, score: str, threshold: float, keep_equal: bool,
                     max_group: int) -> DataFrame:
    """The same result by rounds of grouped maxima, for groups of any size.

    ``df`` has the group columns also as one struct, ``_group``, by which rows are joined.

    Two boxes can only collide if their sides differ by less than a factor 1/threshold and they share a
    point. Each box is entered in the grid cells it touches, at the grid sizes fitting its sides, so that
    colliding boxes share a cell. In each round the best undecided box of all its cells is kept, and boxes
    colliding with a kept one are dropped. A cell holds at most one newly kept box per round, so no pairs of
    boxes are formed, and the maxima are combined before the shuffle. As soon as no group has more than
    ``max_group`` undecided boxes, the rest is finished locally: earlier rounds have already removed what the
    kept boxes suppress.
    """
    # Boxes that collide at 1 also collide a little below, where the central parts still have a width.
    reach = min(threshold, 0.99)
    spread = math.ceil(math.log2(1.0 / reach))
    flat = df.filter((F.col("w") <= 0) | (F.col("h") <= 0))
    solid = df.filter((F.col("w") > 0) & (F.col("h") > 0))

    def cells(origin: str, side: str) -> Column:
        # Boxes overlapping by ``threshold`` also overlap in their central parts of (1 - threshold) of each side.
        low = F.col(origin) + F.col(side) * (reach / 2)
        high = F.col(origin) + F.col(side) * (1 - reach / 2)
        level = F.floor(F.log2(F.col(side))).cast("int")
        width = lambda k: F.pow(F.lit(2.0), k + 1) * (1 - reach)
        return F.flatten(F.transform(F.sequence(level, level + spread), lambda k: F.transform(
            F.sequence(F.floor(low / width(k) - 1e-9), F.floor(high / width(k) + 1e-9)),
            lambda c: F.struct(k.alias("k"), c.alias("c")),
        )))

    places = solid.withColumn("_cx", F.explode(cells("x", "w"))).withColumn("_cy", F.explode(cells("y", "h")))
    cell = ["_group", "_cx", "_cy"]
    # The smallest is the best: high scores, then low keys of any type; null and NaN scores are NaN, which is last.
    rank = F.struct(F.coalesce(-F.col(score).cast("double"), F.lit(float("nan"))).alias("s"), F.col(key).alias("k"))
    entries = cut_lineage(places.select("_group", "_cx", "_cy", key, rank.alias("_rank"), BX.box(*map(F.col, "xywh")).alias("_b")))
    kept = solid.limit(0).select("_group", key)
    undecided = entries.select("_group", key).distinct()
    while not undecided.groupBy("_group").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > max_group).isEmpty():
        best = cut_lineage(entries.groupBy(*cell).agg(F.min("_rank").alias("_best")))
        seen = checked_lookup(entries, best, cell, [key], how="inner")
        top = seen.groupBy("_group", key).agg(F.bool_and(F.col("_rank") == F.col("_best")).alias("_top")).filter("_top")
        top = cut_lineage(top.select("_group", key))
        kept = kept.unionByName(top)
        winners = entries.join(top, ["_group", key], "left_semi").select(*cell, F.col(key).alias("_winner"), F.col("_b").alias("_kept"))
        met = checked_lookup(entries, cut_lineage(winners), cell, [key], how="inner")
        overlap = BX.iou(F.col("_kept"), F.col("_b"))
        hit = (overlap > threshold) if keep_equal else (overlap >= threshold)
        gone = met.filter((F.col("_winner") == F.col(key)) | hit).select("_group", key).distinct()
        entries = cut_lineage(entries.join(gone, ["_group", key], "left_anti"))
        undecided = entries.select("_group", key).distinct()
    sure = solid.join(kept, ["_group", key], "left_semi")
    rest = solid.join(undecided, ["_group", key], "left_semi")
    left = _suppress_local(rest.drop("_group"), group, key, score, threshold, keep_equal)
    return sure.drop("_group").unionByName(left).unionByName(flat.drop("_group"))


def top_scores(df: DataFrame, image: list[str], score: str, key: str, k: int) -> DataFrame:
    """The ``k`` best boxes per image; the rank is limited before the shuffle."""
    order = Window.partitionBy(*image).orderBy(F.col(score).desc(), F.col(key).asc())
    return df.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k).drop("_r")
