"""Boxes as (x, y, w, h) columns: overlap and decoding of detector rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.functions import arrays as A


def box(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))


def intersection(a: Column, b: Column) -> Column:
    wide = F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"])
    high = F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"])
    return F.greatest(wide, F.lit(0.0)) * F.greatest(high, F.lit(0.0))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union with the overlap clamped at zero; zero for two empty boxes."""
    common = intersection(a, b)
    union = a["w"] * a["h"] + b["w"] * b["h"] - common
    return F.when(union > 0, common / F.when(union > 0, union)).otherwise(F.lit(0.0))


def from_centre(cx: Column, cy: Column, w: Column, h: Column, clamp: bool = True) -> Column:
    x, y = cx - w / 2, cy - h / 2
    if clamp:
        x, y = F.greatest(x, F.lit(0.0)), F.greatest(y, F.lit(0.0))
    return box(x, y, w, h)


def from_corners(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return box(x0, y0, x1 - x0, y1 - y0)


def clipped_unit(x0: Column, y0: Column, x1: Column, y1: Column, width: float, height: float) -> Column:
    """Pixel corners clipped to the image and divided by its size."""
    a, c = (A.clip(v, 0.0, width) / width for v in (x0, x1))
    b, d = (A.clip(v, 0.0, height) / height for v in (y0, y1))
    return from_corners(a, b, c, d)


def objectness_row(row: Column) -> dict[str, Column]:
    """Decode ``[cx, cy, w, h, objectness, class scores...]``."""
    classes = F.slice(row, F.lit(6), F.size(row) - 5)
    best = F.greatest(F.array_max(classes), F.lit(0.0))
    at = lambda i: F.get(row, F.lit(i))
    return {
        "class": F.when(best > 0, A.arg_max(classes)).otherwise(0),
        "score": best * at(4),
        "box": from_centre(at(0), at(1), at(2), at(3)),
    }


def decode_offsets(loc: Column, prior: Column, centre_scale: float = 0.1, size_scale: float = 0.2) -> Column:
    """Regression output [dx, dy, dw, dh] relative to a prior (cx, cy, w, h) struct."""
    at = lambda i: F.get(loc, F.lit(i))
    w, h = F.exp(at(2) * size_scale) * prior["w"], F.exp(at(3) * size_scale) * prior["h"]
    cx = at(0) * centre_scale * prior["w"] + prior["cx"]
    cy = at(1) * centre_scale * prior["h"] + prior["cy"]
    return box(cx - w / 2, cy - h / 2, w, h)


def decode_points(points: Column, prior: Column, count: int = 5, centre_scale: float = 0.1) -> Column:
    """Landmark offsets [x0, y0, x1, y1, ...] relative to a prior, as an array of (x, y)."""
    at = lambda i: F.get(points, F.lit(i))
    return F.array(
        *[
            F.struct(
                (at(2 * i) * centre_scale * prior["w"] + prior["cx"]).alias("x"),
                (at(2 * i + 1) * centre_scale * prior["h"] + prior["cy"]).alias("y"),
            )
            for i in range(count)
        ]
    )


def encode_offsets(truth: Column, prior: Column, centre_scale: float = 0.1, size_scale: float = 0.2) -> Column:
    """The regression target [dx, dy, dw, dh] that decodes to ``truth`` (x, y, w, h)."""
    cx, cy = truth["x"] + truth["w"] / 2, truth["y"] + truth["h"] / 2
    return F.array(
        (cx - prior["cx"]) / prior["w"] / centre_scale,
        (cy - prior["cy"]) / prior["h"] / centre_scale,
        F.ln(truth["w"] / prior["w"]) / size_scale,
        F.ln(truth["h"] / prior["h"]) / size_scale,
    )
