"""Image preparation on packed pixels: one array per image in height, width, channel order."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.arrays import let
from gridloom.functions.numeric import seeded_uniform


def to_tensor(pixels: Column, height: int, width: int, channels: int) -> Column:
    """Channel-first order, divided by 255."""
    area = height * width
    places = F.sequence(F.lit(0), F.lit(area * channels - 1))
    return let(
        pixels, lambda x: F.transform(places, lambda p: F.get(x, (p % area) * channels + F.floor(p / area).cast("int")) / 255.0)
    )


def normalize(pixels: Column, mean: list[float], deviation: list[float]) -> Column:
    """``(x - mean) / deviation`` per channel, channels last."""
    means, deviations = (F.array(*[F.lit(float(v)) for v in values]) for values in (mean, deviation))
    count = len(mean)
    return F.transform(pixels, lambda x, i: (x - F.get(means, i % count)) / F.get(deviations, i % count))


def normalize_cells(cells: DataFrame, channel: str, mean: list[float], deviation: list[float], value: str = "v") -> DataFrame:
    means, deviations = (F.array(*[F.lit(float(v)) for v in values]) for values in (mean, deviation))
    at = F.col(channel).cast("int")
    return cells.withColumn(value, (F.col(value) - F.get(means, at)) / F.get(deviations, at))


def crop_cells(cells: DataFrame, top: int, left: int, height: int, width: int) -> DataFrame:
    """Keep a rectangle of (i, j) cells and count positions from its corner."""
    i, j = F.col("i"), F.col("j")
    kept = cells.filter((i >= top) & (i < top + height) & (j >= left) & (j < left + width))
    return kept.withColumn("i", i - top).withColumn("j", j - left)


def centre_crop_cells(cells: DataFrame, rows: int, columns: int, height: int | None = None, width: int | None = None) -> DataFrame:
    """Central rectangle; without a size the largest central square."""
    height = height or min(rows, columns)
    width = width or min(rows, columns)
    return crop_cells(cells, (rows - height) // 2, (columns - width) // 2, height, width)


def short_edge_size(height: Column, width: Column, short: int = 600, limit: int = 1000) -> tuple[Column, Column]:
    """Target size whose shorter edge is ``short`` unless the longer one would pass ``limit``."""
    low, high = F.least(height, width), F.greatest(height, width)
    scale = F.lit(float(short)) / low
    scale = F.when(F.floor(scale * high + 0.5) > limit, F.lit(float(limit)) / high).otherwise(scale)
    return F.floor(height * scale + 0.5).cast("int"), F.floor(width * scale + 0.5).cast("int")


def resize(pixels: Column, height: Column, width: Column, channels: int, out_height: Column, out_width: Column,
           mode: str = "bilinear", top: Column | None = None, left: Column | None = None,
           crop_height: Column | None = None, crop_width: Column | None = None) -> Column:
    """Resize the whole image or a crop window of it; ``nearest`` or ``bilinear`` with half-pixel centres."""

    def axis(start: int, length: int, out: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        centre = (np.arange(out) + 0.5) * length / out - 0.5
        low = np.floor(centre)
        part = centre - low
        first = np.clip(low, 0, length - 1).astype(int) + start
        second = np.clip(low + 1, 0, length - 1).astype(int) + start
        return first, second, part

    def one(row, h, w, oh, ow, t, lft, ch, cw):
        image = np.asarray(row, dtype=float).reshape(h, w, channels)
        if mode == "nearest":
            rows = t + np.minimum(np.arange(oh) * ch // oh, ch - 1)
            columns = lft + np.minimum(np.arange(ow) * cw // ow, cw - 1)
            return image[rows][:, columns].ravel()
        r0, r1, rp = axis(t, ch, oh)
        c0, c1, cp = axis(lft, cw, ow)
        cp, rp = cp[None, :, None], rp[:, None, None]
        upper = image[r0][:, c0] * (1 - cp) + image[r0][:, c1] * cp
        lower = image[r1][:, c0] * (1 - cp) + image[r1][:, c1] * cp
        return (upper * (1 - rp) + lower * rp).ravel()

    @F.pandas_udf("array<double>")
    def run(p: pd.Series, h: pd.Series, w: pd.Series, oh: pd.Series, ow: pd.Series, t: pd.Series, lft: pd.Series,
            ch: pd.Series, cw: pd.Series) -> pd.Series:
        return pd.Series([None if a[0] is None else one(*a) for a in zip(p, h, w, oh, ow, t, lft, ch, cw, strict=True)])

    zero = F.lit(0)
    crop_h = height if crop_height is None else crop_height
    crop_w = width if crop_width is None else crop_width
    sizes = [height, width, out_height, out_width, top if top is not None else zero, left if left is not None else zero, crop_h, crop_w]
    return run(pixels, *[s.cast("int") for s in sizes])


def random_crop_window(height: int, width: int, seed: int, key: Column, area: tuple[float, float] = (0.08, 1.0),
                       ratio: tuple[float, float] = (0.75, 4 / 3)) -> dict[str, Column]:
    """A seeded crop window of random area and aspect ratio inside the image."""
    share = area[0] + (area[1] - area[0]) * seeded_uniform(seed, key)
    aspect = F.exp(F.lit(np.log(ratio[0])) + F.lit(float(np.log(ratio[1] / ratio[0]))) * seeded_uniform(seed + 1, key))
    target = share * (height * width)
    crop_w = F.greatest(F.lit(1), F.least(F.lit(width), F.floor(F.sqrt(target * aspect) + 0.5))).cast("int")
    crop_h = F.greatest(F.lit(1), F.least(F.lit(height), F.floor(F.sqrt(target / aspect) + 0.5))).cast("int")
    return {
        "top": F.floor(seeded_uniform(seed + 2, key) * (F.lit(height + 1) - crop_h)).cast("int"),
        "left": F.floor(seeded_uniform(seed + 3, key) * (F.lit(width + 1) - crop_w)).cast("int"),
        "crop_height": crop_h,
        "crop_width": crop_w,
    }


def flip(pixels: Column, height: int, width: int, channels: int, left_right: bool) -> Column:
    places = F.sequence(F.lit(0), F.lit(height * width * channels - 1))

    def source(p: Column) -> Column:
        c, cell = p % channels, F.floor(p / channels).cast("int")
        i, j = F.floor(cell / width).cast("int"), cell % width
        i, j = (i, width - 1 - j) if left_right else (height - 1 - i, j)
        return (i * width + j) * channels + c

    return let(pixels, lambda x: F.transform(places, lambda p: F.get(x, source(p))))


def random_flip(pixels: Column, height: int, width: int, channels: int, seed: int, key: Column, left_right: bool = True) -> Column:
    """Flip with probability one half, decided by the row's key."""
    return F.when(seeded_uniform(seed, key) < 0.5, flip(pixels, height, width, channels, left_right)).otherwise(pixels)


# Luma weights (ITU-R BT.601) and the YIQ colour transform.
LUMA = [0.299, 0.587, 0.114]
TO_YIQ = [[0.299, 0.587, 0.114], [0.596, -0.274, -0.321], [0.211, -0.523, 0.311]]


def colour_jitter(pixels: Column, seed: int, key: Column, brightness: float = 0.0, contrast: float = 0.0,
                  saturation: float = 0.0, hue: float = 0.0) -> Column:
    """Random brightness, contrast, saturation and hue of RGB pixels; the factors depend on the row's key."""

    def factor(offset: int, width: float) -> Column:
        return 1.0 + (seeded_uniform(seed + offset, key) * 2 - 1) * width

    @F.pandas_udf("array<double>")
    def run(p: pd.Series, b: pd.Series, c: pd.Series, s: pd.Series, h: pd.Series) -> pd.Series:
        luma, to_yiq = np.array(LUMA), np.array(TO_YIQ)
        back = np.linalg.inv(to_yiq)
        out = []
        for row, bright, contr, satur, turn in zip(p, b, c, s, h, strict=True):
            rgb = np.asarray(row, dtype=float).reshape(-1, 3) * bright
            grey = (rgb @ luma)[:, None]
            rgb = rgb * contr + grey.mean() * (1 - contr)
            grey = (rgb @ luma)[:, None]
            rgb = rgb * satur + grey * (1 - satur)
            angle = np.pi * (turn - 1.0)
            rotate = np.array([[1, 0, 0], [0, np.cos(angle), -np.sin(angle)], [0, np.sin(angle), np.cos(angle)]])
            out.append((rgb @ (back @ rotate @ to_yiq).T).ravel())
        return pd.Series(out)

    return run(pixels, factor(0, brightness), factor(1, contrast), factor(2, saturation), factor(3, hue))
