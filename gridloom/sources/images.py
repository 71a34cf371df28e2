"""Image folders, binary record files and detection annotations."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.arrays import let
from gridloom.operators.lookup import checked_lookup
from gridloom.operators.ordering import ordered_prefix
from gridloom.session import cut_lineage
from gridloom.sources.ranges import list_files, numbered_files, numbered_lines, read_records, unsigned_bytes

# File name endings of images.
EXTENSIONS = ["jpg", "jpeg", "png", "bmp", "wbmp", "gif"]
MISSING_DIGIT = 11


def label_paths(files: DataFrame, path: str, root: str, max_depth: int = 1, classes: DataFrame | None = None) -> DataFrame:
    """Add ``class`` and ``label`` to image paths below ``root``.

    The class is the first folder below the root; files deeper than ``max_depth`` folders, hidden files and other
    endings are left out. Labels number the sorted class names, or follow ``classes`` (class, label) if given.
    """
    rest = F.regexp_extract(path, rf"{re.escape(root.rstrip('/'))}/(.*)$", 1)
    parts = F.split(rest, "/")
    placed = files.withColumn("_parts", parts).withColumn("class", F.get("_parts", F.lit(0)))
    name = F.element_at("_parts", -1)
    ending = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    kept = placed.filter(
        (F.size("_parts") >= 2) & (F.size("_parts") <= max_depth + 1) & ~name.startswith(".") & ending.isin(EXTENSIONS)
    ).drop("_parts")
    if classes is None:
        ranks = ordered_prefix(cut_lineage(kept.select("class").distinct()), "class", index="label")
    else:
        ranks = classes.select("class", F.col("label").cast("long").alias("label"))
    return checked_lookup(kept, ranks, ["class"], [path], how="inner")


def read_image_folder(spark: SparkSession, root: str, max_depth: int = 1, classes: DataFrame | None = None) -> DataFrame:
    """(path, class, label, height, width, channels, pixels) with pixels in height, width, RGB order."""
    raw = spark.read.format("image").option("recursiveFileLookup", True).option("dropInvalid", True).load(root)
    flat = raw.select(
        F.col("image.origin").alias("path"), F.col("image.height").alias("height"), F.col("image.width").alias("width"),
        F.col("image.nChannels").alias("channels"), F.col("image.data").alias("_data"),
    )
    labelled = label_paths(flat, "path", root, max_depth, classes)
    return labelled.withColumn("pixels", _rgb(F.col("_data"), F.col("channels"))).drop("_data")


def read_class_list(spark: SparkSession, path: str) -> DataFrame:
    """(class, label, text) of a class list: first word per line, numbered by line."""
    kept = numbered_lines(spark, path).filter(F.trim("line") != "")
    return kept.select(F.regexp_extract("line", r"^(\S+)", 1).alias("class"), F.col("number").alias("label"), F.col("line").alias("text"))


def _rgb(data: Column, channels: Column) -> Column:
    """Unsigned bytes in blue-green-red order to an RGB array of doubles."""

    @F.pandas_udf("array<double>")
    def convert(bytes_: pd.Series, depth: pd.Series) -> pd.Series:
        out = []
        for raw, count in zip(bytes_, depth, strict=True):
            cells = np.frombuffer(raw, dtype=np.uint8).reshape(-1, count)
            if count >= 3:
                cells = cells[:, [2, 1, 0, *range(3, count)]]
            out.append(cells.ravel().astype(float))
        return pd.Series(out)

    return convert(data, channels)


def split_records(files: DataFrame, key: str, content: str, length: int, skip: int = 0, per_batch: int = 4096) -> DataFrame:
    """Cut file contents into records of ``length`` bytes after ``skip`` header bytes: (key, index, record)."""
    kind = files.schema[key].dataType.simpleString()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, raw in zip(batch[key], batch[content], strict=True):
                count = (len(raw) - skip) // length
                for start in range(0, count, per_batch):
                    numbers = np.arange(start, min(count, start + per_batch))
                    rows = [bytes(raw[skip + i * length : skip + (i + 1) * length]) for i in numbers]
                    yield pd.DataFrame({key: [name] * len(rows), "index": numbers, "record": rows})

    return files.select(key, content).mapInPandas(cut, f"`{key}` {kind}, `index` long, record binary")


def bytes_to_array(record: Column) -> Column:
    """Unsigned byte values as an array of doubles."""
    return unsigned_bytes(record)


def read_idx(spark: SparkSession, images: str, labels: str, size: int = 784) -> DataFrame:
    """Digit images in IDX files: (file, index, label, pixels); headers of 16 and 8 bytes are skipped.

    Image and label files are paired by the order of their names, records by their number in the file. Files are read by byte range.
    """

    def records(path: str, length: int, skip: int) -> DataFrame:
        named = cut_lineage(numbered_files(list_files(spark, path).select("path")))
        return checked_lookup(read_records(spark, path, length, skip), named, ["path"], ["index"], how="inner").select("file", "index", "record")

    pictures, answers = records(images, size, 16), records(labels, 1, 8)
    digit = F.conv(F.hex("record"), 16, 10).cast("int")
    # Both sides grow with the files, which a plan can't see from the rows of file ranges: neither is to be broadcast.
    return pictures.select("file", "index", bytes_to_array(F.col("record")).alias("pixels")).hint("merge").join(
        answers.select("file", "index", digit.alias("label")), ["file", "index"]
    )


def colour_record(record: Column, height: int = 32, width: int = 32) -> dict[str, Column]:
    """A label byte and three colour planes as label and pixels in height, width, channel order."""
    area = height * width
    body = bytes_to_array(record)
    places = F.sequence(F.lit(0), F.lit(3 * area - 1))
    pixels = let(F.col("_body"), lambda x: F.transform(places, lambda p: F.get(x, 1 + (p % 3) * area + F.floor(p / 3).cast("int"))))
    return {"_body": body, "label": F.get(F.col("_body"), F.lit(0)).cast("int"), "pixels": pixels}


def with_colour_pixels(df: DataFrame, record: str, height: int = 32, width: int = 32) -> DataFrame:
    out = df
    for name, value in colour_record(F.col(record), height, width).items():
        out = out.withColumn(name, value)
    return out.drop("_body")


def read_colour_records(spark: SparkSession, path: str) -> DataFrame:
    """Fixed-length colour records: (path, index, label, pixels)."""
    return with_colour_pixels(read_records(spark, path, 1 + 3 * 32 * 32), "record").drop("record")


COCO_SCHEMA = """images array<struct<id: bigint, coco_url: string>>,
    annotations array<struct<id: bigint, image_id: bigint, category_id: bigint, area: double, bbox: array<double>>>,
    categories array<struct<id: bigint>>"""


def coco_boxes(document: DataFrame) -> DataFrame:
    """Boxes of a parsed annotation document: (image_id, file, annotation_id, class, x, y, w, h).

    Boxes with no area are dropped, and with them images without any box; classes are numbered in file order.
    """
    images = document.select(F.explode("images").alias("i")).select(
        F.col("i.id").alias("image_id"), F.array_join(F.slice(F.split("i.coco_url", "/"), -2, 2), "/").alias("file")
    )
    notes = document.select(F.explode("annotations").alias("a")).filter(F.col("a.area") > 0).select(
        F.col("a.id").alias("annotation_id"), F.col("a.image_id").alias("image_id"), F.col("a.category_id").alias("category_id"),
        *[F.get("a.bbox", F.lit(k)).alias(n) for k, n in enumerate("xywh")],
    )
    classes = document.select(F.posexplode("categories").alias("class", "c")).select("class", F.col("c.id").alias("category_id"))
    classed = checked_lookup(notes, classes, ["category_id"], ["annotation_id"], how="inner")
    located = checked_lookup(classed, images, ["image_id"], ["annotation_id"], how="inner")
    return located.select("image_id", "file", "annotation_id", "class", *"xywh")


def read_coco(spark: SparkSession, path: str) -> DataFrame:
    return coco_boxes(spark.read.schema(COCO_SCHEMA).json(path, multiLine=True))


def detection_index(text: DataFrame, column: str, class_at: int, box_at: int) -> DataFrame:
    """A JSON map from image name to numbers: (image, class, x, y, w, h) by fixed positions."""
    entries = text.select(F.explode(F.from_json(column, "map<string, array<float>>")).alias("image", "n"))
    return entries.select(
        "image", F.get("n", F.lit(class_at)).cast("long").alias("class"),
        *[F.get("n", F.lit(box_at + k)).cast("double").alias(c) for k, c in enumerate("xywh")],
    )


def read_detection_index(spark: SparkSession, path: str, class_at: int = 4, box_at: int = 5) -> DataFrame:
    """``class_at=0, box_at=1`` reads the other known layout, whose images are all 256 x 256."""
    return detection_index(spark.read.text(path, wholetext=True), "value", class_at, box_at)


def digits_from_name(name: Column, length: int = 6) -> Column:
    """Digits of a file name without its ending, padded to ``length`` with 11."""
    stem = F.regexp_replace(F.element_at(F.split(name, "/"), -1), r"\.[^.]*$", "")
    places = F.sequence(F.lit(1), F.lit(length))
    return let(stem, lambda s: F.transform(
        places, lambda i: F.when(i <= F.length(s), F.substring(s, i, F.lit(1)).cast("int")).otherwise(F.lit(MISSING_DIGIT))
    ))
