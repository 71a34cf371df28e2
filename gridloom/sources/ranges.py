"""Files that are read in pieces by many tasks: fixed-length records by byte range, numbered lines by split."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.operators.lookup import checked_lookup
from gridloom.operators.ordering import ordered_prefix
from gridloom.session import cut_lineage

RANGE_BYTES = 8 << 20
#: Beyond so many ranges a task reads several, one after another.
MOST_TASKS = 20_000
# Schemes that Arrow's file systems open; files of others are read whole by Spark.
RANGED = frozenset({"file", "hdfs", "s3", "s3a", "gs", "gcs", "abfs", "abfss"})


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of all files; contents are not read."""
    return spark.read.format("binaryFile").load(path).select("path", "length")


def numbered_files(files: DataFrame) -> DataFrame:
    """``files`` with ``file``, the place of each path in the order of the names."""
    return ordered_prefix(files, "path", index="file")


def open_path(path: str) -> tuple:
    """The file system of a path and the place in it."""
    import pyarrow.fs as fs

    scheme, rest = path.split(":", 1)
    # Spark writes file:/x, Arrow wants file:///x; the s3a connector of Hadoop is plain s3 elsewhere.
    uri = f"file:///{rest.lstrip('/')}" if scheme == "file" else f"{'s3' if scheme == 's3a' else scheme}:{rest}"
    return fs.FileSystem.from_uri(uri)


def read_records(spark: SparkSession, path: str, length: int, skip: int = 0, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, index, record): records of ``length`` bytes behind ``skip`` header bytes; a shorter rest at the end is left out.

    Files are listed with their sizes, cut into ranges of about ``range_bytes``, and the ranges are dealt to all tasks, so one large
    file is read by many. ``index`` counts within the file. Stores that only Spark can open are read file by file.
    """
    files = list_files(spark, path)
    per_range = max(1, range_bytes // length)
    total = F.greatest(F.floor((F.col("length") - skip) / length), F.lit(0)).cast("long")
    spans = files.withColumn("_n", total).where("_n > 0").select("path", "_n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / per_range).cast("long"))).alias("_r"))
    ranges = spans.select("path", (F.col("_r") * per_range).alias("first"), F.least(F.lit(per_range), F.col("_n") - F.col("_r") * per_range).alias("n"))
    ranged = F.regexp_extract("path", r"^([a-z0-9]+):", 1).isin(sorted(RANGED))
    # A given number of partitions, as ranges are tiny rows that adaptive execution would put into one task.
    tasks = min(max(ranges.count(), 1), MOST_TASKS)
    near = ranges.where(ranged).repartition(tasks, "path", "first").mapInArrow(_range_reader(length, skip), "path string, index long, record binary")
    if not files.where(~ranged).limit(1).count():
        return near
    whole = spark.read.format("binaryFile").load(path).select("path", "content").where(~ranged)
    return near.union(whole.mapInArrow(_whole_reader(length, skip, per_range), "path string, index long, record binary"))


def _batch(path: str, first: int, data: bytes, length: int) -> pa.RecordBatch:
    n = len(data) // length
    records = pa.Array.from_buffers(pa.binary(length), n, [None, pa.py_buffer(data[: n * length])]).cast(pa.binary())
    numbers = pa.array(range(first, first + n), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([path] * n, pa.string()), numbers, records], names=["path", "index", "record"])


def _range_reader(length: int, skip: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                system, place = open_path(row["path"])
                with system.open_input_file(place) as source:
                    data = source.read_at(row["n"] * length, skip + row["first"] * length)
                if len(data) < row["n"] * length:
                    raise OSError(f"{row['path']} became shorter while it was read")
                yield _batch(row["path"], row["first"], data, length)

    return read


def _whole_reader(length: int, skip: int, per_batch: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                step = per_batch * length
                for at in range(skip, len(row["content"]) - length + 1, step):
                    yield _batch(row["path"], (at - skip) // length, row["content"][at : at + step], length)

    return read


def unsigned_bytes(record: Column) -> Column:
    """Unsigned byte values as an array of doubles, a whole batch at once."""

    @F.arrow_udf("array<double>")
    def convert(values: pa.Array) -> pa.Array:
        values = values.cast(pa.binary())
        offsets = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1]
        data = values.buffers()[2]
        cells = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].astype(np.float64) if data is not None else np.zeros(0)
        made = pa.ListArray.from_arrays(pa.array(offsets - offsets[0], pa.int32()), pa.array(cells))
        return pc.if_else(values.is_valid(), made, None) if values.null_count else made

    return convert(record)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, number, line): the lines of text files with their numbers from 0 within each file; the line end is not part of a line.

    A file is read in splits. Every split counts its lines, the counts before a split are summed per file (one row a split), and a line's
    number is that sum and its place in its split. No file passes through one task.
    """
    raw = spark.read.option("lineSep", "\n").text(path)
    place = F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))
    # Rows of a split stand together in a task, so their ids are consecutive; written, they stay what they are.
    lines = cut_lineage(raw.select(place.alias("split"), F.monotonically_increasing_id().alias("at"), F.regexp_replace("value", "\r$", "").alias("line")))
    counts = lines.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    earlier = Window.partitionBy("split.path").orderBy("split.start").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut_lineage(counts.select("split", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")))
    found = checked_lookup(lines, starts, ["split"], ["at"], how="inner")
    return found.select(F.col("split.path").alias("path"), (F.col("before") + F.col("at") - F.col("first")).alias("number"), "line")

