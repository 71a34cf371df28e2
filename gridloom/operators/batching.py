"""Batches: numbering, length buckets, padding, stacking, splitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions import arrays as A
from gridloom.operators.lookup import checked_lookup
from gridloom.operators.ordering import hash_order, ordered_prefix
from gridloom.operators.tensors import explode_rows
from gridloom.session import cut_lineage


def length_bucket(df: DataFrame, length: str, buckets: int) -> DataFrame:
    """Add ``bucket_key``, the upper length limit of the row's bucket.

    Limits lie ``step`` apart below the longest length and never under the shortest.
    """
    low, high = df.agg(F.min(length), F.max(length)).first()
    if low is None:
        return df.withColumn("bucket_key", F.lit(None).cast("int"))
    step = max((1 + high - low) // buckets, 1)
    keys = sorted({max(high - (buckets - i - 1) * step, low) for i in range(buckets)})
    bucket = F.lit(keys[-1])
    for limit in reversed(keys[:-1]):
        bucket = F.when(F.col(length) <= limit, F.lit(limit)).otherwise(bucket)
    return df.withColumn("bucket_key", bucket)


def bucket_batches(df: DataFrame, length: str, buckets: int, size: int, key: str, seed: int | None = None) -> DataFrame:
    """Fixed-bucket sampler: batches hold rows of one length bucket in the order (length, key).

    With ``seed`` the rows of a bucket are dealt to its batches in random order, and ``position`` is the place of the batch
    among all batches in random order.
    """
    if seed is not None:
        keyed = length_bucket(df, length, buckets).withColumn("_order", hash_order(seed, key))
        placed = ordered_prefix(keyed, "_order", key, within=["bucket_key"], index="_row").drop("_order")
        placed = placed.withColumn("batch_no", F.floor(F.col("_row") / size)).withColumn("pos", F.col("_row") % size).drop("_row")
        named = placed.select("bucket_key", "batch_no").distinct().withColumn("_batch", F.struct("bucket_key", "batch_no"))
        order = ordered_prefix(cut_lineage(named.withColumn("_order", hash_order(seed, "bucket_key", "batch_no"))), "_order", "batch_no", index="position")
        return checked_lookup(placed.withColumn("_batch", F.struct("bucket_key", "batch_no")), order.select("_batch", "position"), ["_batch"], [key]).drop("_batch")
    placed = ordered_prefix(length_bucket(df, length, buckets), length, key, within=["bucket_key"], index="_row")
    return placed.withColumn("batch_no", F.floor(F.col("_row") / size)).withColumn("pos", F.col("_row") % size).drop("_row")


def pad_batches(df: DataFrame, array: str, batch: str, value: Column, width: int | None = None,
                target: str = "padded") -> DataFrame:
    """Pad arrays to the longest of their batch, or to ``width`` if given (an error when one is longer)."""
    size = F.size(array)
    if width is not None:
        checked = F.when(size > width, F.raise_error(F.lit("array longer than the padding size"))).otherwise(size)
        return df.withColumn("valid_length", checked.cast("int")).withColumn(target, A.pad(F.col(array), value, width))
    widest = F.max(size).over(Window.partitionBy(batch))
    return (
        df.withColumn("valid_length", size)
        .withColumn("_width", widest)
        .withColumn(target, A.pad(F.col(array), value, F.col("_width")))
        .drop("_width")
    )


def unpad(array: Column, valid_length: Column) -> Column:
    return F.slice(array, F.lit(1), valid_length)


def stack(df: DataFrame, array: str, batch: str, pos: str) -> DataFrame:
    """One row per batch with the records stacked in order; all must have the same size.

    A batch holds a bounded number of records, so the collected list is bounded too.
    """
    sizes = F.size(array)
    stacked = df.groupBy(batch).agg(
        F.min(sizes).alias("_lo"),
        F.max(sizes).alias("_hi"),
        F.sort_array(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(array).alias("x")))).alias("_rows"),
    )
    rows = F.when(F.col("_lo") != F.col("_hi"), F.raise_error(F.lit("records of a batch differ in shape"))).otherwise(
        F.transform("_rows", lambda s: s["x"])
    )
    return stacked.select(batch, rows.cast(f"array<{df.schema[array].dataType.simpleString()}>").alias("stacked"))


def unstack(df: DataFrame, stacked: str, batch: str) -> DataFrame:
    return explode_rows(df, stacked, [batch], value="record")


def split_slices(pos: Column, size: Column, parts: int, even: bool = False) -> Column:
    """Slice number of a record when a batch is cut into ``parts``; the last slice may be short."""
    step = F.ceil(size / F.lit(parts))
    slice_no = F.floor(pos / step).cast("int")
    if even:
        return F.when(size % parts != 0, F.raise_error(F.lit("batch does not split evenly")).cast("int")).otherwise(slice_no)
    return slice_no


def export_matrix(df: DataFrame, data: list[str], labels: list[str]) -> DataFrame:
    """Each record's columns flattened and concatenated into one data and one label array."""

    def joined(columns: list[str]) -> Column:
        parts = []
        for name in columns:
            kind = df.schema[name].dataType.simpleString()
            parts.append(F.col(name).cast("array<double>") if kind.startswith("array") else F.array(F.col(name).cast("double")))
        return F.concat(*parts)

    return df.withColumn("data", joined(data)).withColumn("labels", joined(labels))


def first_seen_index(df: DataFrame, column: str, order: str) -> DataFrame:
    """(value, index) with indices in the order of first appearance."""
    firsts = df.groupBy(F.col(column).alias("value")).agg(F.min(order).alias("_first"))
    return ordered_prefix(cut_lineage(firsts), "_first", "value", index="index").drop("_first")


def attach_index(df: DataFrame, column: str, mapping: DataFrame, spread_by: list[str], strict: bool = False) -> DataFrame:
    """Add the mapped index of ``column``; ``strict`` turns an unmapped value into an error."""
    named = mapping.select(F.col("value").alias(column), F.col("index").alias(f"{column}_index"))
    out = checked_lookup(df, named, [column], spread_by)
    if strict:
        index = F.col(f"{column}_index")
        missing = F.raise_error(F.concat(F.lit(f"{column}: unmapped value "), F.coalesce(F.col(column), F.lit("null"))))
        out = out.withColumn(f"{column}_index", F.when(index.isNull(), missing.cast("long")).otherwise(index))
    return out
