"""Arrays in long form: one row per cell, axes as key columns. For work that crosses rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators.lookup import checked_lookup
from gridloom.session import cut_lineage


def explode_rows(df: DataFrame, array: str, keys: list[str], index: str = "pos", value: str = "v") -> DataFrame:
    """One row per array element.

    The inner form of explode makes the optimizer test the array's size below it, which evaluates a computed
    array (a tokeniser, say) a second and third time; the outer form with a filter above does not.
    """
    out = df.select(*keys, F.posexplode_outer(array).alias(index, value))
    return out.filter(F.col(index).isNotNull())


def explode_cells(df: DataFrame, array: str, keys: list[str], index: str = "pos", value: str = "v") -> DataFrame:
    """Packed rows to cells of doubles."""
    return explode_rows(df, array, keys, index, value).withColumn(value, F.col(value).cast("double"))


def pack_cells(df: DataFrame, keys: list[str], index: str = "pos", value: str = "v", name: str = "packed") -> DataFrame:
    """Cells back to one array per key; the group is one array, so its size is that of a record."""
    packed = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(index, value))).alias("_cells"))
    return packed.select(*keys, F.transform("_cells", lambda s: s[value]).alias(name))


def to_grid(df: DataFrame, width: int, index: str = "pos") -> DataFrame:
    """Reshape a flat axis to (i, j) with ``width`` columns."""
    return df.withColumn("i", F.floor(F.col(index) / width).cast("int")).withColumn(
        "j", (F.col(index) % width).cast("int")
    )


def reduce_axes(cells: DataFrame, keep: list[str], value: str = "v") -> DataFrame:
    """Sum, mean, extremes, product, L1/L2 norm and zero counts over all axes that are not kept."""
    v = F.col(value)
    return cells.groupBy(*keep).agg(
        F.sum(v).alias("sum"),
        F.avg(v).alias("mean"),
        F.max(v).alias("max"),
        F.min(v).alias("min"),
        F.product(v).alias("prod"),
        F.sum(F.abs(v)).alias("norm1"),
        F.sqrt(F.sum(v * v)).alias("norm2"),
        F.count_if(v != 0).alias("nonzero"),
        F.bool_and(v != 0).alias("all"),
        F.bool_or(v != 0).alias("any"),
        (~F.bool_or(v != 0)).alias("none"),
    )


def arg_extreme(cells: DataFrame, keep: list[str], axis: str, value: str = "v") -> DataFrame:
    """Index along ``axis`` of the first largest and first smallest cell."""
    return cells.groupBy(*keep).agg(
        F.max_by(axis, F.struct(F.col(value), -F.col(axis))).alias("arg_max"),
        F.min_by(axis, F.struct(F.col(value), F.col(axis))).alias("arg_min"),
    )


def matmul(
    a: DataFrame, b: DataFrame, row: str, inner: str, column: str, batch: list[str] | None = None, value: str = "v"
) -> DataFrame:
    """Product of ``a(row, inner, v)`` and ``b(inner, column, v)``; ``batch`` keys multiply slice by slice.

    With a batch key both sides are co-partitioned on it. Without one the inner axis has few values, so a plain
    shuffle on it would use few tasks: a small right matrix is broadcast after a check of its size, a larger
    one is joined with the left side salted by its row.
    """
    batch = batch or []
    left = a.select(*batch, row, inner, F.col(value).alias("_a"))
    right = b.select(*batch, inner, column, F.col(value).alias("_b"))
    pairs = left.join(right, [*batch, inner]) if batch else checked_lookup(left, cut_lineage(right), [inner], [row], how="inner")
    return pairs.groupBy(*batch, row, column).agg(F.sum(F.col("_a") * F.col("_b")).alias(value))


def gram(df: DataFrame, array: str) -> DataFrame:
    """``X'X`` of packed rows as (i, j, v): one partial matrix per task, then a sum by cell.

    The cells of a row are never paired in a join; the shuffle carries width*width cells per task.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            column = batch.column(0)
            block = np.asarray(column.flatten(), dtype=np.float64).reshape(batch.num_rows, -1)
            total = block.T @ block if total is None else total + block.T @ block
        if total is not None:
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays(
                [pa.array(i.ravel().astype("int32")), pa.array(j.ravel().astype("int32")), pa.array(total.ravel())],
                names=["i", "j", "v"],
            )

    parts = df.select(array).mapInArrow(partial, "i int, j int, v double")
    return parts.groupBy("i", "j").agg(F.sum("v").alias("v"))


def apply_stats(cells: DataFrame, stats: DataFrame, axes: list[str], spread_by: list[str]) -> DataFrame:
    """Join per-axis statistics to every cell: arithmetic with shape broadcasting.

    The statistics are written first, so that checking their size does not compute them twice.
    """
    return checked_lookup(cells, cut_lineage(stats), axes, spread_by, how="inner")


def to_sparse(cells: DataFrame, value: str = "v") -> DataFrame:
    return cells.filter(F.col(value) != 0)


def pool(
    cells: DataFrame, keys: list[str], kernel: tuple[int, int], stride: tuple[int, int], size: tuple[int, int],
    power: int = 2, padding: tuple[int, int] = (0, 0), value: str = "v",
) -> DataFrame:
    """Max, average and Lp pooling over an (i, j) grid of ``size``.

    A cell belongs to at most ``ceil(kernel/stride)`` windows per axis; when kernel equals stride it belongs
    to one and nothing is replicated. The average divides by the full kernel (padding counts as zero).
    """

    def windows(axis: Column, k: int, s: int, n: int, p: int) -> Column:
        last = (n + 2 * p - k) // s
        first_window = F.ceil((axis + p - (k - 1)) / F.lit(s)).cast("int")
        last_window = F.floor((axis + p) / F.lit(s)).cast("int")
        start, stop = F.greatest(F.lit(0), first_window), F.least(F.lit(last), last_window)
        return F.when(start <= stop, F.sequence(start, stop)).otherwise(F.array().cast("array<int>"))

    if kernel == stride and padding == (0, 0):
        placed = cells.withColumn("oi", F.floor(F.col("i") / stride[0]).cast("int")).withColumn(
            "oj", F.floor(F.col("j") / stride[1]).cast("int")
        )
        placed = placed.filter(
            (F.col("oi") < (size[0] - kernel[0]) // stride[0] + 1) & (F.col("oj") < (size[1] - kernel[1]) // stride[1] + 1)
        )
    else:
        placed = cells.withColumn("oi", F.explode(windows(F.col("i"), kernel[0], stride[0], size[0], padding[0])))
        placed = placed.withColumn("oj", F.explode(windows(F.col("j"), kernel[1], stride[1], size[1], padding[1])))
    v = F.col(value)
    return placed.groupBy(*keys, "oi", "oj").agg(
        F.max(v).alias("max_pool"),
        (F.sum(v) / F.lit(kernel[0] * kernel[1])).alias("avg_pool"),
        F.pow(F.sum(F.pow(F.abs(v), F.lit(float(power)))), F.lit(1.0 / power)).alias("lp_pool"),
    )


def global_pool(cells: DataFrame, keys: list[str], power: int = 2, value: str = "v") -> DataFrame:
    v = F.col(value)
    return cells.groupBy(*keys).agg(
        F.max(v).alias("max_pool"),
        F.avg(v).alias("avg_pool"),
        F.pow(F.sum(F.pow(F.abs(v), F.lit(float(power)))), F.lit(1.0 / power)).alias("lp_pool"),
    )


def batch_norm(cells: DataFrame, channel: str, spread_by: list[str], gamma: float = 1.0, beta: float = 0.0,
               epsilon: float = 1e-5, value: str = "v") -> DataFrame:
    """Normalise by the mean and population variance of each channel."""
    stats = cells.groupBy(channel).agg(F.avg(value).alias("_m"), F.var_pop(value).alias("_s"))
    joined = apply_stats(cells, stats, [channel], spread_by)
    normal = (F.col(value) - F.col("_m")) / F.sqrt(F.col("_s") + F.lit(epsilon)) * F.lit(gamma) + F.lit(beta)
    return joined.withColumn("normal", normal).drop("_m", "_s")
