"""Delimited files. Schemas are declared; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str, schema: dict[str, str], partitions: int | None = None) -> DataFrame:
    """CSV with a header: columns are found by name whatever their case, values are trimmed.

    ``schema`` maps the wanted columns to types; others are not parsed. Files ending in ``.gz`` are read by
    their suffix, one task per file, so ``partitions`` spreads the rows afterwards.
    """
    return _named(spark, path, schema, partitions, sep=",")


def read_tsv(spark: SparkSession, path: str, schema: dict[str, str], partitions: int | None = None) -> DataFrame:
    """Tab-separated with a header and without any quoting."""
    return _named(spark, path, schema, partitions, sep="\t", quote="", escape="")


def _named(spark, path, schema, partitions, **options) -> DataFrame:
    raw = spark.read.options(
        header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, **options
    ).csv(path)
    found = {name.strip().lower(): name for name in raw.columns}
    missing = [name for name in schema if name.lower() not in found]
    if missing:
        raise ValueError(f"columns not in the header: {missing}")
    out = raw.select(*[F.col(f"`{found[n.lower()]}`").cast(kind).alias(n.lower()) for n, kind in schema.items()])
    return out.repartition(partitions) if partitions else out


def read_headerless_tsv(spark: SparkSession, path: str, schema: dict[str, str]) -> DataFrame:
    """Tab-separated without a header, columns by position, values trimmed."""
    ddl = ", ".join(f"`{n}` {kind}" for n, kind in schema.items())
    return spark.read.options(sep="\t", mode="FAILFAST", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True).schema(ddl).csv(path)


def write_with_usage(df: DataFrame, path: str, usage: Column) -> None:
    """Store rows by their usage (train, validation, test), one folder each."""
    df.withColumn("usage", usage).write.mode("overwrite").partitionBy("usage").parquet(path)


def read_usage(spark: SparkSession, path: str, usage: str) -> DataFrame:
    """Rows of one usage; the other folders are not read."""
    return spark.read.parquet(path).filter(F.col("usage") == usage).drop("usage")


def from_arrays(spark: SparkSession, data: list, labels: list | None = None) -> DataFrame:
    """In-memory arrays as rows (row_id, data, label); all must have the same length."""
    if labels is not None and len(data) != len(labels):
        raise ValueError("all arrays must have the same length")
    rows = [(i, list(map(float, x)) if hasattr(x, "__len__") else [float(x)], float(labels[i]) if labels is not None else None)
            for i, x in enumerate(data)]
    return spark.createDataFrame(rows, "row_id long, data array<double>, label double")
