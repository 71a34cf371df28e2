"""Equi-joins against a table whose size is checked before anything is broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, StringType, StructType

BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 200_000_000
SALTS = 32
#: Keys are counted by hash in so many buckets; a bucket of more rows, and of several times the mean, is spread by salts.
BUCKETS = 1 << 16
HOT_ROWS = 50_000


def row_limit(max_rows: int | None) -> int:
    return BROADCAST_ROWS if max_rows is None else max_rows


def _bytes(col: Column, kind: DataType) -> Column:
    """Approximate size of a value: text by its length, arrays by their elements, eight bytes otherwise."""
    if isinstance(kind, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(col), F.lit(0)).cast("long")
    if isinstance(kind, ArrayType):
        each = 8 if not isinstance(kind.elementType, (StringType, ArrayType, StructType)) else 64
        return F.greatest(F.size(col), F.lit(0)).cast("long") * each
    if isinstance(kind, StructType):
        return sum((_bytes(col[f.name], f.dataType) for f in kind), F.lit(0).cast("long"))
    return F.lit(8).cast("long")


def fits_broadcast(df: DataFrame, max_rows: int | None = None) -> bool:
    """True if ``df`` is small in rows and in bytes; measuring stops one row beyond the row limit."""
    limit = row_limit(max_rows)
    size = sum((_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema), F.lit(0).cast("long"))
    rows, volume = df.limit(limit + 1).agg(F.count(F.lit(1)), F.sum(size)).first()
    return rows <= limit and (volume or 0) <= BROADCAST_BYTES


def checked_lookup(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    spread_by: list[str],
    how: str = "left",
    max_rows: int | None = None,
    salts: int | None = None,
) -> DataFrame:
    """Join a big, possibly skewed left side to a table with unique keys ``on``.

    Right side small in rows and bytes: broadcast. Otherwise both sides are shuffled on the key and a salt. Only keys that
    stand in very many left rows (unmatched and null ones too) get a salt, taken from ``spread_by``, so that the rows
    of a frequent key go to ``salts`` tasks; only their right rows are copied. Without ``salts`` their number is a quarter of
    the shuffle partitions, 32 at least, so a busy key is spread wider on a larger cluster.
    """
    salts = salts or max(SALTS, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 4)
    if fits_broadcast(right, max_rows):
        return left.join(F.broadcast(right), on, how)
    salt = F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int")
    copies = F.sequence(F.lit(0), F.lit(salts - 1))
    if _hash_alike(left, right, on):
        bucket = F.pmod(F.xxhash64(*on), F.lit(BUCKETS))
        hot = _hot_buckets(left, bucket)
        if not hot:
            return left.join(right, on, how)
        salt = F.when(bucket.isin(hot), salt).otherwise(F.lit(0))
        copies = F.when(bucket.isin(hot), copies).otherwise(F.array(F.lit(0)))
    salted = left.withColumn("_salt", salt)
    return salted.join(right.withColumn("_salt", F.explode(copies)), [*on, "_salt"], how).drop("_salt")


def _hash_alike(left: DataFrame, right: DataFrame, on: list[str]) -> bool:
    """True if equal keys of both sides have equal hashes: one type, without zeros and NaNs of several forms."""
    kinds = [(left.schema[c].dataType.simpleString(), right.schema[c].dataType.simpleString()) for c in on]
    return all(a == b and "float" not in a and "double" not in a for a, b in kinds)


def _hot_buckets(left: DataFrame, bucket: Column) -> list[int]:
    """Hash buckets that hold far more rows than the others; one small row a bucket comes to the driver."""
    counts = left.groupBy(bucket.alias("_bucket")).agg(F.count(F.lit(1)).alias("_n")).collect()
    limit = max(HOT_ROWS, 4 * sum(r["_n"] for r in counts) // BUCKETS)
    return [r["_bucket"] for r in counts if r["_n"] > limit]
