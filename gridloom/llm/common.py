"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gridloom.session import cut_lineage

BUCKETS = 1_000_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def arrow_map(df: DataFrame, rows: Callable[[dict[str, list]], dict[str, list]], schema: str, at_once: int = 1 << 20) -> DataFrame:
    """Apply ``rows`` to slices of every Arrow batch, cut so that a slice holds about ``at_once`` bytes.

    ``rows`` gets and returns a dict of column lists. One row longer than ``at_once`` is a slice of its own.
    """
    target = df.sparkSession.createDataFrame([], schema).schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(target)
        for batch in batches:
            for part in _slices(batch, at_once):
                out = rows({name: part.column(i).to_pylist() for i, name in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, target)


def _slices(batch: pa.RecordBatch, at_once: int) -> Iterator[pa.RecordBatch]:
    step = max(1, int(batch.num_rows * at_once / max(1, batch.nbytes)))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def keep_rows(df: DataFrame, columns: list[str], good: Callable[..., list[bool]], at_once: int = 1 << 20) -> DataFrame:
    """The rows that are ``good`` by the values of ``columns``, whole; they go through a task in slices of a batch."""
    at = [df.columns.index(c) for c in columns]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, at_once):
                yield part.filter(pa.array(good(*(part.column(i).to_pylist() for i in at)), pa.bool_()))

    return df.mapInArrow(run, df.schema)


def replace_text(df: DataFrame, text: str, new: Callable[[str | None], str | None], at_once: int = 1 << 20) -> DataFrame:
    """All rows with ``new`` applied to their text, in slices as above."""
    at = df.columns.index(text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, at_once):
                yield part.set_column(at, part.schema.field(at), pa.array([new(t) for t in part.column(at).to_pylist()], part.schema.field(at).type))

    return df.mapInArrow(run, df.schema)


def add_columns(df: DataFrame, source: str, made: str, new: Callable[[Any], tuple], at_once: int = 1 << 20) -> DataFrame:
    """All columns but ``source``, and the columns ``made`` (a schema) as ``new`` of it, in slices as above.

    Other columns of the made ones' names are replaced.
    """
    fields = df.sparkSession.createDataFrame([], made).schema
    taken = {f.name.lower() for f in fields} | {source.lower()}
    names = [c for c in df.columns if c.lower() not in taken]
    at, kept = df.columns.index(source), [df.columns.index(c) for c in names]
    schema = StructType([*(df.schema[c] for c in names), *fields])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            for part in _slices(batch, at_once):
                columns = zip(*map(new, part.column(at).to_pylist()), strict=True)
                values = [pa.array(v, f.type) for v, f in zip(columns, list(arrow)[len(names) :], strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in kept), *values], names=arrow.names)

    return df.mapInArrow(run, schema)


def add_column(df: DataFrame, source: str, target: str, kind: str, new: Callable[[Any], Any]) -> DataFrame:
    """One column made in this way."""
    return add_columns(df, source, f"`{target}` {kind}", lambda value: (new(value),))


def fold(column: str, parts: int) -> Column:
    """crc32 of the key as text, modulo ``parts``; null for a null key."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % parts


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, training: Column, rows: int) -> tuple[DataFrame, dict[int, float]]:
    """About ``rows`` labelled documents as a written table (text, n_chars, y), half of each class where there are enough.

    ``training`` is a condition on the columns of ``labels``. Keys are drawn by hash, so a rerun draws the same.
    Also returned: for each class, labelled rows per drawn row, to restore the true proportions.
    """
    known = labels.where(training & F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("int").alias("y"))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = {y: min(1.0, rows / 2 / n) for y, n in counts.items()}
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS))
    chosen = F.lit(False)
    for y, part in share.items():
        chosen |= (F.col("y") == y) & (bucket < int(part * BUCKETS) + 1)
    # About `rows` keys by construction, so the broadcast is bounded.
    keys = known.where(chosen).dropDuplicates(["doc_id"])
    drawn = documents.select("doc_id", "text", "n_chars").join(F.broadcast(keys), "doc_id")
    drawn = drawn.select(F.coalesce("text", F.lit("")).alias("text"), F.col("n_chars").cast("long").alias("n_chars"), "y")
    return cut_lineage(drawn), {y: 1 / part for y, part in share.items()}


def own_name(*taken: Iterable[str]) -> str:
    """A column name that no table of the caller uses."""
    used = {c.lower() for names in taken for c in names}
    name = "_k"
    while name in used:
        name = f"_k{uuid.uuid4().hex}"
    return name
