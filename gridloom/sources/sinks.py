"""Results to files."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators.batching import export_matrix

JSON_CLASSES = 5
#: Folders that a task remembers to have made.
FOLDERS = 10_000


def write_matrix(df: DataFrame, path: str, data: list[str], labels: list[str]) -> None:
    """Flattened records as parquet with the arrays ``data`` and ``labels``."""
    export_matrix(df, data, labels).select("data", "labels").write.mode("overwrite").parquet(path)


def classes_json(classes: Column) -> Column:
    """JSON text of the five most probable of an ordered (class, prob) array."""
    best = F.transform(
        F.slice(classes, 1, JSON_CLASSES), lambda s: F.struct(s["class"].alias("className"), s["prob"].alias("probability"))
    )
    return F.to_json(best)


def write_predictions(df: DataFrame, path: str, key: str, classes: str) -> None:
    df.select(key, classes_json(F.col(classes)).alias("classes")).write.mode("overwrite").json(path)


def append_metrics(df: DataFrame, path: str) -> None:
    """Append (name, value, unit, ts) rows to a metric log, one folder per name."""
    df.write.mode("append").partitionBy("name").parquet(path)


def write_files(df: DataFrame, folder: str, name: str, content: str) -> None:
    """One file per row below ``folder``: ``name`` is its path there, ``content`` its bytes.

    Tasks write through Arrow's file systems (local, HDFS, S3 and others). A repeated attempt writes the same file again.
    """

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        made = set()
        for batch in batches:
            for row in batch.to_pylist():
                place = f"{root}/{row['name']}"
                if (parent := place.rpartition("/")[0]) not in made:
                    store.create_dir(parent, recursive=True)
                    # A name may have a folder of its own, so few are remembered.
                    made = made if len(made) < FOLDERS else set()
                    made.add(parent)
                with store.open_output_stream(place) as out:
                    out.write(row["content"])
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]}, schema=pa.schema([("n", pa.int64())]))

    rows = df.select(F.col(name).alias("name"), F.col(content).cast("binary").alias("content"))
    rows.mapInArrow(write, "n long").agg(F.sum("n")).collect()
