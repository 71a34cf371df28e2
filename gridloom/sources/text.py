"""Text files: parallel sentences, labelled documents, labelled lines, token lists, source trees."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.text import code_lines
from gridloom.session import cut_lineage
from gridloom.sources.ranges import numbered_lines

LABEL_PREFIX = "__label__"
#: Bytes that opening a small file counts for when files are dealt to tasks.
FILE_COST = 64 << 10
# Endings by which Hadoop knows packed files.
PACKED = (".gz", ".bz2", ".deflate", ".snappy", ".lz4", ".zst")


def read_parallel(spark: SparkSession, path: str) -> DataFrame:
    """(source, target) of lines holding two tab-separated sentences."""
    parts = F.split("value", "\t")
    return spark.read.text(path).select(F.get(parts, F.lit(0)).alias("source"), F.get(parts, F.lit(1)).alias("target"))


def review_path_parts(path: Column) -> dict[str, Column]:
    """Label (1 for ``pos``), document number and score from ``.../<pos|neg>/<id>_<score>.txt``."""
    pattern = r"/(pos|neg)/(\d+)_(\d+)\.txt$"
    return {
        "label": (F.regexp_extract(path, pattern, 1) == "pos").cast("int"),
        "doc_id": F.regexp_extract(path, pattern, 2).cast("long"),
        "score": F.regexp_extract(path, pattern, 3).cast("int"),
    }


@contextmanager
def many_files(spark: SparkSession) -> Iterator[None]:
    """Jobs run inside pack small files into tasks by ``FILE_COST`` bytes for a file; the session's setting is put back behind them.

    Spark's usual cost of 4 MB makes a task of every 32 files.
    """
    name = "spark.sql.files.openCostInBytes"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, FILE_COST)
        yield
    finally:
        spark.conf.set(name, before)


def whole_files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(text, path) of all files below ``path`` whose names fit the glob ``pattern``.

    Files come as bytes, since Spark's text reader sets up a Hadoop job for each file; one that is packed by its name goes through that reader.
    """
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    if pattern.endswith(PACKED):
        files, text = reader.text(path, wholetext=True), F.col("value")
    else:
        files, text = reader.format("binaryFile").load(path), F.col("content").cast("string")
    return files.select(text.alias("text"), F.col("_metadata.file_path").alias("path"))


def read_reviews(spark: SparkSession, path: str) -> DataFrame:
    """One file per document below ``pos`` and ``neg`` folders: (text, label, doc_id, score)."""
    located = whole_files(spark, path, "*_*.txt").filter(F.col("path").rlike(r"/(pos|neg)/\d+_\d+\.txt$"))
    with many_files(spark):
        return cut_lineage(located.select("text", *[c.alias(n) for n, c in review_path_parts(F.col("path")).items()]))


def labelled_line(line: Column) -> dict[str, Column]:
    """Labels marked by a prefix at the start of a line, and the rest of the line."""
    mark = rf"^((?:{LABEL_PREFIX}\S+\s*)*)"
    labels = F.regexp_extract_all(F.regexp_extract(line, mark, 1), F.lit(rf"{LABEL_PREFIX}(\S+)"), F.lit(1))
    return {"labels": labels, "text": F.regexp_replace(line, mark, "")}


def read_labelled_lines(spark: SparkSession, path: str) -> DataFrame:
    parts = labelled_line(F.col("value"))
    return spark.read.text(path).select(*[c.alias(n) for n, c in parts.items()])


def read_token_list(spark: SparkSession, path: str) -> DataFrame:
    """(token, id) of a vocabulary file with one token per line; ids follow the line order."""
    named = numbered_lines(spark, path).select(F.trim("line").alias("token"), F.col("number").alias("id"))
    return named.filter(F.col("token") != "")


def read_code(spark: SparkSession, path: str, suffix: str = ".java") -> DataFrame:
    """Lines of all source files of a tree: (path, lines); blank lines and trailing blanks dropped."""
    with many_files(spark):
        return cut_lineage(whole_files(spark, path, f"*{suffix}").select("path", code_lines(F.col("text")).alias("lines")))
