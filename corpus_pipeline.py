"""From raw documents to a training mix: five stages, each applying one operator to what the stage before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import decontaminate, mixing, pii, quality, simhash
from gridloom.llm.common import table
from gridloom.llm.queries import quality_model
from gridloom.session import cut_lineage, ship_package


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    ship_package(spark)
    return quality.keep_good(docs, quality_model(spark, sf_dir))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest doc_id."""
    ship_package(spark)
    return simhash.deduplicate(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a copy of a benchmark item go."""
    ship_package(spark)
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def private_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal identifiers are replaced by their kind."""
    ship_package(spark)
    return pii.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document gets its rate and its number of copies in the mix."""
    ship_package(spark)
    return mixing.mix(docs, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), mixing.TARGETS)


STAGES = [
    ("quality", quality_stage),
    ("near duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("private data", private_data_stage),
    ("mixing", mixing_stage),
]

# Hashes, models and alignments have no SQL form; the tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. Each result but the last is written and read again, as between separate jobs."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = cut_lineage(docs)
    return docs
