"""Queries of the operators in this subpackage: names, columns and parameters of the result tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import byte_bpe, decontaminate, mixing, multi_index, page_text, phrases, pii, quality, secrets, simhash, token_align, toxicity, warc
from gridloom.llm.common import fold, table
from gridloom.session import ship_package


def joined_spans(spans: Column) -> Column:
    """kind:start:end of an array of spans, comma-joined."""
    parts = F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string")))
    return F.array_join(parts, ",")


def span_columns(found: DataFrame, kinds: tuple[str, ...], key: str = "doc_id") -> DataFrame:
    """Counts of base spans by kind, digest of the base spans, and all spans."""
    base = F.filter("spans", lambda x: x["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda x: x["base"] & (x["kind"] == F.lit(kind)))).cast("long")

    counts = [count(kind).alias(f"n_{kind}") for kind in kinds]
    added = F.size(F.filter("spans", lambda x: ~x["base"])).cast("long").alias("n_added")
    return found.select(key, *counts, F.sha2(joined_spans(base).cast("binary"), 256).alias("base_sha256"), joined_spans(F.col("spans")).alias("spans"), added)


def op1_identifiers(spark: SparkSession, folder: str) -> DataFrame:
    return span_columns(pii.find_identifiers(table(spark, folder, "documents")), pii.KINDS)


def op2_page_text(spark: SparkSession, folder: str) -> DataFrame:
    return page_text.extract(table(spark, folder, "pages").select("page_id", "url", "html")).withColumn("n_chars", F.length("text").cast("long"))


def judged(scored: DataFrame, parts: int, rest: int, threshold: float) -> DataFrame:
    """held_out by the key's fold, and the decision at the threshold."""
    held = F.coalesce(fold("doc_id", parts) == rest, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *(c for c in scored.columns if c not in ("doc_id", "score")))


def quality_model(spark: SparkSession, folder: str) -> quality.Machine:
    """Learned from the labelled documents whose crc32(doc_id) mod 3 is not 1."""
    return quality.fit(table(spark, folder, "documents"), table(spark, folder, "labels"), fold("doc_id", 3) != 1)


def op3_quality(spark: SparkSession, folder: str) -> DataFrame:
    return judged(quality.score(table(spark, folder, "documents"), quality_model(spark, folder)), 3, 1, quality.THRESHOLD)


def op4_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    model = toxicity.fit(documents, table(spark, folder, "labels"), fold("doc_id", 4) != 2)
    return judged(toxicity.score(documents, model), 4, 2, toxicity.THRESHOLD)


def op6_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op7_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.round_trip(table(spark, folder, "pages"))


def op8_mixing(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    return mixing.mix(documents, documents, table(spark, folder, "labels"), mixing.TARGETS, columns=["doc_id"])


def op9_multi_index(spark: SparkSession, folder: str) -> DataFrame:
    return multi_index.near_duplicates(table(spark, folder, "embeddings"))


def op10_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return span_columns(secrets.find_secrets(table(spark, folder, "documents")), secrets.KINDS[:3])


def vocabulary_file(name: str) -> str:
    """The place of a published vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op11_phrases(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.collocations(table(spark, folder, "documents"))


def op12_token_align(spark: SparkSession, folder: str) -> DataFrame:
    pieces = vocabulary_file("piece_bpe_32k.model")
    aligned = token_align.align(table(spark, folder, "documents").select("doc_id", "text"), vocabulary_file("byte_bpe_50k.json"), pieces)
    digest = F.when(F.col("n_a") > 0, F.sha2(F.col("groups").cast("binary"), 256)).otherwise("").alias("groups_sha256")
    digested = aligned.select("doc_id", "n_a", "n_b", "n_groups", "n_links", digest, "pairs", "times")
    return token_align.associate(digested, token_align.b_width(pieces)).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    file = vocabulary_file("byte_bpe_50k.json")
    encoded = byte_bpe.encode(table(spark, folder, "documents").select("doc_id", "text"), file)
    sized = encoded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), "ids")
    decoded = byte_bpe.decode(sized, file, text="decoded")
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_identifiers": op1_identifiers,
    "op2_page_text": op2_page_text,
    "op3_quality": op3_quality,
    "op4_simhash": op4_simhash,
    "op5_toxicity": op5_toxicity,
    "op6_decontaminate": op6_decontaminate,
    "op7_warc": op7_warc,
    "op8_mixing": op8_mixing,
    "op9_multi_index": op9_multi_index,
    "op10_secrets": op10_secrets,
    "op11_phrases": op11_phrases,
    "op12_token_align": op12_token_align,
    "op13_byte_bpe": op13_byte_bpe,
}
ORACLE_SQL: dict[str, str] = {"op11_phrases": phrases.ORACLE_SQL}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def shipped(build: Callable) -> Callable:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            ship_package(spark)
            return build(spark, folder)

        return run

    return {name: shipped(build) for name, build in QUERIES.items()}
