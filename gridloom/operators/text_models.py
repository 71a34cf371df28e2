"""Supervised text classification with MLlib and word vectors."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, NGram, SQLTransformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import arrays as A
from gridloom.operators import vocabulary as V
from gridloom.operators import word_vectors as W
from gridloom.operators.ordering import ordered_prefix
from gridloom.session import cut_lineage, scratch_path

LEARNING_RATE = 0.025
#: What the tasks learned is put together so many times an epoch.
MERGES = 4
#: Words up to this many, and 200 MB, are looked up in the tasks.
SHARED_WORDS = 4_000_000


def fit_classifier(df: DataFrame, tokens: str, label: str, word_ngrams: int = 2, buckets: int = 1 << 16, epochs: int = 20,
                   regularisation: float = 1e-3) -> PipelineModel:
    """Hashed word n-grams into a softmax regression; returns the fitted stages."""
    columns = [tokens, *[f"_ngram{n}" for n in range(2, word_ngrams + 1)]]
    stages = [NGram(n=n, inputCol=tokens, outputCol=f"_ngram{n}") for n in range(2, word_ngrams + 1)]
    joined = SQLTransformer(statement=f"SELECT *, concat({', '.join(columns)}) AS _grams FROM __THIS__")
    hashing = HashingTF(inputCol="_grams", outputCol="_tf", numFeatures=buckets)
    learner = LogisticRegression(
        featuresCol="_tf", labelCol=label, maxIter=epochs, regParam=regularisation, probabilityCol="_prob", rawPredictionCol="_raw",
        predictionCol="_pred",
    )
    return Pipeline(stages=[*stages, joined, hashing, learner]).fit(df)


def classify(df: DataFrame, model: PipelineModel, names: list[str], k: int) -> DataFrame:
    """Add ``top``: the ``k`` best (class, prob) pairs."""
    scored = model.transform(df)
    pairs = A.top_k(F.array(*[F.lit(n) for n in names]), vector_to_array("_prob"), k)
    return scored.withColumn("top", pairs).select(*df.columns, "top")


class WordVectors:
    """Fitted word vectors, kept as a table."""

    def __init__(self, table: DataFrame):
        self._table = table

    def getVectors(self) -> DataFrame:  # noqa: N802 (as in MLlib)
        """(word, vector), one row per word."""
        return self._table


def fit_word_vectors(df: DataFrame, tokens: str, size: int = 32, window: int = 5, min_count: int = 10, epochs: int = 1,
                     partitions: int | None = None, seed: int = 1) -> WordVectors:
    """Skip-gram word vectors with hierarchical softmax, learned in as many partitions as the cluster has cores unless told otherwise.

    Steps, windows, tree and learning rate are those of MLlib's Word2Vec: every partition goes through its rows from the same
    vectors, and what they learned is put together. There the tasks of an executor write to one copy of the vectors, hold
    each other up and depend on timing; here every task has its own copy and takes the steps of ``word_vectors.CENTRES`` centre
    words at once, so that time grows with the words divided by the cores. As a task alone sees little, an epoch is put
    together ``MERGES`` times, and by ``_merged`` instead of by means. Through the driver go the words and counts once, and the vectors each time.
    """
    spark = df.sparkSession
    partitions = partitions or spark.sparkContext.defaultParallelism
    counts = V.token_counts(df, tokens).filter((F.col("freq") >= min_count) & F.col("token").isNotNull())
    words = cut_lineage(ordered_prefix(cut_lineage(counts), "freq", "token", index="id", descending=True))
    freq = words.select("id", "freq").toArrow().sort_by("id")["freq"].to_numpy()
    if not len(freq):
        raise ValueError("no word is frequent enough: the vocabulary is empty")
    tree = spark.sparkContext.broadcast(W.huffman_tree(freq))
    rows = V.known_ids(df, tokens, words, max_rows=SHARED_WORDS).select(F.col("ids").cast("array<int>").alias("ids"))
    path = scratch_path(spark, "sentences")
    numbered = rows.withColumn("row", F.monotonically_increasing_id())
    numbered.withColumn("part", F.pmod("row", F.lit(MERGES))).write.partitionBy("part").parquet(path)
    dealt = spark.read.schema("ids array<int>, row long, part int").parquet(path)
    total, learned = epochs * int(freq.sum()) + 1, None
    for merge in range(epochs * MERGES):
        before = V._shared_table(df, learned.toArrow()) if learned is not None else None
        passed = merge * (total - 1) // (epochs * MERGES)
        learner = _learner(tree, before, size, window, [seed, merge], partitions, passed, total)
        # Rows are dealt out and ordered by their number, so that the same input gives the same vectors.
        some = dealt.where(F.col("part") == merge % MERGES).repartition(partitions, "row").sortWithinPartitions("row").select("ids")
        learned = _merged(some.mapInArrow(learner, "node boolean, id long, change array<float>, way double"), learned, size)
        if before is not None:
            before.destroy()
    # A word that stands alone in all its sentences keeps its first vector.
    met = learned.where("NOT node").select("id", "change")
    first = words.join(met, "id", "left").select(F.col("token").alias("word"), "change", _first(size, seed)("id").alias("first"))
    moved = F.when(F.col("change").isNull(), F.col("first")).otherwise(F.zip_with("first", "change", lambda a, b: a + b))
    return WordVectors(cut_lineage(first.select("word", moved.alias("vector"))).select("word", array_to_vector("vector").alias("vector")))


def _merged(found: DataFrame, learned: DataFrame | None, size: int) -> DataFrame:
    """Changes of all tasks on top of the earlier ones.

    Small changes of several tasks add up as steps do; tasks that each went all the way to where the steps lead agree on one
    such change. In between, a vector gets the part of the way that one task would have gone with the steps of all.
    """
    found = found.withColumn("new", F.lit(True))
    if learned is not None:
        found = found.unionByName(learned.withColumn("way", F.lit(0.0)).withColumn("new", F.lit(False)))
    gone, together = F.sum(-F.expm1(-F.col("way"))), -F.expm1(-F.sum("way"))
    part = F.when(gone > 0, together / gone).otherwise(1.0)
    sums = [F.sum(F.when(F.col("new"), F.col("change")[i]).otherwise(0.0)) for i in range(size)]
    old = [F.sum(F.when(~F.col("new"), F.col("change")[i]).otherwise(0.0)) for i in range(size)]
    change = F.array(*[(a + b * part).cast("float") for a, b in zip(old, sums, strict=True)])
    return cut_lineage(found.groupBy("node", "id").agg(change.alias("change")))


def _learner(tree, before, size: int, window: int, stream: list[int], partitions: int, passed: int, total: int):
    """The steps of one task; the learning rate falls in a line with the words done, as if all partitions were at the same place."""

    def rate(done: int) -> float:
        return LEARNING_RATE * max(1 - (partitions * done + passed) / total, 1e-4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = W.SkipGram(*tree.value, size, window, stream[0], [*stream, TaskContext.get().partitionId()])
        if before is not None:
            table = V._opened(before, {})
            node, ids = (table[name].to_numpy(zero_copy_only=False) for name in ("node", "id"))
            change = table["change"].flatten().to_numpy().reshape(-1, size)
            model.words[ids[~node]] += change[~node]
            model.nodes[ids[node]] += change[node]
        yield from W.learn_batches(batches, model, rate)

    return run


def _first(size: int, seed: int):
    @F.arrow_udf("array<float>")
    def first(ids: pa.Array) -> pa.Array:
        return W.vector_array(W.first_vectors(ids.to_numpy(), size, seed))

    return first


def sentiment(logits: Column) -> Column:
    """Two logits to the better of Negative and Positive with its probability."""
    return F.get(A.top_k(F.array(F.lit("Negative"), F.lit("Positive")), A.softmax(logits), 1), F.lit(0))

