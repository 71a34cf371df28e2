"""Streaming forms of scoring, metrics, buffers and answer checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators.scoring import Scorer, score
from gridloom.operators.series import recent
from gridloom.session import scratch_path
from gridloom.streaming.runs import run_batches


def score_stream(stream: DataFrame, scorer: Scorer, keep: list[str], guard: bool = False) -> DataFrame:
    """Score every micro-batch like a batch table."""
    return score(stream, scorer, keep, guard=guard)


def split_failures(scored: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """Write good rows and failed rows of a guarded scoring stream to two tables; (good, failed).

    Each micro-batch writes its own folder, so a repeated batch replaces itself.
    """
    spark = scored.sparkSession
    good, bad = scratch_path(spark, f"{label}-good"), scratch_path(spark, f"{label}-failed")

    def handle(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        held.filter("status = 'ok'").write.mode("overwrite").parquet(f"{good}/batch={number}")
        held.filter("status <> 'ok'").write.mode("overwrite").parquet(f"{bad}/batch={number}")
        held.unpersist()

    run_batches(scored, label, handle)
    read = spark.read.schema(scored.schema)
    return read.parquet(f"{good}/batch=*"), read.parquet(f"{bad}/batch=*")


def window_metrics(events: DataFrame, ts: str, name: str, value: str, width: str, slide: str | None = None,
                   delay: str = "10 minutes") -> DataFrame:
    """Count, mean and largest value per metric and time window; rows later than ``delay`` are dropped."""
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    return (
        events.withWatermark(ts, delay)
        .groupBy(window.alias("w"), name)
        .agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.max(value).alias("largest"))
        .select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), name, "n", "mean", "largest")
    )


def session_stream(events: DataFrame, key: str, ts: str, gap: str, delay: str = "10 minutes") -> DataFrame:
    """Sessions per key that end after ``gap`` without rows.

    With ``spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition`` set, as :func:`gridloom.session.build_session`
    does, sessions are merged inside each task before the shuffle, so that a frequent key does not send all its rows.
    """
    return (
        events.withWatermark(ts, delay)
        .groupBy(F.session_window(ts, gap).alias("s"), key)
        .agg(F.count(F.lit(1)).alias("rows"), F.max(ts).alias("last"))
        .select(key, F.col("s.start").alias("start"), "last", "rows")
    )


def answer_once(answers: DataFrame, key: str, ts: str, delay: str = "1 hour") -> DataFrame:
    """Each request id is answered once; repeated answers within ``delay`` are dropped."""
    return answers.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def recent_buffer(stream: DataFrame, label: str, key: str, ts: str, tie: str, size: int, folder: str | None = None) -> DataFrame:
    """The newest ``size`` rows per key, kept in a table that each micro-batch replaces by a new version.

    A batch first keeps its own newest rows per key, so only those meet the old version. Versions carry the
    batch number: a repeated batch rebuilds the same version from the one before. Versions older than that are deleted.
    With ``folder`` a later call, also of another process, goes on where the last one stopped.
    """
    spark = stream.sparkSession
    folder = folder or scratch_path(spark, label)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/versions")
    store = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def versions() -> list[int]:
        if not store.exists(place):
            return []
        names = (status.getPath().getName() for status in store.listStatus(place))
        # A version counts once it is whole.
        return sorted(int(n) for n in names if n.isdigit() and store.exists(_path(spark, f"{folder}/versions/{n}/_SUCCESS")))

    def read(number: int | None) -> DataFrame:
        return spark.createDataFrame([], stream.schema) if number is None else spark.read.schema(stream.schema).parquet(f"{folder}/versions/{number}")

    def handle(batch: DataFrame, number: int) -> None:
        before = [v for v in versions() if v < number]
        fresh = recent(batch, key, ts, tie, size).unionByName(read(before[-1] if before else None))
        recent(fresh, key, ts, tie, size).write.mode("overwrite").parquet(f"{folder}/versions/{number}")
        for old in before[:-1]:
            store.delete(_path(spark, f"{folder}/versions/{old}"), True)

    run_batches(stream, label, handle, folder=folder)
    return read(max(versions(), default=None))


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
