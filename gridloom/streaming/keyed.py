"""Keyed state in the state store: buffers of recent rows, and answers matched to requests."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType, TimestampType

from gridloom.streaming.runs import start_table

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def newest_of_batches(df: DataFrame, key: str, ts: str, tie: str, size: int) -> DataFrame:
    """Of every Arrow batch only the newest ``size`` rows per key, as a stream or a table.

    Run before a shuffle by key, it makes a key that fills its batches as cheap as any other. Rows without a time are the oldest.
    """
    names = df.columns
    order = [("code", "ascending"), (names.index(ts), "descending"), (names.index(tie), "descending")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows <= size:
                yield batch
                continue
            code = batch.column(names.index(key)).dictionary_encode(null_encoding="encode").indices
            keys = pa.table({"code": code, "ts": batch.column(order[1][0]), "tie": batch.column(order[2][0])})
            places = pc.sort_indices(keys, sort_keys=[("code", "ascending"), ("ts", "descending"), ("tie", "descending")], null_placement="at_end").to_numpy()
            codes = code.to_numpy(zero_copy_only=False)[places]
            first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
            rank = np.arange(len(codes)) - np.repeat(first, np.diff(np.append(first, len(codes))))
            yield batch.take(pa.array(places[rank < size]))

    return df.mapInArrow(run, df.schema)


class RecentRows(StatefulProcessor):
    """The newest rows of one key as list state. Output: what each micro-batch left in the buffer of every key it touched."""

    def __init__(self, schema: StructType, key: str, ts: str, tie: str, size: int, idle_ms: int | None):
        self.schema, self.key, self.size, self.idle_ms = schema, key, size, idle_ms
        self.ts, self.tie = schema.names.index(ts), schema.names.index(tie)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.buffer = handle.getListState("buffer", self.schema)

    def _newness(self, row: tuple) -> tuple:
        return tuple(part for at in (self.ts, self.tie) for part in ((False,) if row[at] is None else (True, row[at])))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        kept = [tuple(r) for r in self.buffer.get()] if self.buffer.exists() else []
        seen = 0
        for row in rows:
            kept.append(tuple(row))
            seen += 1
            # The list never holds more than twice the buffer.
            if len(kept) >= 2 * self.size:
                kept = sorted(kept, key=self._newness, reverse=True)[: self.size]
        kept = sorted(kept, key=self._newness, reverse=True)[: self.size]
        self.buffer.put(kept)
        if self.idle_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            newest = max((r[self.ts] for r in kept if r[self.ts] is not None), default=0)
            self.handle.registerTimer(max(newest // 1000 + self.idle_ms, timerValues.getCurrentWatermarkInMs() + 1))
        yield Row(**{self.key: key[0], "kept": len(kept), "seen": seen})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        self.buffer.clear()
        yield Row(**{self.key: key[0], "kept": 0, "seen": 0})

    def close(self) -> None:
        pass


def buffer_stream(stream: DataFrame, key: str, ts: str, tie: str, size: int, idle: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Keep the newest ``size`` rows of every key in the state store; the stream tells (key, kept, seen) per micro-batch.

    State grows with keys times ``size``, and a micro-batch writes the buffers of its own keys only. With ``idle`` (an interval such as
    ``2 hours``) a key whose newest row is older than that, measured by the watermark that runs ``delay`` behind, is forgotten. Null keys have one buffer; rows without a time are the oldest.
    """
    spark = stream.sparkSession
    idle_ms = None
    if idle is not None:
        idle_ms = _millis(spark, idle)
        stream = stream.withWatermark(ts, delay)
    kind = stream.schema[key].dataType.simpleString()
    rows = newest_of_batches(stream.select(*_as_numbers(stream.schema)), key, ts, tie, size)
    processor = RecentRows(StructType(list(rows.schema)), key, ts, tie, size, idle_ms)
    return rows.groupBy(key).transformWithState(processor, f"`{key}` {kind}, kept int, seen int", "Update", "EventTime" if idle_ms is not None else "None")


def _as_numbers(schema: StructType) -> list[Column]:
    """Times as microseconds: what Python and the state make of them depends on no time zone."""
    return [F.unix_micros(f.name).alias(f.name) if isinstance(f.dataType, TimestampType) else F.col(f.name) for f in schema]


def _millis(spark: SparkSession, interval: str) -> int:
    return spark.sql(f"SELECT unix_millis(TIMESTAMP '2000-01-01 00:00:00' + INTERVAL {interval}) - unix_millis(TIMESTAMP '2000-01-01 00:00:00')").first()[0]


def run_buffer(stream: DataFrame, folder: str, key: str, ts: str, tie: str, size: int, idle: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Take in all available input and return the buffers as they now stand in the state.

    A later call with the same ``folder``, also of another process, goes on from its state.
    """
    spark = stream.sparkSession
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        changes = buffer_stream(stream, key, ts, tie, size, idle, delay)
        sink = changes.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
        sink.format("noop").start().awaitTermination()
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)
    return read_buffers(spark, folder, stream.schema)


def read_buffers(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """The rows (of the stream's ``schema``) of all buffers, read from the state of a stopped or running stream."""
    state = spark.read.format("statestore").option("stateVarName", "buffer").option("flattenCollectionTypes", True).load(f"{folder}/state")
    rows = state.select("list_element.*")
    return rows.select(*(F.timestamp_micros(f.name).alias(f.name) if isinstance(f.dataType, TimestampType) else F.col(f.name) for f in schema))


def match_answers(requests: DataFrame, answers: DataFrame, key: str, ts: str, within: str, delay: str = "10 minutes") -> DataFrame:
    """What became of every request: (key, requested, answered_at, status), a stream-stream join.

    ``requests`` and ``answers`` both have ``key`` and ``ts``. An answer counts if it comes at the time of its request or up to ``within`` after it.
    Status is ``answered``; ``unanswered`` once the watermark says that no answer can come any more; ``unrequested`` for an
    answer without such a request. Repeated answers within ``delay`` are dropped. State holds the requests and answers of the last
    ``within`` and ``delay`` only. Null keys match nothing. Keys name single jobs, so no key is large.
    """
    once = answers.select(F.col(key).alias("_answer"), F.col(ts).alias("_at")).withWatermark("_at", delay).dropDuplicatesWithinWatermark(["_answer", "_at"])
    asked = requests.select(F.col(key), F.col(ts).alias("requested")).withWatermark("requested", delay)
    same = (F.col(key) == F.col("_answer")) & (F.col("_at") >= F.col("requested")) & (F.col("_at") <= F.col("requested") + F.expr(f"INTERVAL {within}"))
    joined = asked.join(once, same, "full_outer")
    status = F.when(F.col("_at").isNull(), "unanswered").when(F.col("requested").isNull(), "unrequested").otherwise("answered")
    return joined.select(F.coalesce(key, "_answer").alias(key), "requested", F.col("_at").alias("answered_at"), status.alias("status"))


def run_matches(requests: DataFrame, answers: DataFrame, folder: str, key: str, ts: str, within: str, delay: str = "10 minutes") -> DataFrame:
    """All matches that are certain after the available input, as a table that later calls with the same ``folder`` add to."""
    found = match_answers(requests, answers, key, ts, within, delay)
    start_table(found, folder, "append", availableNow=True).awaitTermination()
    return requests.sparkSession.read.schema(found.schema).parquet(f"{folder}/rows")
