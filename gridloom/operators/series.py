"""Ordered series: convolution with a fixed kernel, recent-rows buffers, sessions by gap."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.ordering import hash_order, ordered_prefix
from gridloom.session import cut_lineage


def convolve(
    df: DataFrame, value: str, within: list[str], lead: str, tie: str, kernel: list[float], stride: int = 1,
    padding: int = 0, dilation: int = 1,
) -> DataFrame:
    """One-dimensional convolution per series: (within..., t, v) with zero padding.

    Every row is sent to the outputs it contributes to, at most one per kernel weight, and the products
    are summed by output position, so a long series is spread over all tasks.
    """
    placed = ordered_prefix(df.select(*within, lead, tie, value), lead, tie, within=within, index="_t")
    sizes = df.groupBy(*[F.col(w).alias(f"_g{i}") for i, w in enumerate(within)]).agg(F.count(F.lit(1)).alias("_n"))
    match = [placed[w].eqNullSafe(sizes[f"_g{i}"]) for i, w in enumerate(within)]
    condition = match[0] if match else F.lit(True)
    for part in match[1:]:
        condition = condition & part
    sized = placed.join(sizes, condition).drop(*[f"_g{i}" for i in range(len(within))])
    weights = F.array(*[F.struct(F.lit(i * dilation).alias("o"), F.lit(float(w)).alias("w")) for i, w in enumerate(kernel)])
    spread = sized.withColumn("_k", F.explode(weights)).withColumn("_s", F.col("_t") + padding - F.col("_k.o"))
    span = dilation * (len(kernel) - 1) + 1
    last = F.floor((F.col("_n") + 2 * padding - span) / stride)
    kept = spread.filter((F.col("_s") >= 0) & (F.col("_s") % stride == 0) & (F.col("_s") / stride <= last))
    return kept.groupBy(*within, F.floor(F.col("_s") / stride).alias("t")).agg(F.sum(F.col(value) * F.col("_k.w")).alias("v"))


def recent(df: DataFrame, key: str, ts: str, tie: str, size: int) -> DataFrame:
    """The newest ``size`` rows per key. Spark limits the rank before the shuffle, so a frequent key sends
    only ``size`` rows per task."""
    newest = Window.partitionBy(key).orderBy(F.col(ts).desc(), F.col(tie).desc())
    return df.withColumn("_r", F.row_number().over(newest)).filter(F.col("_r") <= size).drop("_r")


def sample_recent(df: DataFrame, key: str, ts: str, tie: str, size: int, draw: int, seed: int) -> DataFrame:
    """A seeded uniform sample of ``draw`` rows from the newest ``size`` rows per key."""
    order = Window.partitionBy(key).orderBy(hash_order(seed, tie), tie)
    return recent(df, key, ts, tie, size).withColumn("_d", F.row_number().over(order)).filter(F.col("_d") <= draw).drop("_d")


def sessions(df: DataFrame, key: str, ts: str, gap_seconds: int, chunk: int = 4096) -> DataFrame:
    """Sessions per key: (key, session, start, last, rows); a new one starts when more than ``gap_seconds`` passed since the last row.

    Rows in the same time slot of that width always share a session, so they are combined before the shuffle. Then time is cut into
    chunks of ``chunk`` slots. Inside the chunk of a key neighbouring sessions are merged; those that touch neither edge are done,
    and the first and last go on to chunks ``chunk`` times as wide, until one chunk covers all. So a window holds at most twice
    ``chunk`` rows, also of a key that holds most of the table. Rows without a time belong to no session; null keys are a key.
    """
    gap = gap_seconds * 1_000_000
    timed = df.where(F.col(ts).isNotNull())
    parts = cut_lineage(timed.groupBy(key, F.floor(F.unix_micros(ts) / gap).alias("_at")).agg(
        F.min(ts).alias("start"), F.max(ts).alias("last"), F.count(F.lit(1)).alias("rows")
    ))
    low, high = parts.agg(F.min("_at"), F.max("_at")).first()
    done, width = None, chunk
    while True:
        top = low is None or low // width == high // width
        here = parts.withColumn("_cell", F.floor(F.col("_at") / width))
        order = Window.partitionBy(key, "_cell").orderBy("_at", "start")
        fresh = F.unix_micros("start") - F.unix_micros(F.lag("last").over(order)) > gap
        marked = here.withColumn("_new", F.coalesce(fresh, F.lit(True)).cast("int"))
        marked = marked.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        merged = marked.groupBy(key, "_cell", "_run").agg(
            F.min("_at").alias("_at"), F.min("start").alias("start"), F.max("last").alias("last"), F.sum("rows").alias("rows")
        )
        if top:
            closed = merged.select(key, "start", "last", "rows")
            done = closed if done is None else done.union(closed)
            break
        edge = (F.col("_run") == 1) | (F.col("_run") == F.max("_run").over(Window.partitionBy(key, "_cell")))
        written = cut_lineage(merged.select(key, "_at", "start", "last", "rows", edge.alias("_edge")))
        closed = written.where(~F.col("_edge")).select(key, "start", "last", "rows")
        done = closed if done is None else done.union(closed)
        parts, width = written.where("_edge").drop("_edge"), width * chunk
    return ordered_prefix(cut_lineage(done), "start", within=[key], index="session").select(key, "session", "start", "last", "rows")
