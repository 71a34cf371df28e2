"""Evaluators as grouped sums, the metric log and its percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators.selection import at_ranks


def accumulate(
    df: DataFrame, evaluators: dict[str, Column], stage: str = "stage", epoch: str = "epoch", batch: str = "batch",
    every: int = 5,
) -> DataFrame:
    """Evaluator sums at four levels in one pass: whole stage, epoch, progress window and batch.

    Each evaluator is a per-record value (hit or loss). Columns ``<name>_sum``, ``<name>_total`` and
    ``<name>`` (their ratio, null when empty); ``level`` names the accumulator.
    """
    windowed = df.withColumn("progress", F.floor(F.col(batch) / every))
    for name, value in evaluators.items():
        windowed = windowed.withColumn(f"_{name}", value)
    sets = [[stage], [stage, epoch], [stage, epoch, "progress"], [stage, epoch, batch]]
    columns = [stage, epoch, "progress", batch]
    sums = []
    for name in evaluators:
        sums += [F.sum(f"_{name}").alias(f"{name}_sum"), F.count(f"_{name}").alias(f"{name}_total")]
    out = windowed.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in columns]).agg(
        F.grouping_id(*columns).alias("_level"), *sums
    )
    # Bits of the grouping id: 1 marks a column that was summed over (stage, epoch, progress, batch).
    level = F.when(F.col("_level") == 7, "all").when(F.col("_level") == 3, "epoch").when(F.col("_level") == 1, "progress")
    out = out.withColumn("level", level.otherwise("batch"))
    for name in evaluators:
        out = out.withColumn(name, F.try_divide(F.col(f"{name}_sum"), F.col(f"{name}_total")))
    return out.drop("_level")


def mean_of_batches(df: DataFrame, loss: Column, batch: list[str], within: list[str] | None = None) -> DataFrame:
    """Loss as the plain mean of batch means (a short batch counts like a full one) and the weighted mean."""
    per = df.groupBy(*(within or []), *batch).agg(F.avg(loss).alias("_m"), F.sum(loss).alias("_s"), F.count(loss).alias("_n"))
    return per.groupBy(*(within or [])).agg(
        F.avg("_m").alias("loss"), (F.sum("_s") / F.sum("_n")).alias("weighted_loss"), F.count("*").alias("batches")
    )


def floor_rank_percentiles(df: DataFrame, name: str, value: str, tie: str, percents: list[int]) -> DataFrame:
    """``sorted[n * p / 100]`` with integer division, clamped to the last value, exact for groups of any size.

    Nulls are not values: they count nowhere, and a group of nulls only has null percentiles. ``tie`` deals out the rows of a busy group.
    """
    n = F.col("_n")
    found = at_ranks(df, [name], value, tie, [F.least(F.floor(n * p / 100), n - 1) for p in percents])
    return found.select(name, *[F.get("_at", F.lit(i)).alias(f"p{p}") for i, p in enumerate(percents)])


def percentiles(df: DataFrame, groups: list[str], value: str, tie: str, shares: dict[str, float]) -> DataFrame:
    """Percentiles with linear interpolation between neighbours, exact for groups of any size.

    The built-in percentile keeps all distinct values of a group in one task; here :func:`at_ranks` finds the two neighbours of
    each percentile. Nulls are not values; null groups are groups, and a group without values has null percentiles. ``tie`` deals
    out the rows of a busy group.
    """
    ranks = {name: (F.col("_n") - 1) * F.lit(share) for name, share in shares.items()}
    found = at_ranks(df, groups, value, tie, [end for rank in ranks.values() for end in (F.floor(rank), F.ceil(rank))])

    def between(i: int, rank: Column) -> Column:
        low, high = (F.get("_at", F.lit(2 * i + side)).cast("double") for side in (0, 1))
        part = rank - F.floor(rank)
        return F.when(part == 0, low).otherwise(low * (1 - part) + high * part)

    return found.select(*groups, *[between(i, rank).alias(name) for i, (name, rank) in enumerate(ranks.items())])


def latest(df: DataFrame, name: str, value: str, ts: str, tie: str) -> DataFrame:
    """Most recent value per metric name."""
    return df.groupBy(name).agg(F.max_by(value, F.struct(ts, tie)).alias("latest"), F.max(ts).alias("ts"))


def training_report(levels: DataFrame, evaluators: list[str]) -> DataFrame:
    """One row: the last epoch's value per stage and evaluator, named ``<stage>_epoch_<evaluator>``."""
    epochs = levels.filter("level = 'epoch'")
    return epochs.agg(
        F.max("epoch").alias("epoch"),
        *[
            F.max_by(F.when(F.col("stage") == s, F.col(e)), F.when(F.col("stage") == s, F.col("epoch"))).alias(f"{s}_epoch_{e}")
            for s in ("train", "validate")
            for e in evaluators
        ],
    )
