"""Number grids and seeded random values."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.numeric import seeded_uniform
from gridloom.operators.lookup import checked_lookup


def arange(spark: SparkSession, start: float, stop: float, step: float = 1.0) -> DataFrame:
    """(i, v) with v = start + i * step below ``stop``."""
    size = max(0, math.ceil((stop - start) / step))
    return spark.range(size).select(F.col("id").alias("i"), (F.lit(float(start)) + F.col("id") * F.lit(float(step))).alias("v"))


def linspace(spark: SparkSession, start: float, stop: float, num: int, endpoint: bool = True) -> DataFrame:
    gaps = num - 1 if endpoint else num
    step = (stop - start) / gaps if gaps else 0.0
    return spark.range(num).select(F.col("id").alias("i"), (F.lit(float(start)) + F.col("id") * F.lit(step)).alias("v"))


def eye(spark: SparkSession, rows: int, columns: int | None = None, k: int = 0) -> DataFrame:
    """Non-zero cells (i, j, v) of a matrix with ones on diagonal ``k``."""
    columns = columns or rows
    cells = spark.range(rows).select(F.col("id").alias("i"), (F.col("id") + k).alias("j"), F.lit(1.0).alias("v"))
    return cells.filter((F.col("j") >= 0) & (F.col("j") < columns))


def full(spark: SparkSession, rows: int, columns: int, value: float) -> DataFrame:
    """All cells (i, j, v) with one value."""
    return spark.range(rows * columns).select(
        F.floor(F.col("id") / columns).alias("i"), (F.col("id") % columns).alias("j"), F.lit(float(value)).alias("v")
    )


def random_uniform(seed: int, *keys, low: float = 0.0, high: float = 1.0) -> Column:
    """A uniform number per row that depends on the seed and the row's keys only."""
    return F.lit(low) + seeded_uniform(seed, *keys) * F.lit(high - low)


def random_normal(seed: int, *keys, mean: float = 0.0, deviation: float = 1.0) -> Column:
    """A normal number per row (Box and Muller)."""
    radius = F.sqrt(-2 * F.ln(1 - seeded_uniform(seed, *keys)))
    return F.lit(mean) + F.lit(deviation) * radius * F.cos(F.lit(2 * math.pi) * seeded_uniform(seed + 1, *keys))


def random_integer(seed: int, *keys, low: int = 0, high: int = 2) -> Column:
    return F.lit(low) + F.floor(seeded_uniform(seed, *keys) * F.lit(high - low)).cast("long")


def truncated_normal(df: DataFrame, key: str, seed: int, mean: float = 0.0, deviation: float = 1.0, target: str = "v") -> DataFrame:
    """Add a normal number within two deviations; draws outside are repeated, per row and independent of partitions."""
    keyed = df.withColumn("_seed", F.xxhash64(F.lit(seed), key))

    def draw(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            state = part["_seed"].to_numpy().astype(np.uint64)
            value = np.full(len(part), np.nan)
            turn = np.uint64(0)
            while np.isnan(value).any():
                todo = np.isnan(value)
                first, second = _mix(state[todo], turn), _mix(state[todo], turn + np.uint64(1))
                found = np.sqrt(-2 * np.log(1 - first)) * np.cos(2 * np.pi * second)
                value[todo] = np.where(np.abs(found) <= 2, found, np.nan)
                turn += np.uint64(2)
            part[target] = mean + deviation * value
            yield part.drop(columns="_seed")

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return keyed.mapInPandas(draw, f"{fields}, `{target}` double")


def _mix(state: np.ndarray, turn: np.uint64) -> np.ndarray:
    """Uniform numbers from 64-bit states (the public-domain splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        z = state + (turn + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z = z ^ (z >> np.uint64(31))
    return (z >> np.uint64(11)).astype(np.float64) * 2.0**-53


def multinomial(df: DataFrame, key: str, probabilities: list[float], seed: int) -> DataFrame:
    """Outcome counts of one draw per row: (outcome, n), zero counts included."""
    limits, reached = [], 0.0
    for p in probabilities[:-1]:
        reached += p / sum(probabilities)
        limits.append(reached)
    draw = seeded_uniform(seed, key)
    outcome = sum(((draw >= F.lit(limit)).cast("int") for limit in limits), F.lit(0))
    counts = df.select(outcome.alias("outcome")).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))
    names = df.sparkSession.range(len(probabilities)).select(F.col("id").cast("int").alias("outcome"))
    return checked_lookup(names, counts, ["outcome"], ["outcome"]).select("outcome", F.coalesce("n", F.lit(0)).alias("n"))


def usage(key: Column, train: float = 0.8, validation: float = 0.1, seed: int = 0) -> Column:
    """Stable train / validation / test label of a row."""
    draw = seeded_uniform(seed, key)
    return F.when(draw < train, "train").when(draw < train + validation, "validation").otherwise("test")
