"""Tabular features: a declared list of columns becomes one numeric array per row; scaling."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import arrays as A
from gridloom.operators.batching import attach_index, first_seen_index
from gridloom.operators.ordering import ordered_prefix


@dataclass(frozen=True)
class Feature:
    """One declared column. ``kind``: numeric, category (given map), one_hot (given map), indexed (first
    seen order) or custom (``function`` from Column to Column)."""

    name: str
    kind: str = "numeric"
    mapping: dict[str, int] = field(default_factory=dict)
    function: Callable[[Column], Column] | None = None


def catalogue(path_text: str) -> list[Feature]:
    """Features from a JSON text: ``featureArray``, ``categorical`` names and ``featureToMap``."""
    spec = json.loads(path_text)
    maps = spec.get("featureToMap", {})
    return [
        Feature(n, "one_hot" if n in maps else "indexed", maps.get(n, {})) if n in set(spec.get("categorical", [])) else Feature(n)
        for n in spec["featureArray"]
    ]


def featurize(df: DataFrame, features: list[Feature], labels: list[Feature], order: str) -> DataFrame:
    """Append ``data`` and ``labels``, arrays of doubles in declared order; other columns stay.

    ``order`` is the row order that first-seen indices follow and must be unique.
    """
    if not features or not labels:
        raise ValueError("features and labels must both be declared")
    out = df
    spark = df.sparkSession
    for feature in dict.fromkeys(f.name for f in [*features, *labels]):
        kinds = {f.kind for f in [*features, *labels] if f.name == feature}
        if kinds & {"category", "one_hot"}:
            spec = next(f for f in [*features, *labels] if f.name == feature and f.mapping)
            table = spark.createDataFrame(list(spec.mapping.items()), "value string, index long")
            out = attach_index(out, feature, table, [order], strict=True)
        elif "indexed" in kinds:
            out = attach_index(out, feature, first_seen_index(df, feature, order), [order])

    def part(f: Feature) -> Column:
        if f.kind == "numeric":
            return F.array(F.col(f.name).cast("float").cast("double"))
        if f.kind == "one_hot":
            return A.one_hot(F.col(f"{f.name}_index"), len(f.mapping))
        if f.kind == "custom":
            return f.function(F.col(f.name))
        return F.array(F.col(f"{f.name}_index").cast("double"))

    return out.select(
        *df.columns, F.concat(*map(part, features)).alias("data"), F.concat(*map(part, labels)).alias("labels")
    )


def fit_min_max(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Smallest and largest value of every column in one pass."""
    row = df.agg(*[f(c).alias(f"{f.__name__}_{c}") for c in columns for f in (F.min, F.max)]).first()
    return {c: (row[f"min_{c}"], row[f"max_{c}"]) for c in columns}


def min_max_scale(df: DataFrame, fitted: dict[str, tuple[float, float]], low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Scale columns to [low, high]; a constant column gives null."""
    for name, (smallest, largest) in fitted.items():
        unit = F.try_divide(F.col(name) - F.lit(smallest), F.lit(float(largest) - float(smallest)))
        df = df.withColumn(name, unit * F.lit(high - low) + F.lit(low))
    return df


def min_max_restore(df: DataFrame, fitted: dict[str, tuple[float, float]], low: float = 0.0, high: float = 1.0) -> DataFrame:
    for name, (smallest, largest) in fitted.items():
        unit = (F.col(name) - F.lit(low)) / F.lit(high - low)
        df = df.withColumn(name, unit * F.lit(float(largest) - float(smallest)) + F.lit(smallest))
    return df


def fit_moments(df: DataFrame, columns: list[str], limit: int | None = None, order: str | None = None) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of every column, optionally over the first ``limit`` rows only."""
    if limit is not None:
        placed = ordered_prefix(df.select(order, *[c for c in columns if c != order]), order, index="_row")
        df = placed.filter(F.col("_row") < limit)
    row = df.agg(
        *[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]
    ).first()
    return {c: (row[f"m_{c}"], row[f"s_{c}"]) for c in columns}


def z_score(df: DataFrame, fitted: dict[str, tuple[float, float]]) -> DataFrame:
    for name, (mean, deviation) in fitted.items():
        df = df.withColumn(name, F.try_divide(F.col(name) - F.lit(mean), F.lit(deviation)))
    return df
