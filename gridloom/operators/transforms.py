"""Chains of column functions applied to the named fields of data and target."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ColumnFunction = Callable[[Column], Column]


@dataclass
class Steps:
    """Ordered steps; each changes one column, given by name or by position, or the first one."""

    items: list[tuple[str | int, ColumnFunction]] = field(default_factory=list)

    def add(self, function: ColumnFunction, at: str | int = 0) -> Steps:
        self.items.append((at, function))
        return self

    def insert(self, place: int, function: ColumnFunction, at: str | int = 0) -> Steps:
        self.items.insert(place, (at, function))
        return self

    def apply(self, df: DataFrame, columns: list[str]) -> DataFrame:
        """Run the steps over ``columns``; one projection per run of steps, merged by the optimizer."""
        for at, function in self.items:
            name = columns[at] if isinstance(at, int) else at
            if name not in columns:
                raise ValueError(f"no column {name} in {columns}")
            df = df.withColumn(name, function(F.col(name)))
        return df


def prepare(df: DataFrame, data: list[str], target: list[str], data_steps: Steps, target_steps: Steps) -> DataFrame:
    return df.transform(data_steps.apply, data).transform(target_steps.apply, target)
