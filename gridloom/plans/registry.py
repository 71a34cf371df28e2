"""The list of registered queries: a Spark function, its check SQL and the operators it covers."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.session import Tables, ship_package


@dataclass(frozen=True)
class Query:
    name: str
    covers: tuple[str, ...]
    build: Callable[[Tables], DataFrame]
    sql: str | None

    def run(self, spark: SparkSession, folder: str) -> DataFrame:
        ship_package(spark)
        return self.build(Tables(spark, folder))


REGISTRY: dict[str, Query] = {}


def query(name: str, covers: str, sql: str | None = None):
    """Register a query; ``covers`` holds the blueprint ids separated by blanks."""

    def register(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")
        REGISTRY[name] = Query(name, tuple(covers.split()), build, sql)
        return build

    return register


def r6(col: Column | str) -> Column:
    """Round to six digits without negative zero, the form compared with the check SQL."""
    col = F.col(col) if isinstance(col, str) else col
    return F.round(col.cast("double"), 6) + F.lit(0.0)


def draw_sql(seed: int, *keys: str) -> str:
    """The check SQL of ``functions.numeric.seeded_bits``."""
    return f"('0x' || md5(concat_ws('|', {', '.join([str(seed), *keys])}))[1:13])::BIGINT"


def uniform_sql(seed: int, *keys: str) -> str:
    return f"({draw_sql(seed, *keys)} * pow(2.0, -52))"
