"""Exact global and per-group order without a single-task window.

A window without partition columns, or with one hot partition value, runs in one task. Here the
order is cut into slots by quantiles of the leading key. Slot totals are added up (a small table), and
inside a slot an ordinary window finishes the work. The cut points only steer balance: the result is
exact for any of them. A leading value that alone fills a slot is split further by the tie-breaker.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import reduce
from operator import and_

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DateType, NumericType, StructType, TimestampNTZType, TimestampType

from gridloom.functions.numeric import seeded_bits
from gridloom.operators.lookup import checked_lookup
from gridloom.session import cut_lineage

ROWS_PER_SLOT = 500_000
MAX_SLOTS = 16_384
EXACT_DOUBLE = float(2**53)


BYTES = 6


def _bytes_number(col: Column, first: int) -> Column:
    """Six bytes of a string from byte ``first`` (0-based) as a number; missing bytes count as the lowest."""
    head = F.rpad(F.hex(F.substring(F.encode(col, "UTF-8"), first + 1, BYTES)), 2 * BYTES, "0")
    return F.conv(head, 16, 10).cast("double")


def order_number(col: Column, kind: DataType, skip: int = 0) -> Column:
    """A double that rises (weakly) with the column's own order; of a struct, with its first field.

    Of a string: six bytes behind the first ``skip``, which all values must share.
    """
    if isinstance(kind, StructType):
        return order_number(col[kind[0].name], kind[0].dataType)
    dtype = kind.simpleString()
    if dtype == "string":
        return _bytes_number(col, skip)
    if dtype.startswith("timestamp"):
        return F.unix_micros(col.cast("timestamp")).cast("double")
    if dtype == "date":
        return F.unix_date(col).cast("double")
    return col.cast("double")


def _directed(number: Column, descending: bool) -> Column:
    """Rises in the wanted direction. NaN is above all numbers, so it becomes the end it sorts to; null stays null."""
    number = F.when(F.isnan(number), F.lit(math.inf)).otherwise(number)
    return -number if descending else number


def _shared_bytes(df: DataFrame, column: str) -> int:
    """How many leading bytes all values of a string column share: those that the least and the greatest share."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    if low is None:
        return 0
    low, high = low.encode("utf-8", "surrogatepass"), high.encode("utf-8", "surrogatepass")
    return next((i for i, (a, b) in enumerate(zip(low, high, strict=False)) if a != b), min(len(low), len(high)))


def _splits(cuts: list[float] | None, isolate: bool) -> list[float]:
    points: set[float] = set()
    for cut in cuts or []:
        points.add(cut)
        if isolate:
            points.add(math.nextafter(cut, math.inf))
    return [-math.inf, *sorted(x for x in points if math.isfinite(x)), math.inf]


def _slot(df: DataFrame, source: str, target: str, splits: list[float]) -> DataFrame:
    """Number of the interval a value lies in; nulls get the last number of all."""
    if len(splits) < 3:
        return df.withColumn(target, F.when(F.col(source).isNull(), 1.0).otherwise(0.0))
    placed = Bucketizer(splits=splits, inputCol=source, outputCol=target, handleInvalid="keep").transform(df)
    return placed.withColumn(target, F.coalesce(target, F.lit(float(len(splits)))))


def _place(df: DataFrame, tasks: int, isolate: bool) -> DataFrame:
    """Add ``_slot`` and ``_sub`` from quantiles of ``_lead`` and ``_next``.

    ``isolate`` says that among equal ``_lead``, rows are ordered (weakly) by ``_next``. Then a value frequent enough
    to be several quantiles gets a slot of its own, cut further by ``_next``.
    """
    parts = min(MAX_SLOTS, 2 * tasks)
    steps = [i / parts for i in range(1, parts)]
    lead_cuts = df.agg(F.percentile_approx("_lead", steps, 10 * parts)).first()[0] or []
    df = _slot(df, "_lead", "_slot", _splits(lead_cuts, isolate))
    hot = [cut for cut, times in Counter(lead_cuts).items() if times > 1 and math.isfinite(cut)]
    if not (isolate and hot):
        return df.withColumn("_sub", F.lit(0.0))
    busy = F.col("_lead").isin(hot)
    next_cuts = df.where(busy).agg(F.percentile_approx("_next", steps, 10 * parts)).first()[0]
    df = _slot(df, "_next", "_sub", _splits(next_cuts, isolate=False))
    return df.withColumn("_sub", F.when(busy, F.col("_sub")).otherwise(0.0))


def ordered_prefix(
    df: DataFrame,
    lead: str,
    tie: str | None = None,
    within: list[str] | None = None,
    index: str | None = "row_id",
    sums: dict[str, str] | None = None,
    descending: bool = False,
    rows_per_slot: int | None = None,
    wide: bool = False,
) -> DataFrame:
    """Add a 0-based row index and/or inclusive running sums in the order (lead, tie).

    ``within`` names group columns; a group of any size is spread over slots. ``lead`` plus ``tie``
    must be unique inside a group, else the order among equals is arbitrary. ``descending`` turns the
    leading key round; the tie-breaker always ascends; nulls come last. With ``wide`` only the key columns are sorted and the
    result is joined back by them (they must be unique), so that long texts or arrays are not sorted.
    """
    within = within or []
    sums = sums or {}
    if wide:
        keys = list(dict.fromkeys([*within, lead, *([tie] if tie else [])]))
        narrow = df.select(*dict.fromkeys([*keys, *sums.values()]))
        placed = ordered_prefix(narrow, lead, tie, within, index, sums, descending, rows_per_slot)
        added = [*([index] if index else []), *sums]
        named = placed.select(*(F.col(k).alias(f"_key_{i}") for i, k in enumerate(keys)), *added)
        same = reduce(and_, (df[k].eqNullSafe(named[f"_key_{i}"]) for i, k in enumerate(keys)))
        return df.join(named, same).drop(*(f"_key_{i}" for i in range(len(keys))))
    per_slot = rows_per_slot or ROWS_PER_SLOT
    types = {field.name: field.dataType for field in df.schema}
    lead_key = F.col(lead).desc_nulls_last() if descending else F.col(lead).asc_nulls_last()
    keys = [lead_key] + ([F.col(tie).asc_nulls_last()] if tie else [])

    total = df.count()
    skip = _shared_bytes(df, lead) if total > per_slot and types[lead].simpleString() == "string" else 0
    numbered = df.withColumn("_lead", _directed(order_number(F.col(lead), types[lead], skip), descending))
    if types[lead].simpleString() == "string":
        # Equal heads are told apart by the bytes behind them.
        following = _directed(_bytes_number(F.col(lead), skip + BYTES), descending)
    else:
        following = _directed(order_number(F.col(tie), types[tie]), False) if tie else F.lit(0.0)
    numbered = numbered.withColumn("_next", following)

    measures = {f"_before_{i}": column for i, column in enumerate(sums.values())}
    # The join key of a group: a struct, because null group values must meet each other.
    numbered = numbered.withColumn("_g", F.struct(*within) if within else F.lit(0))
    if total <= per_slot:
        numbered = numbered.withColumn("_slot", F.lit(0.0)).withColumn("_sub", F.lit(0.0)).withColumn("_n", F.lit(0))
        for measure in measures:
            numbered = numbered.withColumn(measure, F.lit(0))
    else:
        isolate = types[lead].simpleString() == "string"
        if tie and isinstance(types[lead], (NumericType, TimestampType, TimestampNTZType, DateType)):
            smallest, largest = numbered.agg(F.min("_lead"), F.max("_lead")).first()
            # Only where equal numbers are equal keys does the tie-breaker order them.
            isolate = smallest is not None and max(abs(smallest), abs(largest)) < EXACT_DOUBLE
        numbered = _place(numbered, math.ceil(total / per_slot), isolate)
        if within:
            # Only groups too large for one task are cut; their number is at most total / per_slot.
            large = numbered.groupBy("_g").agg(F.count(F.lit(1)).alias("_size")).filter(F.col("_size") > per_slot)
            large = cut_lineage(large.select("_g", F.lit(True).alias("_large")))
            numbered = checked_lookup(numbered, large, ["_g"], ["_lead", "_next"])
            for name in ("_slot", "_sub"):
                numbered = numbered.withColumn(name, F.when(F.col("_large"), F.col(name)).otherwise(0.0))
            cut = numbered.filter(F.col("_large"))
        else:
            cut = numbered
        slots = cut.groupBy("_g", "_slot", "_sub").agg(
            F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(m) for m, c in measures.items()]
        )
        over = Window.partitionBy("_g").orderBy("_slot", "_sub").rowsBetween(Window.unboundedPreceding, -1)
        slots = slots.select("_g", "_slot", "_sub", *[F.coalesce(F.sum(m).over(over), F.lit(0)).alias(m) for m in ("_n", *measures)])
        numbered = checked_lookup(numbered, cut_lineage(slots), ["_g", "_slot", "_sub"], ["_lead", "_next"])
        numbered = numbered.fillna(0, subset=["_n", *measures])

    inside = Window.partitionBy("_g", "_slot", "_sub").orderBy(*keys)
    running = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    columns = [F.col(c) for c in df.columns]
    if index:
        columns.append((F.row_number().over(inside).cast("long") - 1 + F.col("_n")).alias(index))
    for (target, source), measure in zip(sums.items(), measures, strict=True):
        columns.append((F.sum(source).over(running) + F.col(measure)).alias(target))
    return numbered.select(*columns)


def batches(df: DataFrame, size: int, lead: str, tie: str | None = None, drop_last: bool = False, wide: bool = False) -> DataFrame:
    """Sequential batches: ``batch_id`` and position ``pos`` inside it; optionally without a short last one."""
    placed = ordered_prefix(df, lead, tie, index="_row", wide=wide)
    out = placed.withColumn("batch_id", F.floor(F.col("_row") / size)).withColumn("pos", F.col("_row") % size)
    if drop_last:
        full = df.count() // size
        out = out.filter(F.col("batch_id") < full)
    return out.drop("_row")


def sub_range(df: DataFrame, start: int, stop: int, lead: str, tie: str | None = None) -> DataFrame:
    """Rows ``start`` (included) to ``stop`` (excluded) of the order."""
    placed = ordered_prefix(df, lead, tie, index="_row")
    return placed.filter((F.col("_row") >= start) & (F.col("_row") < stop)).drop("_row")


def hash_order(seed: int, *keys: Column | str) -> Column:
    """A 52-bit pseudo-random order key that depends on the row only, never on its partition."""
    return seeded_bits(seed, *keys)


def shuffled(df: DataFrame, seed: int, key: str, wide: bool = False) -> DataFrame:
    """Random sampler: ``position`` is the place of the row in a seeded random order.

    ``wide`` sorts the keys alone, which also leaves the rows spread over all tasks when one slot is enough.
    """
    keyed = df.withColumn("_order", hash_order(seed, key))
    return ordered_prefix(keyed, "_order", key, index="position", wide=wide).drop("_order")


def random_split(df: DataFrame, ratios: list[float], seed: int, key: str) -> DataFrame:
    """Exact disjoint split: sizes are truncated shares, the last part takes the rest; adds ``split``."""
    total = df.count()
    whole = float(sum(ratios))
    cuts, reached = [], 0
    for ratio in ratios[:-1]:
        reached += int(ratio / whole * total)
        cuts.append(reached)
    placed = shuffled(df, seed, key)
    part = F.lit(0)
    for cut in cuts:
        part = part + (F.col("position") >= cut).cast("int")
    return placed.withColumn("split", part).drop("position")


def chunked_neighbours(
    df: DataFrame,
    index: str,
    before: int,
    after: int,
    derive: dict,
    within: list[str] | None = None,
    chunk: int = 200_000,
) -> DataFrame:
    """Columns that look at neighbouring rows, with bounded window partitions.

    ``index`` is a dense 0-based position per group. Rows close to a chunk edge are copied to the
    neighbouring chunk, the window runs inside a chunk, and the copies are dropped again. ``derive`` maps
    a new column to a function of the window.
    """
    within = within or []
    chunk = max(chunk, before, after, 1)
    home = F.floor(F.col(index) / chunk)
    offset = F.col(index) % chunk
    targets = F.array_compact(
        F.array(
            home,
            F.when(offset >= chunk - before, home + 1) if before else F.lit(None).cast("long"),
            F.when((offset < after) & (home > 0), home - 1) if after else F.lit(None).cast("long"),
        )
    )
    spread = df.withColumn("_home", home).withColumn("_chunk", F.explode(targets))
    window = Window.partitionBy(*within, "_chunk").orderBy(index)
    for name, build in derive.items():
        spread = spread.withColumn(name, build(window))
    return spread.filter(F.col("_chunk") == F.col("_home")).drop("_home", "_chunk")
