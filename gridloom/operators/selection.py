"""Values at wanted ranks of large groups, found by closing in on them instead of sorting.

A group is counted first. If it is large, a sketch is taken of it and two neighbouring sketch values fence in every wanted rank; a
pass of plain counts then shows how many values lie below and inside a fence. While a fence holds many values, the next sketch
looks only into it. What is left at the end are some ten thousand values a rank, counted by value. Sketches steer only the size of the fences: counts
decide, so the result is exact. Rows are never moved; tasks send sketches, counts and the values inside small fences.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.arrays import let
from gridloom.operators.lookup import checked_lookup
from gridloom.session import cut_lineage

#: Values inside a fence that are counted one by one.
FENCED = 100_000
#: Parts into which a sketch cuts a fence, and its accuracy (ranks are off by a share of 1 / ACCURACY at most).
PARTS, ACCURACY = 200, 2_000


def _sketch(value: Column, kind: str) -> Column:
    """Values at ``PARTS + 1`` even shares. NaN counts as the infinity it sorts next to."""
    if kind in ("double", "float"):
        value = F.when(F.isnan(value), F.lit(float("inf")).cast(kind)).otherwise(value)
    # One expression, not a call for each share.
    shares = F.expr(f"array({', '.join(f'{i / PARTS}D' for i in range(PARTS + 1))})")
    return F.percentile_approx(value, shares, ACCURACY)


def _fence(cuts: Column, share: Column, slack: int, low: Column, high: Column) -> tuple[Column, Column]:
    """The sketch values around a share; the old ends where the sketch has none further out."""
    first, last = F.floor(share * PARTS).cast("int") - slack, F.ceil(share * PARTS).cast("int") + slack
    return F.when(first <= 0, low).otherwise(F.get(cuts, first)), F.when(last >= PARTS, high).otherwise(F.get(cuts, last))


def at_ranks(df: DataFrame, groups: list[str], value: str, spread_by: str, ranks: list[Column], fenced: int | None = None) -> DataFrame:
    """One row a group: its columns, ``_n`` (values in it) and the array ``_at`` of the values at ``ranks``.

    ``ranks`` are 0-based and below ``_n``, from which they may be computed. Nulls aren't values: a group without values has ``_n``
    0 and null entries. Null groups are groups. ``spread_by`` deals out the rows of a busy group where there are too many groups to broadcast. Without ``groups``
    the table is one group, also if it is empty. ``df`` is read several times and must give the same rows each time.
    """
    fenced = FENCED if fenced is None else fenced
    kind = df.schema[value].dataType.simpleString()
    count, numbers = len(ranks), range(len(ranks))
    # A struct equals itself also where it holds nulls.
    rows = df.select(F.struct(*groups).alias("_g") if groups else F.lit(0).alias("_g"), F.col(value).alias("_v"), F.col(spread_by).alias("_s"))
    v = F.col("_v")

    whole = rows.groupBy("_g") if groups else rows.groupBy()
    state = whole.agg(F.count(v).alias("_n"), F.min(v).alias("_least"), F.max(v).alias("_most"))
    state = state if groups else state.withColumn("_g", F.lit(0))
    columns = ["_g", "_n"]
    for i in numbers:
        # The whole group is the first fence.
        columns += [ranks[i].cast("long").alias(f"_rank{i}"), F.col("_least").alias(f"_from{i}"), F.col("_most").alias(f"_to{i}")]
        columns += [F.lit(0).cast("long").alias(f"_below{i}"), F.col("_n").alias(f"_within{i}")]
    state = cut_lineage(state.select(*columns))

    left = F.greatest(*[F.when(_open(i, fenced), F.col(f"_within{i}")).otherwise(0) for i in numbers], F.lit(0))
    slack, held = 2, state.agg(F.max(left)).first()[0] or 0
    while held > fenced and slack <= PARTS:
        state = cut_lineage(_narrowed(rows, state, count, kind, slack, fenced))
        state = cut_lineage(_counted(rows, state, count))
        before, held = held, state.agg(F.max(left)).first()[0] or 0
        # A fence that hardly shrinks is full of equal values or was missed by the sketch: look further out, at last at all of it.
        slack = slack if held < before / 4 else 4 * slack
    return _picked(rows, state, count).select(*[F.col(f"_g.{g}").alias(g) for g in groups], "_n", "_at")


def _open(i: int, most: int) -> Column:
    """Whether the fence of a rank still has to be narrowed."""
    return (F.col(f"_within{i}") > most) & (F.col(f"_from{i}") < F.col(f"_to{i}"))


def _inside(i: int) -> Column:
    return (F.col("_v") >= F.col(f"_from{i}")) & (F.col("_v") <= F.col(f"_to{i}"))


def _counted(rows: DataFrame, state: DataFrame, count: int) -> DataFrame:
    """Proposed fences (``_low``, ``_high``) counted; one that holds its rank replaces the old one (``_from``, ``_to``)."""
    joined = checked_lookup(rows.where(F.col("_v").isNotNull()), state, ["_g"], ["_s", "_v"], "inner")
    sums = []
    for i in range(count):
        under = F.col("_v") < F.col(f"_low{i}")
        sums += [F.count_if(under).alias(f"_b{i}"), F.count_if(~under & (F.col("_v") <= F.col(f"_high{i}"))).alias(f"_w{i}")]
    found = checked_lookup(state, joined.groupBy("_g").agg(*sums), ["_g"], ["_n"])
    columns = ["_g", "_n"]
    for i in range(count):
        rank, below, within = F.col(f"_rank{i}"), F.col(f"_b{i}"), F.col(f"_w{i}")
        holds = (below <= rank) & (rank < below + within)
        columns.append(rank)
        for old, new in (("_from", "_low"), ("_to", "_high"), ("_below", "_b"), ("_within", "_w")):
            columns.append(F.when(holds, F.col(f"{new}{i}")).otherwise(F.col(f"{old}{i}")).alias(f"{old}{i}"))
    return found.select(*columns)


def _narrowed(rows: DataFrame, state: DataFrame, count: int, kind: str, slack: int, fenced: int) -> DataFrame:
    """New proposals for open fences, from sketches of the values inside them."""
    joined = checked_lookup(rows.where(F.col("_v").isNotNull()), state, ["_g"], ["_s", "_v"], "inner")
    looked = [_inside(i) & _open(i, fenced) for i in range(count)]
    some = looked[0]
    for more in looked[1:]:
        some |= more
    sketches = [_sketch(F.when(look, F.col("_v")), kind).alias(f"_cuts{i}") for i, look in enumerate(looked)]
    found = checked_lookup(state, cut_lineage(joined.where(some).groupBy("_g").agg(*sketches)), ["_g"], ["_n"])
    columns = list(state.columns)
    for i in range(count):
        old = F.col(f"_from{i}"), F.col(f"_to{i}")
        share = (F.col(f"_rank{i}") - F.col(f"_below{i}")) / F.col(f"_within{i}")
        new = _fence(F.col(f"_cuts{i}"), share, slack, *old)
        for name, made, kept in zip(("_low", "_high"), new, old, strict=True):
            columns.append(F.when(_open(i, fenced) & F.col(f"_cuts{i}").isNotNull(), made).otherwise(kept).alias(f"{name}{i}"))
    return found.select(*columns)


def _picked(rows: DataFrame, state: DataFrame, count: int) -> DataFrame:
    """The values at the ranks: the only value of a fence, or that at which the counts of its values reach the rank."""
    joined = checked_lookup(rows.where(F.col("_v").isNotNull()), state, ["_g"], ["_s", "_v"], "inner")
    wanted = F.lit(False)
    for i in range(count):
        wanted |= _inside(i) & (F.col(f"_from{i}") < F.col(f"_to{i}"))
    values = joined.where(wanted).groupBy("_g", "_v").agg(F.count(F.lit(1)).alias("_c"))
    values = values.groupBy("_g").agg(F.sort_array(F.collect_list(F.struct("_v", "_c"))).alias("_values"))
    found = checked_lookup(values, state, ["_g"], ["_g"], "inner")

    def reached(i: int) -> Column:
        low, high = F.col(f"_from{i}"), F.col(f"_to{i}")
        rank = F.col(f"_rank{i}") - F.col(f"_below{i}")
        inside = F.filter("_values", lambda x: (x["_v"] >= low) & (x["_v"] <= high))
        start = F.struct(F.lit(0).cast("long").alias("seen"), low.alias("at"))
        step = lambda seen, x: F.struct((seen["seen"] + x["_c"]).alias("seen"), F.when(seen["seen"] <= rank, x["_v"]).otherwise(seen["at"]).alias("at"))
        return F.when(low < high, let(inside, lambda xs: F.aggregate(xs, start, step, lambda done: done["at"]))).otherwise(low)

    # Groups whose fences all hold a single value, or none, have nothing to pick.
    picked = found.select("_g", F.array(*[reached(i) for i in range(count)]).alias("_reached"))
    known = F.array(*[F.col(f"_from{i}") for i in range(count)])
    # One row a group on both sides.
    return state.join(picked.hint("shuffle_hash"), "_g", "left").withColumn("_at", F.coalesce("_reached", known))
