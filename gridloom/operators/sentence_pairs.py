"""Sentence pairs and masked-token instances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions import arrays as A
from gridloom.functions.numeric import seeded_uniform
from gridloom.operators.ordering import shuffled

# Fixed values of the masked-token task.
SEQUENCE_WIDTH, MASK_WIDTH = 128, 20
MASK_SHARE_DIVISOR = 5  # one position in five
MASK_BELOW, RANDOM_BELOW = 0.8, 0.9


def line_pairs(df: DataFrame, lines: str, key: str) -> DataFrame:
    """Lines 1 and 2, 3 and 4, ... of each document: (key, pair_no, a, b)."""
    count = F.floor(F.size(lines) / 2).cast("int")
    numbers = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    pairs = A.let(F.col(lines), lambda held: F.transform(
        numbers, lambda i: F.struct(F.get(held, i * 2).alias("a"), F.get(held, i * 2 + 1).alias("b"))
    ))
    return df.select(key, F.posexplode(pairs).alias("pair_no", "pair")).select(key, "pair_no", "pair.a", "pair.b")


def swap_half(df: DataFrame, key: str, seed: int) -> DataFrame:
    """Next-sentence samples: in a seeded random order, two neighbours exchange their first sentence with
    probability one half; ``consecutive`` is 0 for both when they did.

    The input is read more than once; cut its lineage first when it is expensive."""
    placed = shuffled(df, seed, key, wide=True).withColumn("_couple", F.floor(F.col("position") / 2))
    couple = Window.partitionBy("_couple")
    size, low, high = F.count(F.lit(1)).over(couple), F.min_by("a", "position").over(couple), F.max_by("a", "position").over(couple)
    swapped = (seeded_uniform(seed + 1, "_couple") < 0.5) & (F.col("_n") == 2)
    first = F.col("position") % 2 == 0
    return (
        placed.withColumn("_n", size)
        .withColumn("_low", low)
        .withColumn("_high", high)
        .withColumn("a", F.when(swapped & first, F.col("_high")).when(swapped, F.col("_low")).otherwise(F.col("a")))
        .withColumn("consecutive", F.when(swapped, 0).otherwise(1))
        .drop("_couple", "_n", "_low", "_high", "position")
    )


def truncate_pair(a: Column, b: Column, limit: int) -> tuple[Column, Column]:
    """Cut both token lists to ``limit`` in total, as if tokens were removed in turn from the ends of a and b."""
    size_a, size_b = F.size(a), F.size(b)
    over = F.greatest(F.lit(0), size_a + size_b - limit)
    cut_a = F.least(size_a, F.greatest(F.ceil(over / 2).cast("int"), over - size_b))
    return F.slice(a, F.lit(1), size_a - cut_a), F.slice(b, F.lit(1), size_b - (over - cut_a))


def masked_instances(
    df: DataFrame, a: str, b: str, key: str, seed: int, class_id: int, separator_id: int, mask_id: int,
    vocabulary_size: int, protect_special: bool = False,
) -> DataFrame:
    """Fixed-width masked-token training rows from two id lists.

    One position in five (at most 20) is chosen by a seeded hash; of these 80 % become the mask id, 10 % a
    random id, 10 % stay. All widths are fixed: 128 positions, 20 masked places.
    """
    cut_a, cut_b = truncate_pair(F.col(a), F.col(b), SEQUENCE_WIDTH - 3)
    rows = df.withColumn("_a", cut_a).withColumn("_b", cut_b)
    special = F.array(F.lit(separator_id).cast("long"))
    label = F.concat(F.array(F.lit(class_id).cast("long")), F.col("_a"), special, F.col("_b"), special)
    rows = rows.withColumn("_label", label).withColumn("_n", F.size("_label"))
    places = F.sequence(F.lit(0), F.col("_n") - 1)
    if protect_special:
        specials = F.array(F.lit(0), F.size("_a") + 1, F.col("_n") - 1)
        places = F.array_except(places, specials)
    drawn = F.sort_array(F.transform(places, lambda p: F.struct(F.xxhash64(F.lit(seed), key, p).alias("h"), p.alias("p"))))
    wanted = F.least(F.floor(F.col("_n") / MASK_SHARE_DIVISOR), F.lit(MASK_WIDTH)).cast("int")
    rows = rows.withColumn("_at", F.sort_array(F.transform(F.slice(drawn, F.lit(1), wanted), lambda s: s["p"])))

    def token(at: Column, x: Column, p: Column) -> Column:
        # One hash per place: cheaper than the digest of `seeded_uniform`, which serves whole rows.
        draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed + 1), key, p), 11) * F.lit(2.0**-53)
        other = F.pmod(F.xxhash64(F.lit(seed + 2), key, p), F.lit(vocabulary_size))
        replaced = F.when(draw < MASK_BELOW, F.lit(mask_id).cast("long")).when(draw < RANDOM_BELOW, other).otherwise(x)
        return F.when(F.array_contains(at, p), replaced).otherwise(x)

    masked = A.let(F.col("_at"), lambda at: F.transform("_label", lambda x, p: token(at, x, p)))
    answers = A.let(F.col("_label"), lambda label_: F.transform("_at", lambda p: F.get(label_, p)))

    types = F.concat(F.array_repeat(F.lit(0), F.size("_a") + 2), F.array_repeat(F.lit(1), F.size("_b") + 1))
    zero, zero_long = F.lit(0), F.lit(0).cast("long")
    return rows.select(
        *df.columns,
        A.fit(masked, zero_long, SEQUENCE_WIDTH).alias("token_ids"),
        A.fit(types, zero, SEQUENCE_WIDTH).alias("type_ids"),
        A.fit(F.array_repeat(F.lit(1), F.col("_n")), zero, SEQUENCE_WIDTH).alias("input_mask"),
        A.fit(F.col("_at"), zero, MASK_WIDTH).alias("masked_positions"),
        A.fit(answers, zero_long, MASK_WIDTH).alias("masked_ids"),
        A.fit(F.transform("_at", lambda p: F.lit(1)), zero, MASK_WIDTH).alias("label_mask"),
        F.col("_n").alias("length"),
    )
