"""Near duplicates by 64-bit fingerprints, found through Golay codewords.

A fingerprint is cut into three segments of at most 23 bits. The perfect (23, 12) Golay code decodes every 23-bit word to
the one codeword within three bits. The codewords of a segment and of all words one bit away are its fuzzy keys: two
segments at most two bits apart have a word within one bit of both, so they share a key. If two fingerprints differ
in at most two bits, at least one of the three segments agrees exactly; that segment with a fuzzy key of the next one
is what they are joined on, and the whole distance is then checked.
"""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import arrow_map, own_name
from gridloom.llm.components import connected_components
from gridloom.operators.lookup import fits_broadcast
from gridloom.session import cut_lineage

WORDS = 3
BITS = 2
SEED = 42
CROWD = 64
SEGMENTS = ((0, 22), (22, 21), (43, 21))  # lowest bit and width

_GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1


def fingerprint(text: str, words: int = WORDS) -> int:
    """Majority bits of the XXH64 hashes of all word shingles; zero without words."""
    import xxhash

    tokens = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z are lowered, only ASCII blanks split
    if not tokens:
        return 0
    if len(tokens) < words:
        shingles = iter([b" ".join(tokens)])
        n = 1
    else:
        shingles = map(b" ".join, zip(*(tokens[i:] for i in range(words)), strict=False))
        n = len(tokens) - words + 1
    raw = np.frombuffer(b"".join(map(partial(xxhash.xxh64_digest, seed=SEED), shingles)), dtype=np.uint8).reshape(n, 8)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 1 << 14):
        ones += np.unpackbits(raw[at : at + (1 << 14)], axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """(key, fp): the fingerprint as a signed long. Null and empty texts get zero."""

    def rows(part: dict) -> dict:
        prints = [fingerprint(t or "", words) for t in part["text"]]
        return {"key": part["key"], "fp": [p - (1 << 64) if p >> 63 else p for p in prints]}

    kind = docs.schema[key].dataType.simpleString()
    return arrow_map(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), rows, f"key {kind}, fp long")


def _syndromes(words: np.ndarray) -> np.ndarray:
    rest = words.copy()
    for bit in range(22, 10, -1):
        rest = np.where((rest >> bit) & 1, rest ^ (_GENERATOR << (bit - 11)), rest)
    return rest


def _corrections() -> np.ndarray:
    """For each of the 2,048 remainders, the one error of at most three bits that leaves it."""
    singles = [1 << i for i in range(23)]
    errors = [0, *singles]
    errors += [a | b for i, a in enumerate(singles) for b in singles[:i]]
    errors += [a | b | c for i, a in enumerate(singles) for j, b in enumerate(singles[:i]) for c in singles[:j]]
    errors = np.array(errors, dtype=np.int64)
    table = np.zeros(2048, dtype=np.int64)
    table[_syndromes(errors)] = errors
    return table


_CORRECTIONS: list[np.ndarray] = []


def codeword_indices(words: np.ndarray) -> np.ndarray:
    """The 12-bit index of the codeword each 23-bit word decodes to."""
    if not _CORRECTIONS:
        _CORRECTIONS.append(_corrections())
    return (words ^ _CORRECTIONS[0][_syndromes(words)]) >> 11


def golay_keys(prints: np.ndarray) -> list[list[int]]:
    """The join keys of each fingerprint (unsigned): segment number, its exact bits, a fuzzy key of the next segment."""
    parts = [((prints >> np.uint64(low)) & np.uint64((1 << width) - 1)).astype(np.int64) for low, width in SEGMENTS]
    columns = []
    for i in range(3):
        j = (i + 1) % 3
        flips = np.array([0, *(1 << b for b in range(SEGMENTS[j][1]))], dtype=np.int64)
        index = np.sort(codeword_indices(parts[j][:, None] ^ flips), axis=1)
        keys = (np.int64(i) << 40) | (parts[i][:, None] << 12) | index
        keep = np.ones(index.shape, dtype=bool)
        keep[:, 1:] = index[:, 1:] != index[:, :-1]
        columns.append((keys, keep))
    keys = np.concatenate([k for k, _ in columns], axis=1)
    keep = np.concatenate([k for _, k in columns], axis=1)
    return [row[mask].tolist() for row, mask in zip(keys, keep, strict=True)]


def linked_prints(prints: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``fp``: enough of the pairs at most two bits apart to join what they join.

    Keys held by at most ``crowd`` fingerprints: every pair is checked. For fingerprints with a key held by more, no pairs
    are formed: each gives the 65 words within one bit of it, and all that meet at a word (65 at most) are at most two
    bits apart, while any two so close meet at one. Both ways are exact.
    """

    def rows(part: dict) -> dict:
        signed = np.array(part["fp"], dtype=np.int64)
        keys = golay_keys(signed.view(np.uint64))
        return {"fp": [f for f, own in zip(part["fp"], keys, strict=True) for _ in own], "k": [k for own in keys for k in own]}

    keyed = cut_lineage(arrow_map(prints.select("fp"), rows, "fp long, k long", at_once=1 << 17))
    shared = keyed.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    held = cut_lineage(keyed.join(shared, "k"))
    few = held.where(F.col("n") <= crowd).select("k", "fp")
    left, right = few.withColumnRenamed("fp", "a"), few.withColumnRenamed("fp", "b")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= BITS
    pairs = left.join(right, "k").where((F.col("a") < F.col("b")) & near).select("a", "b").distinct()
    dense = held.where(F.col("n") > crowd).select("fp").distinct()
    flip = F.expr("explode(concat(array(0L), transform(sequence(0, 63), i -> shiftleft(1L, i))))")
    balls = dense.select("fp", flip.alias("bit")).select("fp", F.col("fp").bitwiseXOR(F.col("bit")).alias("word"))
    met = balls.groupBy("word").agg(F.collect_list("fp").alias("fps"), F.min("fp").alias("a")).where(F.size("fps") > 1)
    stars = met.select("a", F.explode("fps").alias("b")).where("a <> b").distinct()
    return pairs.unionByName(stars)


def _members(docs: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """(key, fp, root, component_id) for every row; ``root`` is the smallest fingerprint of the component."""
    written = cut_lineage(fingerprints(docs, key, text, words))
    distinct = cut_lineage(written.groupBy("fp").agg(F.min("key").alias("low")))
    roots = connected_components(linked_prints(distinct))
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lows = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    return written.join(rooted.select("fp", "root").join(lows, "root"), "fp")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """(key, fingerprint, component_id): one row per row of ``docs``.

    Fingerprints at most two bits apart are linked; ``component_id`` is the smallest key reachable over links, the
    row's own included. Rows with equal texts have equal fingerprints and are linked, empty and null texts with the
    fingerprint zero too. Null keys are never a component id unless a component has no other. Repeated rows give
    repeated results; an empty table gives none; other columns are not read.
    """
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return _members(docs, key, text, words).select(F.col("key").alias(key), digits.alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """One row of every group of near duplicates, with all its columns: the one with the smallest key.

    Only keys and fingerprints are shuffled to decide; where keys are unique the texts move once, to meet their
    decision. Where a key occurs more than once or is null, rows are told apart by their fingerprint too; of rows equal
    in both, the one with the least hash of all columns stays. A row without a key stays only where no row of its group has
    one. An empty table gives an empty one.
    """
    member = cut_lineage(_members(docs, key, text, words))
    kept = member.where(F.col("key").eqNullSafe(F.col("component_id")))
    first = own_name(docs.columns)
    unclear = member.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | F.col("key").isNull()).limit(1).count()
    if not unclear:
        # The copies are fewer than what stays; where their measured size allows, the texts are not moved at all.
        dropped = cut_lineage(member.where(F.col("key") != F.col("component_id")).select(F.col("key").alias(first)))
        side = F.broadcast(dropped) if fits_broadcast(dropped) else dropped
        return docs.join(side, docs[key] == side[first], "left_anti")
    mark = own_name([*docs.columns, first])
    print_of = F.pandas_udf(lambda s: s.map(lambda t: np.uint64(fingerprint(t or "", words)).astype(np.int64)), "long")
    one = kept.groupBy("root").agg(F.min("fp").alias("fp"), F.min("key").alias(first))
    marked = docs.withColumn(mark, print_of(F.col(text)))
    chosen = marked.join(one, marked[key].eqNullSafe(one[first]) & (marked[mark] == one["fp"]), "left_semi")
    order = Window.partitionBy(key, mark).orderBy(F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns)))
    return chosen.withColumn(first, F.row_number().over(order)).where(F.col(first) == 1).drop(first, mark)
