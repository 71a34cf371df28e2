"""Alignment of two tokenizers over the same bytes, and how often their ids meet in a corpus.

Both token sequences of a text are arrays of byte ends. Groups end where both have a token end. Over long stretches the two
cut alike, token for token, at a constant shift between the indexes; there the ends are compared in steps of 1, 2, 4, ... tokens at that
shift until they differ, and the last step is halved until the first difference is found. Only the group at a difference is
walked token by token; it changes the shift.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import byte_bpe
from gridloom.llm.common import add_columns, own_name
from gridloom.session import cut_lineage

#: Pairs that hold this part of all links or more are looked up inside the tasks; there can be no more of them than this.
COMMON = 1 << 17
MADE = "n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, times array<int>"
NOTHING = (0, 0, 0, 0, "", [], [])
#: Parts of a text remembered by the piece model, in each of two generations.
REMEMBERED = 1 << 17
#: Texts with a run of so many characters without a space, or of white space, are encoded by the streaming encoder.
LONG_RUN = 2_000
#: Distinct id pairs that a task adds up before it hands their sums on.
SUMMED = 1 << 20


def stretches(a: list[int], b: list[int]) -> list[tuple[int, int, int, int]]:
    """(first of a, behind the last, first of b, behind the last) of one-to-one stretches and of single irregular groups, in order.

    ``a`` and ``b`` are rising ends with the same last one. The first ends are equal in a one-to-one stretch and differ in an irregular group.
    """
    out, i, j, n, m = [], 0, 0, len(a), len(b)
    while i < n and j < m:
        at, size = i, 1
        shift = j - i
        if a[i] == b[j]:
            i, size = i + 1, 2
        while size > 1 and i + size <= n and i + shift + size <= m and a[i : i + size] == b[i + shift : i + shift + size]:
            i += size
            size *= 2
        while size > 1:
            size //= 2
            if i + size <= n and i + shift + size <= m and a[i : i + size] == b[i + shift : i + shift + size]:
                i += size
        j = i + shift
        if i > at:
            out.append((at, i, at + shift, j))
        if i < n:
            at, low = i, j
            while a[i] != b[j]:
                if a[i] < b[j]:
                    i += 1
                else:
                    j += 1
            i, j = i + 1, j + 1
            out.append((at, i, low, j))
    return out


def links(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of all pairs of tokens whose byte ranges overlap: one for each stretch of bytes without an end of either inside."""
    if not len(a):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    marks = np.zeros((2, int(a[-1]) + 1), np.int8)
    marks[0, a] = marks[1, b] = 1
    at = np.flatnonzero(marks[0] | marks[1])
    # Tokens of a side that end before a stretch ends: the index of the token it lies in.
    left, right = marks[0, at], marks[1, at]
    return np.cumsum(left, dtype=np.int64) - left, np.cumsum(right, dtype=np.int64) - right


class _Words(dict):
    """Spaces and the characters behind them up to the next space -> their ids, packed. (Packed ids are no containers, which the
    garbage collector would visit again and again.)

    No piece of the vocabulary has a space behind another character (checked), so no merge crosses the place before such a
    space, and the parts of a text can be encoded one by one. A full dictionary becomes the older generation; parts met
    again move back, so frequent ones are never encoded anew.
    """

    def __init__(self, model: sentencepiece.SentencePieceProcessor):
        super().__init__()
        self.model, self.space, self.older = model, model.piece_to_id("▁"), {}
        self.tokens = piece_bytes(model)
        self.table = pa.array(self.tokens, pa.binary())
        pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
        self.apart = not any("▁" in p.lstrip("▁") for p in pieces)

    def __missing__(self, part: str) -> bytes:
        found = self.older.get(part)
        if found is None:
            found = array("i", self.model.encode(part[1:], num_threads=1) if part != " " else [self.space]).tobytes()
        if len(part) <= byte_bpe.REMEMBERED_CHARS:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[part] = found
        return found

    def ids(self, text: str) -> tuple[np.ndarray, bool]:
        """Ids of a space and the text, and whether they stand for the same bytes."""
        if not self.apart or "▁" in text:
            ids = np.array(self.model.encode(text, num_threads=1), np.int32)
        else:
            ids = np.frombuffer(b"".join(map(self.__getitem__, _PART.findall(f" {text}"))), np.int32)
        return ids, joined(self.table, ids) == f" {text}".encode()

    def parts(self, text: str) -> tuple[list[int], bool]:
        ids, same = self.ids(text)
        return ids.tolist(), same

    def encode(self, text: str) -> list[int]:
        return self.parts(text)[0]


def joined(table: pa.Array, places: np.ndarray) -> str | bytes:
    """The strings of a table at ``places``, one behind another."""
    whole = pa.ListArray.from_arrays(pa.array([0, len(places)], pa.int32()), table.take(pa.array(places)))
    return pc.binary_join(whole, pa.scalar("", table.type))[0].as_py()


def closing(n: int, first: np.ndarray, behind: np.ndarray) -> np.ndarray:
    """Which of ``n`` tokens end a group: all but those before the last one of the ranges ``first`` to ``behind``."""
    step = np.zeros(n + 1, np.int8)
    step[first] += 1
    step[behind - 1] -= 1
    return np.cumsum(step[:n], dtype=np.int8) == 0


def piece_bytes(model: sentencepiece.SentencePieceProcessor) -> list[bytes]:
    """The bytes that each piece of a model stands for."""
    pieces = ((i, model.id_to_piece(i)) for i in range(model.get_piece_size()))
    return [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in pieces]


_PART = re.compile(" +[^ ]*")


def quick_encoding(vocabulary: byte_bpe.Vocabulary) -> tiktoken.Encoding | None:
    """The compiled encoder of the same vocabulary, where ids rise with the ranks of the merges and all single bytes are tokens."""
    made = [vocabulary.ids[u + v] for u, v in vocabulary.ranks]
    whole = all(bytes([b]) in vocabulary.ids for b in range(256)) and len(made) + 256 == len(vocabulary.ids)
    if not whole or any(x >= y for x, y in zip(made, made[1:])):
        return None
    return tiktoken.Encoding("pair", pat_str=CUT, mergeable_ranks=vocabulary.ids, special_tokens={})


# Fixed value: the published pattern of the byte-level vocabulary.
CUT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SPACES = re.compile(rf"\s{{{LONG_RUN}}}")


class Pair:
    """Two tokenizers in a worker: ids of a text, bytes and spelled-out numbers of the ids."""

    def __init__(self, vocabulary: byte_bpe.Vocabulary, known: dict[str, bytes], piece_model: bytes):
        self.vocabulary, self.known, self.quick = vocabulary, known, quick_encoding(vocabulary)
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=piece_model)
        self.width = self.pieces.get_piece_size()
        self.a = [self.vocabulary.tokens.get(i, b"") for i in range(max(self.vocabulary.tokens) + 1)]
        self.words = _Words(self.pieces)
        self.b = self.words.tokens
        self.a_sizes, self.b_sizes = (np.array([len(t) for t in side], np.int64) for side in (self.a, self.b))
        self.names = max(len(self.a), self.width)
        # Ids spelled out inside a group, at the end of its part of a, at the end of its part of b.
        self.spelled = pa.array([f"{i}{mark}" for mark in ",|;" for i in range(self.names)], pa.string())

    def encode_a(self, whole: str) -> list[int] | None:
        """Ids of the byte-level vocabulary; None where they stand for other bytes."""
        if self.quick and max(map(len, whole.split()), default=0) < LONG_RUN and not _SPACES.search(whole):
            # Its tokens cut the bytes into parts, so they give them back.
            return self.quick.encode_ordinary(whole)
        ids = np.frombuffer(b"".join(byte_bpe.encoded_chunks(whole, byte_bpe.Encoder(self.vocabulary, False, self.known))), "<u4").tolist()
        return ids if b"".join(map(self.a.__getitem__, ids)) == whole.encode() else None

    def align(self, text: str | None) -> tuple:
        if not text:
            return NOTHING
        a_list, (b, same) = self.encode_a(f" {text}"), self.words.ids(text)
        if a_list is None or not same:
            return NOTHING
        a, b = np.array(a_list, np.int64), b.astype(np.int64)
        ends = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
        found = np.fromiter(chain.from_iterable(stretches(ends[0].tolist(), ends[1].tolist())), np.int64).reshape(-1, 4)
        groups, n_groups = self.spell(a, b, found[ends[0][found[:, 0]] != ends[1][found[:, 2]]])
        left, right = links(*ends)
        pairs, times = np.unique(a[left] * self.width + b[right], return_counts=True)
        return len(a), len(b), n_groups, len(left), groups, pairs, times.astype(np.int32)

    def spell(self, a: np.ndarray, b: np.ndarray, irregular: np.ndarray) -> tuple[str, int]:
        """The groups as text, and their number. Outside the irregular ones every token of a is a group with one of b."""
        a_last, b_last = closing(len(a), irregular[:, 0], irregular[:, 1]), closing(len(b), irregular[:, 2], irregular[:, 3])
        a_stops, b_stops = np.flatnonzero(a_last) + 1, np.flatnonzero(b_last) + 1
        # A token of a stands behind the tokens of b of earlier groups, one of b behind those of a of its own group too.
        places = np.empty(len(a) + len(b), np.int64)
        places[np.arange(len(a)) + np.append(0, b_stops)[np.cumsum(a_last) - a_last]] = a + self.names * a_last
        places[np.arange(len(b)) + a_stops[np.cumsum(b_last) - b_last]] = b + 2 * self.names * b_last
        return joined(self.spelled, places)[:-1], len(a_stops)


_PAIRS: dict[str, Pair] = {}


def align(df: DataFrame, byte_file: str, piece_file: str, text: str = "text") -> DataFrame:
    """All columns but ``text``, and the alignment of every whole text (columns of ``MADE``, which replace others of these names).

    ``groups`` spells the groups out as ``a1,a2|b1;a3|b2,b3``; ``pairs`` holds the distinct linked id pairs (id of a times the
    number of ids of b, plus id of b), ``times`` how many links of this text have each. The byte-level tokenizer reads a space and the text, the other
    adds its space itself; strings of special tokens are plain text. A null or empty text, and one that a tokenizer does not
    give back byte for byte, has no tokens: zeros and empty values. Both files are read on the driver and broadcast (megabytes).
    """
    known = byte_bpe.sent(df.sparkSession, byte_file)
    with open(byte_file, "rb") as one, open(piece_file, "rb") as two:
        key, pieces = byte_bpe.digest(one.read(), model := two.read()), df.sparkSession.sparkContext.broadcast(model)

    def aligned(value: str | None) -> tuple:
        if key not in _PAIRS:
            _PAIRS.clear()
            _PAIRS[key] = Pair(*known(), pieces.value)
        return _PAIRS[key].align(value)

    return add_columns(df, text, MADE, aligned)


def b_width(piece_file: str) -> int:
    return sentencepiece.SentencePieceProcessor(model_file=piece_file).get_piece_size()


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs and times of all rows of a batch one behind another, and the row number of each."""
    pairs, times = batch.column("pairs"), batch.column("times")
    sizes = pairs.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return pairs.flatten().to_numpy(zero_copy_only=False), times.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(len(sizes)), sizes)


def _added(pairs: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the times of each distinct pair."""
    order = np.argsort(pairs, kind="stable")
    pairs, times = pairs[order], times[order]
    first = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]])) if len(pairs) else np.zeros(0, np.int64)
    return pairs[first], np.add.reduceat(times, first) if len(first) else times


def _partial_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of a task by pair; a pair comes again only after ``SUMMED`` distinct ones were held."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def given() -> Iterator[pa.RecordBatch]:
        pairs, times = _added(*(np.concatenate(x) for x in zip(*held, strict=True)))
        for at in range(0, len(pairs), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(pairs[at : at + (1 << 16)]), pa.array(times[at : at + (1 << 16)])], names=["pair", "n"])

    for batch in batches:
        pairs, times, _ = _flat(batch)
        held.append(_added(pairs, times))
        size += len(held[-1][0])
        if size >= 2 * SUMMED:
            held = [_added(*(np.concatenate(x) for x in zip(*held, strict=True)))]
            size = len(held[0][0])
            if size >= SUMMED:
                yield from given()
                held, size = [], 0
    if held:
        yield from given()


def pair_counts(aligned: DataFrame, width: int) -> DataFrame:
    """(pair, n, best): links of each id pair over all rows, and whether its id of b has no pair with more."""
    parts = aligned.select("pairs", "times").mapInArrow(_partial_counts, "pair long, n long")
    counts = cut_lineage(parts.groupBy("pair").agg(F.sum("n").alias("n")))
    # One row for each id of b at most: the size of a vocabulary.
    top = counts.groupBy((F.col("pair") % width).alias("b")).agg(F.max("n").alias("top"))
    return counts.join(F.broadcast(top), F.col("pair") % width == F.col("b")).select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


def associate(aligned: DataFrame, width: int) -> DataFrame:
    """All rows and columns of ``aligned`` but ``pairs`` and ``times``, with ``count_sum``, the sum of the corpus counts of a row's links, and
    ``n_best``, how many of them have a count that no other pair of their id of b exceeds.

    Pairs with at least one link in ``COMMON`` of all links (so ``COMMON`` of them at most) are looked up in the tasks. Every other
    pair is joined; none of those has more than that part of the links, so no join key is large.
    """
    row = own_name(aligned.columns)
    rows = cut_lineage(aligned.withColumn(row, F.monotonically_increasing_id()))
    counts = cut_lineage(pair_counts(rows, width))
    total = counts.agg(F.sum("n")).first()[0] or 0
    often = F.col("n") * COMMON >= total
    common = sorted(tuple(r) for r in counts.where(often).collect())
    table = rows.sparkSession.sparkContext.broadcast([np.array(x, np.int64) for x in (zip(*common, strict=True) if common else ([], [], []))])

    def looked_up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row of sums of each text (no pair), and a row of each pair that is joined (no sums)."""
        keys, n, best = table.value
        for batch in batches:
            pairs, times, of = _flat(batch)
            at = np.minimum(np.searchsorted(keys, pairs), max(len(keys) - 1, 0))
            here = keys[at] == pairs if len(keys) else np.zeros(len(pairs), bool)
            sums = np.zeros((2, batch.num_rows), np.int64)
            for to, value in zip(sums, (n, best), strict=True):
                np.add.at(to, of[here], value[at[here]] * times[here])
            ids = batch.column("row").to_numpy()
            rest, blank = int((~here).sum()), pa.nulls
            columns = [
                pa.array(np.concatenate([ids, ids[of[~here]]])),
                *(pa.concat_arrays([pa.array(to), blank(rest, pa.int64())]) for to in sums),
                *(pa.concat_arrays([blank(len(ids), pa.int64()), pa.array(x[~here])]) for x in (pairs, times)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "count_sum", "n_best", "pair", "times"])

    made = "row long, count_sum long, n_best long, pair long, times long"
    parts = cut_lineage(rows.select(F.col(row).alias("row"), "pairs", "times").mapInArrow(looked_up, made))
    joined = parts.where("pair is not null").select("row", "pair", "times").join(counts.where(~often), "pair")
    joined = joined.select("row", (F.col("n") * F.col("times")).alias("count_sum"), (F.col("best").cast("long") * F.col("times")).alias("n_best"))
    sums = parts.where("pair is null").select("row", "count_sum", "n_best").union(joined).groupBy("row").agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best"))
    kept = rows.drop("pairs", "times", "count_sum", "n_best")
    return kept.join(sums.withColumnRenamed("row", row), row).drop(row)
