"""Collocations: phrases whose words stand together more often than their parts would alone.

Counting goes by length. A phrase can be frequent only if the phrases of its first and last words are, so only stretches that
pass this are proposed; support that is summed no further than the threshold proposes exactly the phrases that can pass. Proposed
phrases go into double-array tries over word ids (two digits an id), in blocks by hash of the phrase. The tries stay where they are:
a task reads its part of the corpus once, leaves out the phrases that a broadcast filter knows to be in no trie, and sends every other
phrase it met, with its count, to the trie of its block. There the states of all phrases move at once, digit by digit, and the counts
of accepting states are summed. So each position costs one look-up, however many tries there are. Phrases that the filter let through
and no trie accepts are few; they are sent back, so that marks are exact.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager, nullcontext

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.operators.lookup import checked_lookup
from gridloom.session import cut_lineage, drop_written, scratch_paths

LEAST, LONGEST, TOP = 10, 3, 2000
#: Most words of a dictionary block, each of which is one pass over the corpus, and most phrases of a trie.
DICTIONARY, BLOCK = 1 << 19, 1 << 19
#: Bits of the filter for a phrase at least, and bits that a phrase sets in one word of 64. Phrases whose filter is broadcast at once: one pass over the corpus.
BITS, PLACES, FILTERED = 16, 4, 1 << 25
#: Bytes of text that a task works on at once.
AT_ONCE = 2 << 20
#: Rows of word ids, of some ``AT_ONCE`` bytes each, that the file reader and Arrow hold at once.
ROWS_AT_ONCE = 4
#: Words whose counts a task adds up at once.
WORDS = 1 << 19
#: Phrases that a task adds up at once, and that a part of all proposed phrases is made for.
KEYS = 1 << 21
#: Bytes between pieces, and between words; A-Z becomes a-z.
_TABLE = bytes(10 if b in b".,;:!?\n\v\f\r" else 32 if b in b" \t" else b + 32 if 65 <= b <= 90 else b for b in range(256))


def cut(texts: list[str | None]) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(code of every word, the distinct words, whether a word follows the one before within its piece), nulls are empty."""
    data = np.frombuffer("\n".join(t or "" for t in texts).encode().translate(_TABLE), np.uint8)
    inside = (data != 32) & (data != 10)
    padded = np.concatenate([[False], inside, [False]])
    edges = np.flatnonzero(padded[1:] != padded[:-1])
    starts, ends = edges[::2], edges[1::2]
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts, out=offsets[1:])
    words = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])]).dictionary_encode()
    follows = np.ones(len(starts) + 1, bool)
    follows[0] = False
    # The first word behind a break.
    follows[np.searchsorted(starts, np.flatnonzero(data == 10))] = False
    follows = follows[:-1]
    return words.indices.to_numpy(zero_copy_only=False), words.dictionary, follows


def _by_language(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, list[str | None]]]:
    """Texts of one language at a time, about ``AT_ONCE`` bytes of them; a task holds a few times as many at most."""
    held: dict[str, list[str | None]] = {}
    sizes: dict[str, int] = {}
    for batch in batches:
        step = max(1, int(batch.num_rows * AT_ONCE / max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, step):
            part = pa.Table.from_batches([batch.slice(at, step)])
            for lang in pc.unique(part["lang"]).to_pylist():
                texts = part["text"].filter(pc.equal(part["lang"], lang))
                held.setdefault(lang, []).extend(texts.to_pylist())
                # Nulls and short texts take room, too.
                sizes[lang] = sizes.get(lang, 0) + (pc.sum(pc.binary_length(texts)).as_py() or 0) + 64 * len(texts)
            full = list(held) if sum(sizes.values()) > 4 * AT_ONCE else [lang for lang, size in sizes.items() if size > AT_ONCE]
            for lang in full:
                del sizes[lang]
                yield lang, held.pop(lang)
    yield from held.items()


@contextmanager
def few_rows(spark: SparkSession) -> Iterator[None]:
    """Jobs run inside read and pass on ``ROWS_AT_ONCE`` rows at a time; the session's settings are put back behind them.

    A row of word ids is as long as thousands of rows of other tables, for which the usual sizes of a batch are made.
    """
    settings = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")
    before = {name: spark.conf.get(name) for name in settings}
    try:
        for name in settings:
            spark.conf.set(name, ROWS_AT_ONCE)
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, f): occurrences of every word; the row with a null word holds those of all words of the language."""

    at_once = WORDS

    def together(found: tuple[str, list[tuple[pa.Array, np.ndarray]]]) -> pa.RecordBatch:
        lang, parts = found
        words, times = pa.concat_arrays([w for w, _ in parts]).dictionary_encode(), np.concatenate([n for _, n in parts])
        f = np.zeros(len(words.dictionary), np.int64)
        np.add.at(f, words.indices.to_numpy(zero_copy_only=False), times)
        rows = [pa.array([lang] * (len(f) + 1), pa.string()), pa.concat_arrays([words.dictionary, pa.array([None], pa.string())]), pa.array(np.append(f, times.sum()))]
        return pa.RecordBatch.from_arrays(rows, names=["lang", "word", "f"])

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many = {}, 0
        for lang, texts in _by_language(batches):
            codes, words, _ = cut(texts)
            held.setdefault(lang, []).append((words, np.bincount(codes, minlength=len(words))))
            many += len(words)
            if many > at_once:
                yield from map(together, held.items())
                held, many = {}, 0
        yield from map(together, held.items())

    return docs.mapInArrow(count, "lang string, word string, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))


def _blocks(df: DataFrame, most: int, *key: str) -> list[Column]:
    """Conditions that cut ``df`` into parts of about four fifths of ``most`` rows by hash of the key; one part if all fit."""
    rows = df.count()
    parts = math.ceil(rows / (0.8 * most)) if rows > most else 1
    return [F.pmod(F.xxhash64(*key), F.lit(parts)) == i for i in range(parts)]


def number_words(docs: DataFrame, words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The corpus as rows of word ids, and (id, lang, word, f) of the words.

    ``words`` are the frequent words. Ids start at 1; 0 stands for any stretch of other words and for the end of a piece. Texts
    keep no identity: a row holds what a task read at once. Texts are cut once; one pass over the rows' distinct words for each further
    block of the dictionary.
    """
    spark, state, before, numbered, first = docs.sparkSession, docs, None, [], 1
    blocks = _blocks(words, DICTIONARY, "lang", "word")
    for number, block in enumerate(blocks):
        # A block has `DICTIONARY` words at most.
        part = words.where(block).toArrow().sort_by([("lang", "ascending"), ("word", "ascending")])
        part = part.append_column("id", pa.array(np.arange(first, first + part.num_rows, dtype=np.int32)))
        numbered.append(cut_lineage(spark.createDataFrame(part.select(["id", "lang", "word", "f"]))))
        table = spark.sparkContext.broadcast({lang: _of_language(part, lang) for lang in pc.unique(part["lang"]).to_pylist()})
        last = number == len(blocks) - 1
        with few_rows(spark) if number else nullcontext():
            state, path = cut_lineage(_filled(state, table, number == 0, last)), scratch_paths(spark)[-1]
        table.destroy()
        if before:
            drop_written(spark, before)
        before = path
        first += part.num_rows
    known = numbered[0]
    for more in numbered[1:]:
        known = known.union(more)
    return state, known


class Numbered:
    """The words of a language with their ids, in order of a hash: looked up by bisection, so nothing is built for a look-up."""

    def __init__(self, words: pa.Array, first: int):
        """``words`` are distinct; ids are consecutive from ``first``."""
        mixed = word_hashes(words)
        order = np.argsort(mixed, kind="stable")
        self.mixed, self.words, self.ids = mixed[order], words.take(pa.array(order)), (order + first).astype(np.int32)
        runs = np.flatnonzero(np.concatenate([[True], self.mixed[1:] != self.mixed[:-1]]))
        #: Most words of one hash.
        self.most = int(np.diff(runs, append=len(order)).max()) if len(order) else 0

    def of(self, words: pa.Array) -> np.ndarray:
        """The ids of words, 0 for others."""
        mixed, ids = word_hashes(words), np.zeros(len(words), np.int32)
        at = np.searchsorted(self.mixed, mixed)
        for k in range(self.most):
            like = np.minimum(at + k, len(self.mixed) - 1)
            here = np.flatnonzero(self.mixed[like] == mixed)
            same = pc.equal(words.take(pa.array(here)), self.words.take(pa.array(like[here]))).to_numpy(zero_copy_only=False)
            ids[here[same]] = self.ids[like[here[same]]]
        return ids


def word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of every word's bytes; no word is null or empty."""
    if not len(words):
        return np.zeros(0, np.uint64)
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    begins, sizes = offsets[:-1] - offsets[0], np.diff(offsets)
    power = np.cumprod(np.full(int(sizes.max()), 0x9E3779B97F4A7C15, np.uint64))
    place = np.arange(len(data), dtype=np.int32) - np.repeat(begins, sizes)
    return np.add.reduceat((data.astype(np.uint64) + np.uint64(1)) * power[place], begins)


def _of_language(part: pa.Table, lang: str) -> Numbered:
    """The words of a language of a sorted table; ids are consecutive."""
    rows = part.filter(pc.equal(part["lang"], lang))
    return Numbered(pa.concat_arrays(rows["word"].chunks), rows["id"][0].as_py())


def _filled(state: DataFrame, table: Broadcast, begin: bool, last: bool) -> DataFrame:
    """The ids of one block's words put in. Until the last block a row keeps its distinct words, their ids, 0 for unknown ones, and the text as numbers of its words."""

    def rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, pa.Array, np.ndarray, np.ndarray]]:
        if begin:
            for lang, texts in _by_language(batches):
                codes, words, follows = cut(texts)
                # Numbers from 1, and a 0 wherever a phrase cannot go on.
                yield lang, words, np.zeros(len(words), np.int32), np.insert(codes + 1, np.flatnonzero(~follows), 0).astype(np.int32)
        else:
            for batch in batches:
                for row in batch.to_pylist():
                    words = pa.concat_arrays(pa.ipc.open_stream(row["words"]).read_all()["word"].chunks or [pa.array([], pa.string())])
                    yield row["lang"], words, _numbers(row["known"], row["many"], np.int32), _numbers(row["text"], row["size"], np.int32)

    def fill(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, words, known, text in rows_of(batches):
            if lang in table.value and len(words):
                known = np.where(known == 0, table.value[lang].of(words), known)
            if last:
                ids = _stretches(np.concatenate([np.zeros(1, np.int32), known])[text])
                yield pa.RecordBatch.from_arrays([pa.array([len(ids)], pa.int32()), pa.array([_pressed(ids)], pa.binary())], names=["size", "ids"])
            else:
                row = {"lang": pa.array([lang], pa.string()), "many": pa.array([len(words)], pa.int32()), "words": pa.array([_as_bytes(words)], pa.binary())}
                row |= {"known": pa.array([_pressed(known)], pa.binary()), "size": pa.array([len(text)], pa.int32()), "text": pa.array([_pressed(text)], pa.binary())}
                yield pa.RecordBatch.from_arrays([*row.values()], names=[*row])

    return state.mapInArrow(fill, "size int, ids binary" if last else "lang string, many int, words binary, known binary, size int, text binary")


def _as_bytes(words: pa.Array) -> bytes:
    """Words as a compressed Arrow stream."""
    sink, batch = pa.BufferOutputStream(), pa.RecordBatch.from_arrays([words], names=["word"])
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _pressed(numbers: np.ndarray) -> bytes:
    """Whole numbers as compressed bytes: all first bytes, then all second ones and so on. JVM rows carry them without a step for each number."""
    width = numbers.dtype.itemsize
    return pa.compress(np.ascontiguousarray(numbers.astype(f"<i{width}").view(np.uint8).reshape(-1, width).T), codec="zstd", asbytes=True)


def _numbers(data: bytes, size: int, kind: type) -> np.ndarray:
    """What ``_pressed`` was given: ``size`` numbers of a kind."""
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data, size * width, codec="zstd", asbytes=True) if size else b"", np.uint8).reshape(width, size)
    return np.ascontiguousarray(planes.T).reshape(-1).view(f"<i{width}")


def _stretches(ids: np.ndarray) -> np.ndarray:
    """Ids with no 0 in front and only one between words."""
    keep = ids != 0
    keep[1:] |= ids[:-1] != 0
    return ids[keep]


def _task_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and marks of the rows of a task, each with a 0 behind it; no marks are zeros."""
    for batch in batches:
        for row in batch.to_pylist():
            size = row["size"]
            ids, marks = np.zeros(size + 1, np.int32), np.zeros(size + 1, np.int8)
            ids[:size] = _numbers(row["ids"], size, np.int32)
            if row.get("marks") is not None:
                marks[:size] = np.unpackbits(np.frombuffer(row["marks"], np.uint8), count=size)
            yield ids, marks


class Trie:
    """A double-array trie over phrases of word ids, each id as two digits of base ``base``.

    The child of state s by digit d is ``offset[s] + d`` if ``check`` of that place is s. ``accept`` is the number of the phrase that ends in a
    state, or -1.
    """

    def __init__(self, phrases: np.ndarray, base: int):
        """``phrases``: one row a phrase, ids from 1, filled up with 0 behind; distinct rows."""
        self.base, self.phrases = base, phrases
        width = phrases.shape[1]
        digits = np.stack([phrases // base, phrases % base], axis=2).reshape(len(phrases), 2 * width)
        order = np.lexsort(tuple(digits[:, k] for k in range(2 * width - 1, -1, -1)))
        digits, ends = digits[order], 2 * (phrases > 0).sum(axis=1)[order]
        self.size = base + 1
        self.offset, self.check, self.accept = (np.full(self.size, v, np.int32) for v in (0, -1, -1))
        self.free = np.ones(self.size, bool)
        self.free[0] = False
        self.low = 1
        state = np.zeros(len(digits), np.int64)
        for depth in range(2 * width):
            live = np.flatnonzero(ends > depth)
            if not len(live):
                break
            # Phrases are sorted, so those of one state and digit stand together.
            parent, digit = state[live], digits[live, depth]
            new = np.concatenate([[True], (parent[1:] != parent[:-1]) | (digit[1:] != digit[:-1])])
            slot = self._place(parent[new], digit[new])
            state[live] = slot[np.cumsum(new) - 1]
            done = live[ends[live] == depth + 1]
            self.accept[state[done]] = order[done]
        del self.free

    def _grow(self, least: int) -> None:
        if least > self.size:
            more = max(least, self.size + self.size // 2) - self.size
            self.offset, self.check, self.accept = (np.concatenate([x, np.full(more, v, np.int32)]) for x, v in ((self.offset, 0), (self.check, -1), (self.accept, -1)))
            self.free = np.concatenate([self.free, np.ones(more, bool)])
            self.size += more

    def _place(self, parent: np.ndarray, digit: np.ndarray) -> np.ndarray:
        """Slots for the children (parent, digit); parents with most children first, single ones into what is left."""
        begins = np.flatnonzero(np.concatenate([[True], parent[1:] != parent[:-1]]))
        counts = np.diff(np.append(begins, len(parent)))
        slot = np.zeros(len(parent), np.int64)
        for i in np.argsort(-counts, kind="stable"):
            if counts[i] == 1:
                break
            span = slice(begins[i], begins[i] + counts[i])
            at = self._fit(digit[span])
            slot[span] = at + digit[span]
            self.free[slot[span]] = False
            self.offset[parent[begins[i]]] = at
        one = begins[counts == 1]
        # Offsets may be negative, as a single child may take any free place.
        self._grow(self.size + max(0, len(one) - int(self.free.sum())) + self.base)
        slot[one] = np.flatnonzero(self.free)[: len(one)]
        self.free[slot[one]] = False
        self.offset[parent[one]] = slot[one] - digit[one]
        self.check[slot] = parent
        return slot

    def _fit(self, digits: np.ndarray) -> int:
        """The first offset from a moving start at which all children find free places."""
        at, tries = self.low, 0
        while True:
            self._grow(at + 64 + self.base + 1)
            fits = self.free[(at + np.arange(64))[:, None] + digits].all(axis=1)
            if fits.any():
                return at + int(fits.argmax())
            at, tries = at + 64, tries + 1
            if tries % 8 == 0:
                self.low += 64

    def states(self, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(positions, states) after each word of a phrase: all positions of ``ids`` at once; ``ids`` ends with a 0."""
        at = np.flatnonzero(ids)
        state = np.zeros(len(at), np.int64)
        high, low = ids // self.base, ids % self.base
        for k in range(self.phrases.shape[1]):
            for digit in (high, low):
                here, state = self._moved(state, digit[at + k])
                at = at[here]
            yield at, state
            more = ids[np.minimum(at + k + 1, len(ids) - 1)] != 0
            at, state = at[more], state[more]

    def _moved(self, state: np.ndarray, digit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether a state has a child by its digit, and the children there are."""
        to = self.offset[state] + digit
        here = (to >= 0) & (to < self.size)
        here[here] = self.check[to[here]] == state[here]
        return here, to[here].astype(np.int64)

    def numbers(self, words: list[np.ndarray]) -> np.ndarray:
        """The numbers of whole phrases, one column of ids from 1 a word; -1 for those that are not in the trie."""
        at, state = np.arange(len(words[0])), np.zeros(len(words[0]), np.int64)
        for ids in words:
            for digit in (ids // self.base, ids % self.base):
                here, state = self._moved(state, digit[at])
                at = at[here]
        found = np.full(len(words[0]), -1, np.int64)
        found[at] = self.accept[state]
        return found


    def packed(self) -> dict[str, bytes | int]:
        return {name: _pressed(np.ascontiguousarray(getattr(self, name), np.int32).reshape(-1)) for name in ("offset", "check", "accept", "phrases")} | {"size": self.size, "many": len(self.phrases)}

    @classmethod
    def unpacked(cls, parts: dict, base: int, width: int) -> Trie:
        trie = cls.__new__(cls)
        trie.base, trie.size = base, parts["size"]
        for name in ("offset", "check", "accept"):
            setattr(trie, name, _numbers(parts[name], trie.size, np.int32))
        trie.phrases = _numbers(parts["phrases"], parts["many"] * width, np.int32).reshape(-1, width)
        return trie


def names(n: int, first: int = 1) -> list[str]:
    return [f"w{i}" for i in range(first, first + n)]


def built_tries(phrases: DataFrame, n: int, base: int, least: int = 1) -> DataFrame:
    """Tries of all ``phrases`` (ids in w1 to wn) as a written table of arrays, each with its block's piece of the filter.

    A phrase's block follows from its hash. There are ``least`` blocks or more, of about ``BLOCK`` phrases at most; each is built in a task.
    """
    columns, packing, rows = names(n), Packing(n, base * base), phrases.count()
    blocks = max(least, math.ceil(rows / (0.8 * BLOCK)))
    bits = 1 << max(6, math.ceil(math.log2(BITS * max(1, rows) / blocks)))

    def keys_of(ids: np.ndarray) -> list[np.ndarray]:
        return packing.keys(ids.reshape(-1), np.arange(len(ids)) * n)

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns], axis=1)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(packing.parts(keys_of(ids), blocks))], names=[*columns, "block"])

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        ids = rows[columns].to_numpy(np.int64)
        piece = np.zeros(bits // 64, np.uint64)
        np.bitwise_or.at(piece, *places(packing.mixed(keys_of(ids)), bits))
        piece = piece.astype("<u8").tobytes()
        return pd.DataFrame([Trie(ids, base).packed() | {"block": int(rows["block"].iloc[0]), "blocks": blocks, "bits": bits, "piece": piece}])

    dealt = phrases.select(*columns).mapInArrow(deal, ", ".join([*(f"{c} int" for c in columns), "block int"]))
    return cut_lineage(dealt.groupBy("block").applyInPandas(build, "offset binary, check binary, accept binary, phrases binary, size int, many int, block int, blocks int, bits int, piece binary"))


def places(mixed: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The word of 64 bits in their block's piece of the filter and the bits in it that phrases set, by the mixed keys; ``bits`` is a power of 2."""
    again = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    mask = np.zeros(len(mixed), np.uint64)
    for k in range(PLACES):
        mask |= np.uint64(1) << ((again >> np.uint64(58 - 6 * k)) & np.uint64(63))
    return ((again >> np.uint64(4)) & np.uint64(bits // 64 - 1)).astype(np.int64), mask


class Tries:
    """The tries of the blocks from ``first`` to before ``last``, and the filter over all their phrases."""

    def __init__(self, built: DataFrame, n: int, base: int, blocks: int, bits: int, first: int, last: int):
        self.built = built.where((F.col("block") >= first) & (F.col("block") < last))
        self.n, self.base, self.packing = n, base, Packing(n, base * base)
        self.blocks, self.bits, self.first, self.last = blocks, bits, first, last
        #: What was looked up for the counts, and of it the phrases that no trie accepts, by ``mixed``; None until then.
        self.answers: DataFrame | None = None
        self.wrong: tuple[np.ndarray, list[np.ndarray], np.ndarray] | None = None

    @contextmanager
    def filter(self) -> Iterator[Broadcast]:
        """The filter while it is broadcast."""
        words = self.bits // 64
        whole = np.zeros((self.last - self.first) * words, np.uint64)
        for row in self.built.select("block", "piece").toLocalIterator():
            at = (row["block"] - self.first) * words
            whole[at : at + words] = np.frombuffer(row["piece"], "<u8")
        broadcast = self.built.sparkSession.sparkContext.broadcast((whole, self.wrong))
        try:
            yield broadcast
        finally:
            broadcast.destroy()

    def passing(self) -> Callable[[list[np.ndarray], tuple], np.ndarray]:
        """A function of keys and the filter's value: which phrases may be in the tries, without the wrong ones if they are known."""
        packing, blocks, bits, first, last = self.packing, self.blocks, self.bits, self.first, self.last

        def passes(keys: list[np.ndarray], value: tuple) -> np.ndarray:
            whole, wrong = value
            mixed = packing.mixed(keys)
            block = packing.part_of(mixed, blocks).astype(np.int64) - first
            word, mask = places(mixed, bits)
            if last - first < blocks:
                mine = (block >= 0) & (block < last - first)
                block[~mine] = 0
                good = mine & (whole[block * (bits // 64) + word] & mask == mask)
            else:
                good = whole[block * (bits // 64) + word] & mask == mask
            if wrong is not None and len(wrong[0]):
                sorted_wrong, wrong_keys, sieve = wrong
                at = np.flatnonzero(good)
                at = at[sieve[_sieved(mixed[at], len(sieve))]]
                found = np.minimum(np.searchsorted(sorted_wrong, mixed[at]), len(sorted_wrong) - 1)
                good[at[np.all([k[at] == w[found] for k, w in zip(keys, wrong_keys, strict=True)], axis=0)]] = False
            return good

        return passes

    def looked_up(self, corpus: DataFrame, filter: Broadcast) -> DataFrame:
        """(w1 to wn, f): all phrases of the corpus that pass the filter with their occurrences; f is 0 for those that no trie accepts."""
        columns, n, base, packing, blocks, passes, most = names(self.n), self.n, self.base, self.packing, self.blocks, self.passing(), KEYS

        def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def keys_of(ids: np.ndarray, _: np.ndarray) -> Iterator[list[np.ndarray]]:
                at = starts(ids, n)
                for first in range(0, len(at), most):
                    keys = packing.keys(ids, at[first : first + most])
                    good = passes(keys, filter.value)
                    yield [k[good] for k in keys]

            yield from sent_rows(batches, keys_of, packing, blocks, None, most)

        def add(sent: pd.DataFrame, tries: pd.DataFrame) -> pd.DataFrame:
            if not len(sent):
                return pd.DataFrame({c: np.zeros(0, np.int64) for c in [*columns, "f"]})
            keys, times = _together([packing.unpack(data, many) for data, many in zip(sent["packed"], sent["size"], strict=True)], None)
            words = packing.words(keys)
            known = Trie.unpacked(tries.iloc[0].to_dict(), base, n).numbers(words) >= 0
            return pd.DataFrame({**dict(zip(columns, words, strict=True)), "f": np.where(known, times, 0)})

        sent = corpus.mapInArrow(send, "part int, size int, packed binary")
        there = self.built.select("block", "offset", "check", "accept", "phrases", "size", "many")
        return sent.groupBy("part").cogroup(there.groupBy("block")).applyInPandas(add, ", ".join([*(f"{c} int" for c in columns), "f long"]))

    def learn(self, found: DataFrame) -> None:
        """Keep the wrong ones of phrases that were looked up."""
        rows = found.where("f = 0").select(*names(self.n)).toArrow()
        ids = np.stack([rows[c].to_numpy().astype(np.int64) for c in names(self.n)], axis=1)
        keys = self.packing.keys(ids.reshape(-1), np.arange(len(ids)) * self.n)
        mixed = self.packing.mixed(keys)
        order = np.argsort(mixed)
        sieve = np.zeros(1 << max(6, (8 * len(ids)).bit_length()), bool)
        sieve[_sieved(mixed, len(sieve))] = True
        self.wrong = mixed[order], [k[order] for k in keys], sieve


def _sieved(mixed: np.ndarray, size: int) -> np.ndarray:
    """A place below ``size``, a power of 2: most phrases that are not wrong have one of their own and need no search."""
    return ((mixed >> np.uint64(20)) & np.uint64(size - 1)).astype(np.int64)


def tries(built: DataFrame, n: int, base: int) -> list[Tries]:
    """The tries in groups of blocks that have about ``FILTERED`` phrases: one group, but for very many phrases."""
    many, blocks, bits = built.agg(F.sum("many"), F.max("blocks"), F.max("bits")).first()
    each = math.ceil(blocks / math.ceil(many / FILTERED)) if many else 1
    return [Tries(built, n, base, blocks, bits, first, min(first + each, blocks)) for first in range(0, blocks or 0, each)]


def distinct(keys: list[np.ndarray], times: np.ndarray | None, most: int | None) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct keys in order, each as one or several columns, and their summed times, no further than ``most``; no times are ones."""
    if not len(keys[0]):
        return keys, np.zeros(0, np.int64)
    if times is None and len(keys) == 1:
        order, keys = None, [np.sort(keys[0])]
    else:
        order = np.argsort(keys[0]) if len(keys) == 1 else np.lexsort(keys[::-1])
        keys = [k[order] for k in keys]
    new = np.flatnonzero(np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], axis=0)]))
    total = np.diff(new, append=len(keys[0])) if times is None else np.add.reduceat(times[order].astype(np.int64), new)
    return [k[new] for k in keys], total if most is None else np.minimum(total, most).astype(np.int32)


class Packing:
    """Phrases of ``n`` ids below ``size`` as 64-bit keys (several columns where one is too narrow), and sorted keys as bytes.

    The first column is packed as differences: a key takes some three bytes.
    """

    def __init__(self, n: int, size: int):
        self.size, self.each = size, max(1, int(63 / math.log2(max(2, size))))
        while self.each > 1 and size**self.each >= 1 << 63:
            self.each -= 1
        self.spans = [range(at, min(n, at + self.each)) for at in range(0, n, self.each)]

    def keys(self, ids: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
        """Keys of the phrases that begin at the given positions."""
        found = []
        for span in self.spans:
            key = np.zeros(len(at), np.int64)
            for k in span:
                key = key * self.size + ids[at + k]
            found.append(key)
        return found

    def words(self, keys: list[np.ndarray]) -> list[np.ndarray]:
        """One column of ids a word."""
        found = []
        for span, key in zip(self.spans, keys, strict=True):
            found += [key // self.size ** (len(span) - 1 - k) % self.size for k in range(len(span))]
        return [ids.astype(np.int32) for ids in found]

    @staticmethod
    def mixed(keys: list[np.ndarray]) -> np.ndarray:
        """A hash of every key, which every task works out alike."""
        mixed = np.zeros(len(keys[0]), np.uint64)
        for key in keys:
            mixed = (mixed ^ key.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
            mixed *= np.uint64(0xBF58476D1CE4E5B9)
        return mixed

    @staticmethod
    def part_of(mixed: np.ndarray, parts: int) -> np.ndarray:
        return ((mixed >> np.uint64(32)) % np.uint64(parts)).astype(np.int32)

    @classmethod
    def parts(cls, keys: list[np.ndarray], parts: int) -> np.ndarray:
        """The part of every key by its hash."""
        return cls.part_of(cls.mixed(keys), parts)

    @staticmethod
    def pack(keys: list[np.ndarray], times: np.ndarray) -> bytes:
        return _pressed(np.concatenate([np.diff(keys[0], prepend=0), *keys[1:], times.astype(np.int64)]))

    def unpack(self, data: bytes, size: int) -> tuple[list[np.ndarray], np.ndarray]:
        first, *others, times = _numbers(data, size * (len(self.spans) + 1), np.int64).reshape(len(self.spans) + 1, size)
        return [np.cumsum(first), *others], times


def starts(ids: np.ndarray, n: int) -> np.ndarray:
    """The positions of ``ids`` at which ``n`` words follow one another."""
    good = ids != 0
    run = good.copy()
    for k in range(1, n):
        run[:-k] &= good[k:]
        run[-k:] = False
    return np.flatnonzero(run)


def sent_rows(batches: Iterable[pa.RecordBatch], keys_of: Callable, packing: Packing, parts: int, most: int | None, at_once: int) -> Iterator[pa.RecordBatch]:
    """(part, size, packed): the keys of a task's rows of ids, ``at_once`` of them added up at a time, no further than ``most``."""

    def rows_of(keys: list[np.ndarray], times: np.ndarray) -> Iterator[pa.RecordBatch]:
        part = packing.parts(keys, parts)
        order = np.argsort(part, kind="stable")
        spans = np.split(order, np.flatnonzero(np.diff(part[order])) + 1)
        for at in range(0, len(spans), 1 << 10):
            here = spans[at : at + (1 << 10)]
            packed = [packing.pack([k[span] for k in keys], times[span]) for span in here]
            yield pa.RecordBatch.from_arrays([pa.array([part[span[0]] for span in here], pa.int32()), pa.array([len(span) for span in here], pa.int32()), pa.array(packed, pa.binary())], names=["part", "size", "packed"])

    held, many = [], 0
    for ids, marks in _task_rows(batches):
        for keys in keys_of(ids, marks):
            held.append(distinct(keys, None, most))
            many += len(held[-1][1])
            if many > at_once:
                held = [_together(held, most)]
                many = len(held[0][1])
                if many > at_once // 2:
                    yield from rows_of(*held[0])
                    held, many = [], 0
    if many:
        yield from rows_of(*_together(held, most))


def proposals(corpus: DataFrame, n: int, least: int, size: int, parts: int) -> DataFrame:
    """(part, size, packed): the phrases of ``n`` words that may be frequent, each with its support in what a task read at once."""
    packing, at_once = Packing(n, size), KEYS

    def support(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def keys_of(ids: np.ndarray, marks: np.ndarray) -> Iterator[list[np.ndarray]]:
            good = marks != 0 if n > 2 else ids != 0
            at = np.flatnonzero(good[:-1] & good[1:])
            for first in range(0, len(at), at_once):
                yield packing.keys(ids, at[first : first + at_once])

        yield from sent_rows(batches, keys_of, packing, parts, least, at_once)

    return corpus.mapInArrow(support, "part int, size int, packed binary")


def parts_of(spark: SparkSession, positions: int) -> int:
    """Parts of which each gets about ``KEYS`` of a corpus' positions at most."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(positions / KEYS))


def proposed(corpus: DataFrame, n: int, least: int, size: int, positions: int) -> DataFrame:
    """(w1 to wn): the phrases of ``n`` words that stand ``least`` times or more where their parts are frequent.

    Two words need ids, which are below ``size``. More need marks: the phrase of the first and that of the last ``n - 1`` words are
    frequent. Support is summed only up to the threshold. A task adds up what it reads, ``KEYS`` phrases at a time, and sends the
    sorted phrases packed, one row for each part; a part gets about ``KEYS`` of the corpus' ``positions`` at most.
    """
    columns, packing = names(n), Packing(n, size)
    parts = parts_of(corpus.sparkSession, positions)

    def enough(rows: pd.DataFrame) -> pd.DataFrame:
        keys, times = _together([packing.unpack(data, many) for data, many in zip(rows["packed"], rows["size"], strict=True)], least)
        return pd.DataFrame(dict(zip(columns, packing.words([k[times >= least] for k in keys]), strict=True)))

    return proposals(corpus, n, least, size, parts).groupBy("part").applyInPandas(enough, ", ".join(f"{c} int" for c in columns))


def _together(held: list[tuple[list[np.ndarray], np.ndarray]], most: int | None) -> tuple[list[np.ndarray], np.ndarray]:
    keys = [np.concatenate(column) for column in zip(*(k for k, _ in held), strict=True)]
    return distinct(keys, np.concatenate([t for _, t in held]), most)


def counted(corpus: DataFrame, groups: Iterable[Tries], n: int) -> DataFrame:
    """(w1 to wn, f): all occurrences of the phrases of the tries, as a written table; one pass over the corpus for a group of tries."""
    found = None
    for group in groups:
        with group.filter() as filter:
            group.answers = cut_lineage(group.looked_up(corpus, filter))
        sums = group.answers.where("f > 0")
        found = sums if found is None else found.union(sums)
    return found if found is not None else corpus.sparkSession.createDataFrame([], ", ".join([*(f"{c} int" for c in names(n)), "f long"]))


def marked(corpus: DataFrame, groups: Iterable[Tries]) -> DataFrame:
    """The corpus with a mark at every position where a phrase of the tries begins; one copy of it is kept, whatever the number of tries.

    A group that was not counted before looks up the corpus' phrases first, to know the wrong ones.
    """
    spark, before = corpus.sparkSession, None
    corpus = corpus.select("size", "ids", F.lit(None).cast("binary").alias("marks"))
    for group in groups:
        if group.wrong is None:
            with group.filter() as filter:
                group.learn(group.looked_up(corpus, filter) if group.answers is None else group.answers)
        n, packing, passes, most = group.n, group.packing, group.passing(), KEYS
        with group.filter() as filter:

            def mark(batches: Iterable[pa.RecordBatch], filter: Broadcast = filter, n: int = n, packing: Packing = packing, passes: Callable = passes) -> Iterator[pa.RecordBatch]:
                for ids, marks in _task_rows(batches):
                    at, marks = starts(ids, n), marks.copy()
                    for first in range(0, len(at), most):
                        here = at[first : first + most]
                        marks[here[passes(packing.keys(ids, here), filter.value)]] = 1
                    row = [pa.array([len(ids) - 1], pa.int32()), pa.array([_pressed(ids[:-1])], pa.binary()), pa.array([np.packbits(marks[:-1]).tobytes()], pa.binary())]
                    yield pa.RecordBatch.from_arrays(row, names=["size", "ids", "marks"])

            corpus, path = cut_lineage(corpus.mapInArrow(mark, "size int, ids binary, marks binary")), scratch_paths(spark)[-1]
        if before:
            drop_written(spark, before)
        before = path
    return corpus


def scored(levels: dict[int, DataFrame], n: int, words: DataFrame) -> DataFrame:
    """(w1 to wn, lang, a, l, r, score) of all phrases of ``n`` words by their lowest-scoring cut; exact for counts below 10^15."""
    found = levels[n].withColumnRenamed("f", "a")
    by_id = words.select(F.col("id").alias("w1"), "lang", F.col("f").alias("l1"))
    found = checked_lookup(found, by_id, ["w1"], names(n), "inner")

    def part(first: int, size: int, name: str) -> DataFrame:
        inner = names(size, first)
        if size == 1:
            return checked_lookup(found, words.select(F.col("id").alias(inner[0]), F.col("f").alias(name)), inner, names(n), "inner")
        return found.join(levels[size].toDF(*inner, name), inner)

    for k in range(1, n):
        if k > 1:
            found = part(1, k, f"l{k}")
        found = part(k + 1, n - k, f"r{k}")
    cuts = []
    for k in range(1, n):
        score = F.expr(f"(cast(1000000 as decimal(7,0)) * cast(a as decimal(15,0)) * cast(a as decimal(15,0))) div (cast(l{k} as decimal(15,0)) * cast(r{k} as decimal(15,0)))")
        cuts.append(F.struct(score.cast("long").alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")))
    lowest = F.array_min(F.array(*cuts))
    return found.select(*names(n), "lang", "a", lowest.alias("x")).select(*names(n), "lang", "a", "x.l", "x.r", "x.score")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each language by score, count and spelling.

    Phrases have 2 to ``longest`` words within a piece of text between ``.,;:!?`` and line ends, and stand ``least`` times or more. The score
    is 1,000,000 a a / (l r), rounded down, at the cut into two parts (counts l and r) where it is lowest, the first such
    cut among ties. Phrases that lie inside a longer one with at least half their count are left out. A null language is ``und``, a null
    text is empty; repeated rows count each; a table without frequent phrases gives no row.
    """
    corpus = docs.select(F.coalesce(F.col(f"`{lang}`"), F.lit("und")).alias("lang"), F.col(f"`{text}`").alias("text"))
    counts = cut_lineage(word_counts(corpus).where(F.col("word").isNull() | (F.col("f") >= least)))
    totals = counts.where("word is null").select("lang", F.col("f").alias("n"))
    ids, words = number_words(corpus, counts.where("word is not null"))
    base = math.isqrt(words.agg(F.max("id")).first()[0] or 0) + 1
    positions = totals.agg(F.sum("n")).first()[0] or 0
    levels: dict[int, DataFrame] = {}
    for n in range(2, longest + 1):
        with few_rows(docs.sparkSession):
            candidates = cut_lineage(proposed(ids, n, least, base * base, positions))
        groups = tries(built_tries(candidates, n, base, parts_of(docs.sparkSession, positions)), n, base)
        with few_rows(docs.sparkSession):
            levels[n] = counted(ids, groups, n)
            if n < longest:
                ids = marked(ids, groups)
    parts = max(8, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    best = None
    for n in range(2, longest + 1):
        found = scored(levels, n, words)
        covers = [levels[m].select(*(F.col(f"w{o + i}").alias(f"w{i}") for i in range(1, n + 1)), "f") for m in range(n + 1, longest + 1) for o in range(m - n + 1)]
        if covers:
            inside = covers[0]
            for more in covers[1:]:
                inside = inside.union(more)
            inside = inside.groupBy(*names(n)).agg(F.max("f").alias("longer"))
            found = found.join(inside, names(n), "left").where(F.col("longer").isNull() | (100 * F.col("longer") < 50 * F.col("a"))).drop("longer")
        # The best of each share of a language hold the best of all; ties at the end stay until words are known.
        shares = Window.partitionBy("lang", F.pmod(F.xxhash64(*names(n)), F.lit(parts))).orderBy(F.desc("score"), F.desc("a"))
        found = found.withColumn("place", F.rank().over(shares)).where(F.col("place") <= top)
        found = found.select("lang", F.array(*names(n)).alias("ids"), "a", "l", "r", "score")
        best = found if best is None else best.union(found)
    best = cut_lineage(best.withColumn("place", F.rank().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a")))).where(F.col("place") <= top).drop("place"))
    spelled = best.select("ids", F.posexplode("ids").alias("at", "id")).join(words.select("id", "word"), "id").groupBy("ids").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("spelled"))
    phrase = F.array_join(F.transform("spelled", lambda x: x["word"]), " ").alias("phrase")
    last = best.join(spelled.select("ids", phrase), "ids").join(F.broadcast(totals), "lang")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))).cast("long")
    return last.withColumn("rank", rank).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE_SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT lang, d, unnest(x) AS piece, generate_subscripts(x, 1) AS p FROM (SELECT lang, d, regexp_split_to_array(t, '[.,;:!?

]') AS x FROM docs)),
words AS (SELECT lang, d, p, unnest(x) AS w1, generate_subscripts(x, 1) AS i
    FROM (SELECT lang, d, p, list_filter(regexp_split_to_array(piece, '[ 	]+'), lambda w: w <> '') AS x FROM pieces)),
runs AS (SELECT lang, w1, lead(w1) OVER s AS w2, lead(w1, 2) OVER s AS w3 FROM words WINDOW s AS (PARTITION BY d, p ORDER BY i)),
f1 AS (SELECT lang, w1, count(*) AS f FROM runs GROUP BY ALL),
f2 AS (SELECT lang, w1, w2, count(*) AS f FROM runs WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= {LEAST}),
f3 AS (SELECT lang, w1, w2, w3, count(*) AS f FROM runs WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= {LEAST}),
totals AS (SELECT lang, sum(f) AS n FROM f1 GROUP BY lang),
cuts AS (
    SELECT x.lang, x.w1 || ' ' || x.w2 AS phrase, x.f AS a, 1 AS k, p.f AS l, q.f AS r
    FROM f2 x JOIN f1 p ON p.lang = x.lang AND p.w1 = x.w1 JOIN f1 q ON q.lang = x.lang AND q.w1 = x.w2
    WHERE NOT EXISTS (SELECT 1 FROM f3 y WHERE y.lang = x.lang AND y.w1 = x.w1 AND y.w2 = x.w2 AND 100 * y.f >= 50 * x.f)
      AND NOT EXISTS (SELECT 1 FROM f3 y WHERE y.lang = x.lang AND y.w2 = x.w1 AND y.w3 = x.w2 AND 100 * y.f >= 50 * x.f)
    UNION ALL
    SELECT x.lang, x.w1 || ' ' || x.w2 || ' ' || x.w3, x.f, 1, p.f, q.f
    FROM f3 x JOIN f1 p ON p.lang = x.lang AND p.w1 = x.w1 JOIN f2 q ON q.lang = x.lang AND q.w1 = x.w2 AND q.w2 = x.w3
    UNION ALL
    SELECT x.lang, x.w1 || ' ' || x.w2 || ' ' || x.w3, x.f, 2, p.f, q.f
    FROM f3 x JOIN f2 p ON p.lang = x.lang AND p.w1 = x.w1 AND p.w2 = x.w2 JOIN f1 q ON q.lang = x.lang AND q.w1 = x.w3),
valued AS (SELECT *, (1000000::HUGEINT * a * a) // (l::HUGEINT * r) AS score FROM cuts),
lowest AS (SELECT * FROM valued QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked JOIN totals USING (lang) WHERE rank <= {TOP}
"""
