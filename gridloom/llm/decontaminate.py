"""Copies of test items in training texts: rare word n-grams as seeds, Smith-Waterman alignment as the judge."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import arrow_map, keep_rows

SEED_WORDS = 3
RARE = 4
LEAST_SCORE = 0.6
BLOCK_BYTES = 32_000_000
BLOCK_ITEMS = 20_000

_TOKEN = re.compile(r"\w+")


def words(text: str | None) -> list[str]:
    return _TOKEN.findall((text or "").lower())


def seeds_left(m: int, least: float, n: int) -> int:
    """How many n-grams of an item of ``m`` words every alignment with a score of ``least`` per word leaves whole.

    With M equal words the score leaves room for M - least * m others, replaced, added or left out in any mix. Each of them
    ends a run of equal words, and a run loses n - 1 n-grams.
    """
    slack = ((equal, int(equal - least * m + 1e-9)) for equal in range(1, m + 1) if equal >= least * m - 1e-9)
    return min((equal - (n - 1) * (others + 1) for equal, others in slack), default=0)


class Block:
    """A block of test items as word ids, with an index of their n-grams.

    Seeds are the longest n-grams, up to ``seed`` words, of which every copy that scores ``least`` keeps some
    (``seeds_left``). An n-gram is rare if at most ``RARE`` items of the block hold it. Others are no seeds as long as a
    copy keeps a rare one without them, so which are rare changes the work and not the result. Rarity is taken over the
    items, not over the training texts: a test item that was copied into a third of them keeps its seeds.
    """

    def __init__(self, items: list[tuple[int, str | None]], least: float = LEAST_SCORE, seed: int = SEED_WORDS):
        self.least, self.seed = least, seed
        self.vocabulary: dict[str, int] = {}
        self.items: list[tuple[int, np.ndarray]] = []
        for item, text in items:
            own = words(text)
            if own:
                self.items.append((item, np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in own], dtype=np.int64)))
        self.base = len(self.vocabulary) + 1
        grams = []
        held: Counter = Counter()
        lengths = [next((n for n in range(min(seed, len(ids)), 1, -1) if seeds_left(len(ids), least, n) > 0), 1) for _, ids in self.items]
        for (_, ids), n in zip(self.items, lengths, strict=True):
            own = self.codes(ids, n).tolist()
            grams.append(own)
            held.update(set(own))
        self.places: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.needed: list[int] = []
        self.bags: list[tuple[np.ndarray, np.ndarray]] = []
        for number, ((_, ids), own, n) in enumerate(zip(self.items, grams, lengths, strict=True)):
            left = max(1, seeds_left(len(ids), least, n))
            common = sorted((at for at, g in enumerate(own) if held[g] > RARE), key=lambda at: -held[own[at]])[: left - 1]
            for at in sorted(set(range(len(own))) - set(common)):
                self.places[own[at]].append((number, at))
            self.needed.append(left - len(common))
            self.bags.append(np.unique(ids, return_counts=True))
        self.sizes = sorted(set(lengths))
        self.known = {n: np.array(sorted(g for g in self.places if self._size(g) == n), dtype=np.int64 if self.base**n < 2**62 else object) for n in self.sizes}

    def _size(self, code: int) -> int:
        n = 0
        while code:
            code //= self.base
            n += 1
        return n

    def codes(self, ids: np.ndarray, n: int) -> np.ndarray:
        """A number for the n-gram at each position; 0 where it has a word that no item has. Ids start at 1."""
        if len(ids) < n or n == 0:
            return np.zeros(0, dtype=np.int64)
        # Python's own integers where the product could leave 64 bits.
        kind = np.int64 if self.base**n < 2**62 else object
        out = np.zeros(len(ids) - n + 1, dtype=kind)
        full = np.ones(len(out), dtype=bool)
        for i in range(n):
            part = ids[i : len(ids) - n + 1 + i]
            out = out * self.base + part.astype(kind)
            full &= part > 0
        return np.where(full, out, 0)

    def _shared(self, window: np.ndarray, number: int) -> int:
        """Words that the window and the item share, in any order: no alignment has more equal words."""
        own, counts = self.bags[number]
        at = np.minimum(np.searchsorted(own, window), len(own) - 1)
        found = np.bincount(at[own[at] == window], minlength=len(own))
        return int(np.minimum(found, counts).sum())

    def matches(self, text: str | None) -> list[tuple[int, float, int, int]]:
        """(item, score, first word, end word) for every item with a copy in the text; the best copy of each."""
        ids = np.array(list(map(self.vocabulary.get, words(text), repeat(0))), dtype=np.int64)
        hits: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for n in self.sizes:
            codes, known = self.codes(ids, n), self.known[n]
            # Only places whose words all occur in the items are looked up, by bisection.
            full = np.flatnonzero(codes != 0)
            if not len(full) or not len(known):
                continue
            near = np.minimum(np.searchsorted(known, codes[full]), len(known) - 1)
            for at in full[known[near] == codes[full]]:
                for number, place in self.places[int(codes[at])]:
                    hits[number].append((int(at), place))
        found = []
        for number, own in hits.items():
            item, target = self.items[number]
            m = len(target)
            # Words that a copy may have more, or leave out, in all.
            slack = int((1 - self.least) * m + 1e-9)
            best = (0.0, 0, 0)
            tried: set[tuple[int, int]] = set()
            # Seeds of one copy start it at about the same word: runs of starts, each seed kept.
            starts = sorted(at - place for at, place in own)
            lo = 0
            while lo < len(starts):
                hi = lo + 1
                while hi < len(starts) and starts[hi] - starts[hi - 1] <= slack:
                    hi += 1
                if hi - lo >= self.needed[number]:
                    window = (max(0, starts[lo] - slack), min(len(ids), starts[hi - 1] + m + slack))
                    if window not in tried and self._shared(ids[window[0] : window[1]], number) >= self.least * m:
                        tried.add(window)
                        score, s, e = align(ids[window[0] : window[1]], target)
                        if (score, -window[0] - s) > (best[0], -best[1]):
                            best = (score, window[0] + s, window[0] + e)
                lo = hi
            if best[0] / m >= self.least:
                found.append((item, best[0] / m, best[1], best[2]))
        return sorted(found)


def align(window: np.ndarray, target: np.ndarray) -> tuple[float, int, int]:
    """Smith-Waterman with +1 for equal words, -1 for others and for gaps: (score, start, end) in ``window``.

    Row by row over the target; gaps along the window are a running maximum. Of equal scores the first end wins, of
    equal alignments the one that starts last, the shortest.
    """
    n = len(window)
    if n == 0 or len(target) == 0:
        return 0.0, 0, 0
    slope = np.arange(n + 1)
    row = np.zeros(n + 1, dtype=np.int64)
    # Score and start in one number, so that one maximum carries both along.
    scale = 2 * (n + 1)
    best, where = 0, (0, 0)
    start = slope.copy()
    row = start.copy()  # score * scale + start of the alignment
    for word in target:
        diagonal = row[:-1] + np.where(window == word, scale, -scale)
        up = row[1:] - scale
        now = np.concatenate([[0], np.maximum(diagonal, up)])
        now = np.maximum(now, slope)
        now = np.maximum.accumulate(now + slope * scale) - slope * scale
        now = np.maximum(now, slope)
        row = now
        scores = row // scale
        at = int(scores.argmax())
        if scores[at] > best:
            best, where = int(scores[at]), (int(row[at] % scale), at)
    return float(best), where[0], where[1]


def _blocks(items: DataFrame, key: str, text: str, block_bytes: int, block_items: int):
    """Test items in blocks small enough to send to every task, whatever their number."""
    size = F.coalesce(F.octet_length(text), F.lit(0)) + 64
    rows, volume = items.agg(F.count(F.lit(1)), F.sum(size)).first()
    parts = max(1, -(-rows // block_items), -(-int(volume or 0) // block_bytes))
    part = F.pmod(F.xxhash64(key, text), F.lit(parts))
    for number in range(parts if rows else 0):
        yield sorted(((r[0], r[1]) for r in items.where(part == number).select(key, text).collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))


def contaminated(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
    least: float = LEAST_SCORE, block_bytes: int = BLOCK_BYTES, block_items: int = BLOCK_ITEMS,
) -> DataFrame:
    """(key, item key, score, start, end): every row of ``docs`` with a copy of a test item, and where it lies.

    ``score`` is the alignment score divided by the words of the item; ``least`` of 0.6 admits one word in five
    replaced, or two added for every five. ``start`` and ``end`` count words. Words are lower-cased runs of letters, digits and underscores.
    The join on seeds happens where the texts are, against one block of items at a time, so texts are not shuffled and
    no seed, however common, gathers rows. Null and empty texts or items match nothing; repeated items give a row each,
    as do repeated texts; empty tables give an empty result; other columns are not read.
    """
    kind, item_kind = docs.schema[key].dataType.simpleString(), items.schema[item_key].dataType.simpleString()
    schema = f"key {kind}, item {item_kind}, score double, start int, end int"
    chosen = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.length("text") > 0)
    result = None
    for block_rows in _blocks(items, item_key, item_text, block_bytes, block_items):
        sent = docs.sparkSession.sparkContext.broadcast(Block(block_rows, least))

        def rows(part: dict, sent=sent) -> dict:
            out: dict[str, list] = {"key": [], "item": [], "score": [], "start": [], "end": []}
            for k, t in zip(part["key"], part["text"], strict=True):
                for item, score, s, e in sent.value.matches(t):
                    for name, value in zip(out, (k, item, score, s, e), strict=True):
                        out[name].append(value)
            return out

        found = arrow_map(chosen, rows, schema)
        result = found if result is None else result.unionByName(found)
    if result is None:
        result = docs.sparkSession.createDataFrame([], schema)
    return result.withColumnsRenamed({"key": key, "item": item_key})


def keep_clean(
    docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text",
    least: float = LEAST_SCORE, block_bytes: int = BLOCK_BYTES, block_items: int = BLOCK_ITEMS,
) -> DataFrame:
    """The rows of ``docs`` without a copy of a test item, with all their columns. Null texts are clean."""
    out = docs
    for block_rows in _blocks(items, item_key, item_text, block_bytes, block_items):
        sent = docs.sparkSession.sparkContext.broadcast(Block(block_rows, least))
        out = keep_rows(out, [text], lambda texts, sent=sent: [not sent.value.matches(t) for t in texts])
    return out
