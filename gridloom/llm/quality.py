"""Text quality by a factorisation machine over hashed words, structure statistics and metadata.

score = w0 + sum_i w_i x_i + 1/2 sum_f [ (sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2 ]: all pairs of features interact through
low-rank factors, in time linear in the number of features present.
"""

from __future__ import annotations

import math
from zlib import crc32

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import arrow_map, keep_rows, labelled_sample

WORD_BUCKETS = 1 << 13
RANK = 8
FIT_ROWS = 6000
EPOCHS = 8
THRESHOLD = 0.5

_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LETTERS = _UPPER + _UPPER.lower() + bytes(range(128, 256))
_DIGITS = b"0123456789"
_PLAIN_MARKS = b".,;:'\"()?-"
_OTHER_MARKS = bytes(c for c in range(33, 127) if c not in _LETTERS + _DIGITS + _PLAIN_MARKS)
STATISTICS = 18


class WordBuckets(dict):
    """word -> bucket, emptied when it holds ``most`` words."""

    def __init__(self, most: int = 200_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = bucket = crc32(word.encode("utf-8", "surrogatepass")) % WORD_BUCKETS
        return bucket


def describe(text: str, n_chars: int | None, buckets: WordBuckets) -> tuple[np.ndarray, np.ndarray]:
    """(word buckets present, statistics). Words are lower-cased and cut at blanks; statistics lie around zero to one."""
    words = text.lower().split()
    ids = np.unique(np.fromiter(map(buckets.__getitem__, words), dtype=np.int64, count=len(words)))
    raw = text.encode("utf-8", "surrogatepass")
    size = max(1, len(raw))

    def share(of: bytes) -> float:
        return (len(raw) - len(raw.translate(None, of))) / size

    n = len(words)
    lines = text.split("\n")
    filled = [x for x in lines if x.strip()]
    letters = share(_LETTERS)
    different = set(words)
    counted = len(text) if n_chars is None else n_chars
    stats = np.array([
        1.0,
        min(1.0, math.log1p(n) / 10),
        min(1.0, math.log1p(max(0, counted)) / 12),
        min(2.0, len(text) / max(1, n) / 10),
        share(_UPPER) / letters if letters else 0.0,
        letters,
        min(1.0, 5 * share(_DIGITS)),
        min(1.0, 5 * share(_PLAIN_MARKS)),
        min(1.0, 5 * share(_OTHER_MARKS)),
        min(1.0, 5 * share(b"|#<>{}=")),
        len(different) / max(1, n),
        1 - len(set(filled)) / max(1, len(filled)),
        min(1.0, len(filled) / max(1, n) * 5),
        min(1.0, sum(len(w) > 20 for w in words) / max(1, n) * 20),
        min(1.0, sum(map(len, different)) / max(1, len(different)) / 10),
        min(1.0, 5 * share(b"!?")),
        sum(not w[-1].isalnum() for w in words) / max(1, n),
        float(n == 0),
    ])
    return ids, stats


class Machine:
    """Weights of the bias, the statistics and the word buckets, and their factors."""

    def __init__(self, rank: int = RANK, seed: int = 11):
        rng = np.random.default_rng(seed)
        many = WORD_BUCKETS + STATISTICS
        self.bias = 0.0
        self.linear = np.zeros(many)
        self.factors = rng.normal(0, 0.02, (many, rank))

    @staticmethod
    def row(ids: np.ndarray, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Feature numbers and values; the words of a text share a length of one."""
        words = np.full(len(ids), 1 / math.sqrt(len(ids)) if len(ids) else 0.0)
        return np.concatenate([ids, WORD_BUCKETS + np.arange(STATISTICS)]), np.concatenate([words, stats])

    def margin(self, at: np.ndarray, x: np.ndarray) -> float:
        own = self.factors[at] * x[:, None]
        summed = own.sum(0)
        return self.bias + float(self.linear[at] @ x) + 0.5 * float(summed @ summed - (own * own).sum())

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, weight: np.ndarray, epochs: int = EPOCHS, rate: float = 0.1, decay: float = 1e-5) -> None:
        """AdaGrad on the weighted logistic loss, one row at a time in a fixed random order."""
        rng = np.random.default_rng(5)
        seen_b, seen_l, seen_f = 1e-6, np.full(self.linear.shape, 1e-6), np.full(self.factors.shape, 1e-6)
        for _ in range(epochs):
            for i in rng.permutation(len(rows)):
                at, x = rows[i]
                own = self.factors[at]
                summed = x @ own
                z = self.bias + float(self.linear[at] @ x) + 0.5 * float(summed @ summed - ((own * x[:, None]) ** 2).sum())
                g = weight[i] * (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - y[i])
                seen_b += g * g
                self.bias -= rate * g / math.sqrt(seen_b)
                gl = g * x + decay * self.linear[at]
                seen_l[at] += gl * gl
                self.linear[at] -= rate * gl / np.sqrt(seen_l[at])
                gf = g * (x[:, None] * summed - own * (x * x)[:, None]) + decay * own
                seen_f[at] += gf * gf
                self.factors[at] -= rate * gf / np.sqrt(seen_f[at])


def fit(documents: DataFrame, labels: DataFrame, training: Column, rows: int = FIT_ROWS) -> Machine:
    """Train on about ``rows`` labelled documents (half of each class, reweighted to the true shares).

    Only their features come to the driver. Without any labels the machine scores 0.5.
    """
    drawn, restore = labelled_sample(documents, labels, "quality", training, rows)

    def featured(part: dict) -> dict:
        buckets = WordBuckets()
        found = [describe(t or "", n, buckets) for t, n in zip(part["text"], part["n_chars"], strict=True)]
        return {"y": part["y"], "ids": [i.tolist() for i, _ in found], "stats": [s.tolist() for _, s in found]}

    known = arrow_map(drawn, featured, "y int, ids array<int>, stats array<double>").orderBy(F.xxhash64("ids", "stats"), "y").collect()
    machine = Machine()
    if known:
        y = np.array([r["y"] for r in known], dtype=float)
        weight = np.array([restore[r["y"]] for r in known])
        machine.fit([Machine.row(np.array(r["ids"], dtype=np.int64), np.array(r["stats"])) for r in known], y, weight / weight.mean())
    return machine


def score(docs: DataFrame, machine: Machine, key: str = "doc_id", text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """(key, score): the chance of label 1 for every row, from its text and its ``n_chars`` (None or null: counted) alone.

    A null text counts as empty; empty texts are scored like any other, so all of them alike. Repeated rows get
    equal scores, null keys stay; no other column is read. No row is compared with another, so nothing is shuffled.
    """
    scorer = _Scorer(machine)

    def rows(part: dict) -> dict:
        return {"key": part["key"], "score": scorer.scores(part["text"], part["n"])}

    kind = docs.schema[key].dataType.simpleString()
    counted = F.col(n_chars).cast("long") if n_chars else F.lit(None).cast("long")
    chosen = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), counted.alias("n"))
    return arrow_map(chosen, rows, f"key {kind}, score double").withColumnRenamed("key", key)


class _Scorer:
    def __init__(self, machine: Machine):
        self.machine = machine
        self.buckets = WordBuckets()

    def scores(self, texts: list[str | None], counted: list[int | None]) -> list[float]:
        margins = np.array([self.machine.margin(*Machine.row(*describe(t or "", n, self.buckets))) for t, n in zip(texts, counted, strict=True)])
        return (1 / (1 + np.exp(-np.clip(margins, -30, 30)))).tolist()


def keep_good(docs: DataFrame, machine: Machine, text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """The rows of ``docs`` that the machine doesn't reject, with all their columns. Null texts are judged as empty ones."""
    scorer = _Scorer(machine)
    return keep_rows(docs, [text, n_chars], lambda texts, counted: [s >= THRESHOLD for s in scorer.scores(texts, counted)])
