"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals."""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm import crf
from gridloom.llm.common import arrow_map, labelled_sample
from gridloom.session import cut_lineage

FIT_ROWS = 8000
FIT_WINDOWS = 3000
LEXICON = 2000
THRESHOLD = 0.3
SPAN_THRESHOLD = 0.5
CLEAN, TOXIC = 0, 1

_TOKEN = re.compile(r"\w+")
_SIZE = 1 << 15


def features(token: str) -> list[str]:
    """The word, its ends and its form."""
    form = "A" if token.isupper() else "a" if token.islower() else "0" if token.isdigit() else "Aa"
    word = token.lower()
    return ["bias", f"w{word}", f"p{word[:4]}", f"e{word[-4:]}", f"f{form}", f"n{min(len(word), 15)}"]


def _lexicon(drawn: DataFrame) -> set[str]:
    """Words far more frequent in toxic documents: these label the tokens of the training documents.

    A word counts once per document, by the least of the hashes of its neighbours there, and documents with equal hashes
    count once, so words that only come along in copies of one text, or often in one document, count little. Taken are words with a z-value above 5 that are five times
    as frequent in toxic documents, at most ``LEXICON``, those of the highest z-value.
    """
    tokens = F.regexp_extract_all(F.lower("text"), F.lit(r"((?U)\w+)"), 1)
    each = drawn.select("y", F.xxhash64("text").alias("doc"), tokens.alias("w")).select("y", "doc", "w", F.posexplode("w").alias("at", "word"))
    around = F.xxhash64(F.try_element_at("w", F.col("at")), F.try_element_at("w", F.col("at") + 2))
    around = F.when(F.col("at") > 0, around).otherwise(F.xxhash64(F.lit(""), F.try_element_at("w", F.lit(2))))
    once = each.select("y", "doc", "word", around.alias("around")).groupBy("word", "y", "doc").agg(F.min("around").alias("around"))
    counts = once.groupBy("word", "y").agg(F.count_distinct("around").alias("n"))
    counts = counts.groupBy("word").agg(F.sum(F.col("n") * F.col("y")).alias("bad"), F.sum(F.col("n") * (1 - F.col("y"))).alias("good"))
    total = {r["y"]: r["n"] for r in drawn.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    bad, good = max(1, total.get(1, 0)), max(1, total.get(0, 0))
    p, q = F.col("bad") / bad, F.col("good") / good
    shared = (F.col("bad") + F.col("good")) / (bad + good)
    z = (p - q) / F.sqrt(F.abs(shared * (1 - shared)) * (1 / bad + 1 / good) + 1e-12)
    strong = counts.where((F.col("bad") >= 3) & (p >= 5 * (q + 0.5 / good))).select("word", z.alias("z")).where("z > 5")
    return {r["word"] for r in strong.orderBy(F.desc("z"), "word").limit(LEXICON).collect()}


def _windows(text: str, y: int, lexicon: set[str], around: int = 10) -> list[tuple[list[str], list[int]]]:
    tokens = _TOKEN.findall(text)
    states = [int(y == 1 and t.lower() in lexicon) for t in tokens]
    hits = [i for i, s in enumerate(states) if s][:6]
    out = [(tokens[max(0, i - around) : i + around], states[max(0, i - around) : i + around]) for i in hits]
    step = max(1, len(tokens) // 2)
    for i in range(0, len(tokens), step):
        part = states[i : i + 2 * around]
        if part and not any(part):
            out.append((tokens[i : i + 2 * around], part))
    return out


class Model:
    """The chain and the logistic step from a document's marginals to its score.

    A word that no training window held stands for all of its case and length, unless it begins or ends like a toxic one.
    """

    def __init__(self, chain: crf.Chain, weights: np.ndarray, known: frozenset[str] = frozenset(), affixes: frozenset[str] = frozenset()):
        self.chain, self.weights, self.known, self.affixes = chain, weights, known, affixes
        self.tokens = None

    def form(self, token: str) -> str | None:
        word = token.lower()
        if word in self.known or word[:4] in self.affixes or word[-4:] in self.affixes:
            return None
        low = "q" * min(len(word), 15)
        return low if token.islower() else low.upper() if token.isupper() else "0" * min(len(word), 15) if token.isdigit() else low.title()

    def marginals(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if self.tokens is None:
            self.tokens = crf.TokenScores(self.chain, features, self.form)
        scores, lengths = self.tokens.emissions([_TOKEN.findall(t) for t in texts], np.ones((len(texts), 1)))
        return crf.marginals(self.chain, scores, lengths)[:, TOXIC], lengths

    @staticmethod
    def summary(p: np.ndarray) -> list[float]:
        """What a document's token marginals say together: chance of any toxic token, the surest token, how many."""
        if not len(p):
            return [1.0, 0.0, 0.0, 0.0]
        any_toxic = 1 - math.exp(float(np.log1p(-np.minimum(p, 1 - 1e-9)).clip(min=-30).sum()))
        clear = p[p > 0.05].sum()
        return [1.0, any_toxic, float(p.max()), math.log1p(float(clear))]

    def judge(self, texts: list[str]) -> list[tuple[float, list[tuple[int, int]]]]:
        """(score, toxic spans) of each text."""
        p, lengths = self.marginals(texts)
        out, at = [], 0
        for t, n in zip(texts, lengths, strict=True):
            own = p[at : at + n]
            at += n
            z = float(np.dot(self.weights, self.summary(own)))
            spans: list[tuple[int, int]] = []
            if n and own.max() >= SPAN_THRESHOLD:
                last = -2
                for i, m in enumerate(_TOKEN.finditer(t)):
                    if own[i] >= SPAN_THRESHOLD:
                        if last == i - 1:
                            spans[-1] = (spans[-1][0], m.end())
                        else:
                            spans.append(m.span())
                        last = i
            out.append((1 / (1 + math.exp(-max(-30.0, min(30.0, z)))), spans))
        return out


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Newton's method on the weighted logistic loss."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w -= np.linalg.solve(curve, x.T @ (weight * (p - y)) + ridge * w)
    return w


def fit(documents: DataFrame, labels: DataFrame, training: Column, rows: int = FIT_ROWS, most: int = FIT_WINDOWS) -> Model:
    """Train on about ``rows`` labelled documents, half of each class.

    Their strongly toxic words label the tokens; at most ``most`` different windows of 20 tokens with and without toxic ones train
    the chain on the driver, so copies of one text take no places of others; the marginals of the same documents, summed up per document, train the last step.
    """
    drawn, restore = labelled_sample(documents, labels, "toxic", training, rows)
    lexicon = _lexicon(drawn)

    def cut(part: dict) -> dict:
        found = [w for t, y in zip(part["text"], part["y"], strict=True) for w in _windows(t, y, lexicon)]
        return {"words": [w for w, _ in found], "states": [s for _, s in found]}

    made = cut_lineage(arrow_map(drawn, cut, "words array<string>, states array<int>").dropDuplicates(["words", "states"]))
    chosen = []
    for hit in (True, False):
        kind = made.where(F.array_max("states") > 0 if hit else F.array_max("states") == 0)
        chosen += kind.orderBy(F.xxhash64("words"), "words", "states").limit(most).collect()
    windows = [([crf.hashed(features(w), _SIZE) for w in r["words"]], np.ones(1), list(r["states"])) for r in chosen]
    known = frozenset(w.lower() for r in chosen for w in r["words"])
    affixes = frozenset(a for w in lexicon if len(w) >= 4 for a in (w[:4], w[-4:]))
    model = Model(crf.train(windows, 2, _SIZE, 1), np.zeros(4), known, affixes)

    def summed(part: dict) -> dict:
        p, lengths = model.marginals(part["text"])
        ends = np.cumsum(lengths)
        return {"y": part["y"], "x": [Model.summary(p[e - n : e]) for e, n in zip(ends, lengths, strict=True)]}

    rows_in = arrow_map(drawn, summed, "y int, x array<double>").orderBy("y", F.xxhash64("x")).collect()
    if rows_in:
        y = np.array([r["y"] for r in rows_in], dtype=float)
        weights = _logistic(np.array([r["x"] for r in rows_in]), y, np.array([restore[r["y"]] for r in rows_in]))
        model = Model(model.chain, weights, known, affixes)
    return model


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score, spans): the chance that the text is toxic and its toxic stretches (start, end in code points).

    A null text counts as empty; all empty texts get the same low score. Repeated rows get equal results, null keys stay;
    no other column is read. Without labels every score is 0.5. No row is compared with another.
    """

    def rows(part: dict) -> dict:
        judged = model.judge([t or "" for t in part["text"]])
        return {"key": part["key"], "score": [s for s, _ in judged], "spans": [[{"start": a, "end": b} for a, b in spans] for _, spans in judged]}

    kind = docs.schema[key].dataType.simpleString()
    chosen = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return arrow_map(chosen, rows, f"key {kind}, score double, spans array<struct<start:int,end:int>>").withColumnRenamed("key", key)
