"""Secrets by fixed patterns and by a linear-chain conditional random field over tokens."""

from __future__ import annotations

import math
import random
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import crf
from gridloom.llm.common import BUCKETS, arrow_map
from gridloom.session import cut_lineage

KINDS = ("assign", "access", "hex", "tagged")
SPANS = "array<struct<kind:string,start:int,end:int,base:boolean>>"
FIT_DOCUMENTS = 4000
FIT_WINDOWS = 3000
OUTSIDE, BEGIN, INSIDE = 0, 1, 2

_ASSIGN = re.compile(r"(?i:password|passwd|secret|token|api_?key)[\"']? *[:=] *[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")  # the same spans as runs of any length of which those under 16 are dropped
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_TOKEN = re.compile(r"[\w+/-]+(?:=+(?!\w))?|[^\s\w+/-]")
_SIZE = 1 << 14


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns, by start and kind."""
    found = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def _entropy(token: str) -> float:
    n = len(token)
    return -sum(c / n * math.log2(c / n) for c in (token.count(x) for x in set(token)))


def features(token: str) -> list[str]:
    """Case and length of plain words, the word itself if it is short; mixture, runs and entropy of all else."""
    n = len(token)
    case = "a" if token.islower() else "A" if token.isupper() else "Aa" if token.istitle() else "aA"
    if token.isalpha() and n < 16:
        return ["bias", f"p{case}{min(n, 12)}", f"w{token.lower()}"]
    if n == 1:
        return ["bias", f"w{token}"]
    classes = case + "0" * any(c.isdigit() for c in token) + "_" * (not token.isalnum())
    swaps = sum(a.isdigit() != b.isdigit() for a, b in zip(token, token[1:], strict=False))
    out = ["bias", f"n{n if n < 12 else 8 + min(n // 4, 12)}", f"c{classes}", f"x{min(swaps, 6)}", f"k{classes}{min(swaps, 4)}{min(n // 8, 5)}"]
    if n >= 8:
        out.append(f"e{round(_entropy(token[:256]) * 2)}")
    return out


def file_features(text: str) -> list[float]:
    """What kind of file it is: shares of marks that code and settings use."""
    n = max(1, len(text))
    return [1.0, min(1.0, 20 * sum(text.count(c) for c in "=:{};\"'") / n), float(any(w in text.lower() for w in _WORDS))]


def _states(tokens: list[tuple[int, int]], spans: list[tuple[int, int, int]], text: str) -> list[int]:
    """Begin/inside/outside of each token; of an assignment only its value counts."""
    secret = []
    for s, kind, e in spans:
        if kind == 0:
            s = _ASSIGN.match(text, s).start(1)
        secret.append((s, e))
    states, which, last = [], 0, None
    secret.sort()
    for s, e in tokens:
        while which < len(secret) and secret[which][1] <= s:
            which += 1
        if which < len(secret) and secret[which][0] < e:
            states.append(INSIDE if last == which else BEGIN)
            last = which
        else:
            states.append(OUTSIDE)
            last = None
    return states


def _invented(rng: random.Random) -> str:
    """A made-up secret in one of the public forms: prefix and random characters. Teaches shapes the patterns miss."""
    upper, lower, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    prefix, letters, low, high = rng.choice([
        ("ghp_", upper + lower + digits, 36, 36), ("sk-", upper + lower + digits, 32, 48), ("xoxb-", digits + lower, 24, 48),
        ("AIza", upper + lower + digits + "_-", 35, 35), ("", upper + lower + digits + "+/", 24, 64), ("", "0123456789abcdef", 32, 64),
        ("AKIA", upper + digits, 16, 16), ("glpat-", upper + lower + digits, 20, 20),
    ])
    return prefix + "".join(rng.choice(letters) for _ in range(rng.randint(low, high)))


def windows(text: str, around: int = 12) -> list[tuple[list[str], list[float], list[int]]]:
    """Training windows of a text: around each base span, the same with invented secrets in place, and one without any."""
    tokens = [m.span() for m in _TOKEN.finditer(text)]
    states = _states(tokens, base_spans(text), text)
    context, out = file_features(text), []
    rng = random.Random(len(text) * 31 + len(tokens))
    begins = [i for i, s in enumerate(states) if s == BEGIN][:4]
    for i in begins:
        lo, hi = max(0, i - around), min(len(tokens), i + around)
        words = [text[s:e] for s, e in tokens[lo:hi]]
        out.append((words, context, states[lo:hi]))
        swapped, marks = [], []
        for w, y in zip(words, states[lo:hi], strict=True):
            if y == BEGIN:
                made = _TOKEN.findall(_invented(rng))
                swapped += made
                marks += [BEGIN] + [INSIDE] * (len(made) - 1)
            elif y == OUTSIDE:
                swapped.append(w)
                marks.append(OUTSIDE)
        out.append((swapped, context, marks))
    calm = [i for i in range(0, len(tokens), 2 * around) if not any(states[i : i + 2 * around])]
    for i in rng.sample(calm, min(len(calm), 2)):
        out.append(([text[s:e] for s, e in tokens[i : i + 2 * around]], context, states[i : i + 2 * around]))
    return out


def fit(docs: DataFrame, text: str = "text", documents: int = FIT_DOCUMENTS, most: int = FIT_WINDOWS) -> Tagger:
    """Train the tagger on windows of a bounded sample of ``docs``.

    About ``documents`` different texts are drawn by hash of the text, each once; of their different windows at most
    ``most`` of each class go to the driver, each of at most 24 tokens. What the fixed patterns find labels the tokens.
    """
    rows = docs.select(F.col(text).alias("text")).where(F.length("text") > 0)
    n = rows.agg(F.count_distinct(F.xxhash64("text"))).first()[0]
    bucket = F.pmod(F.xxhash64("text"), F.lit(BUCKETS))
    drawn = bucket < int(BUCKETS * min(1.0, documents / max(1, n))) + 1
    # Texts with a base pattern are rare, so they get a share of their own.
    hint = F.col("text").rlike("(?i)(password|passwd|secret|token|api_?key)[\"']? *[:=]|AKIA|[0-9a-f]{16}")
    marked = (bucket < int(BUCKETS * min(1.0, 10 * documents / max(1, n))) + 1) & hint
    texts = rows.where(drawn | marked).dropDuplicates(["text"])

    def cut(part: dict) -> dict:
        found = [w for t in part["text"] for w in windows(t)]
        return {"words": [w[0] for w in found], "context": [w[1] for w in found], "states": [w[2] for w in found]}

    made = arrow_map(texts, cut, "words array<string>, context array<double>, states array<int>")
    # Equal windows count once, with the least of their contexts, so that a rerun takes the same.
    made = cut_lineage(made.groupBy("words", "states").agg(F.min("context").alias("context")))
    chosen = []
    for secret in (True, False):
        kind = made.where(F.array_max("states") > 0 if secret else F.array_max("states") == 0)
        chosen += kind.orderBy(F.xxhash64("words"), "words", "states").limit(most).collect()
    size = _SIZE
    data = [([crf.hashed(features(w), size) for w in r["words"]], np.array(r["context"]), list(r["states"])) for r in chosen if r["words"]]
    return Tagger(crf.train(data, 3, size, 3), frozenset(w for r in chosen for w in r["words"]))


def form(token: str) -> str | None:
    """What stands for a plain word that training never saw: one of its case and length. Other tokens stand for themselves."""
    if token.isalpha() and len(token) < 16:
        low = "q" * min(len(token), 12)
        return low if token.islower() else low.upper() if token.isupper() else low.title() if token.istitle() else low + "Q"
    return None


class Tagger:
    """Spans of begin/inside tokens on the best path, next to the base spans."""

    def __init__(self, chain: crf.Chain, known: frozenset[str] = frozenset()):
        self.chain, self.known = chain, known
        self.scores = None

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, int, bool]]]:
        if self.scores is None:
            self.scores = crf.TokenScores(self.chain, features, form, self.known)
        base = [base_spans(t) for t in texts]
        tokens = [_TOKEN.findall(t) for t in texts]
        context = np.array([file_features(t) for t in texts]).reshape(len(texts), 3)
        scores, lengths = self.scores.emissions(tokens, context)
        path = crf.viterbi(self.chain, scores, lengths)
        out, at = [], 0
        for t, own, n in zip(texts, base, lengths, strict=True):
            states = path[at : at + n]
            at += n
            spans = [(*x, True) for x in own]
            if states.any():
                spans += [(s, 3, e, False) for s, e in _tagged(t, states) if not any(s < y and x < e for x, _, y in own)]
            out.append(sorted(spans))
        return out


def _tagged(text: str, states: np.ndarray) -> list[tuple[int, int]]:
    found: list[list[int]] = []
    last = OUTSIDE
    for m, state in zip(_TOKEN.finditer(text), states, strict=True):
        if state == BEGIN or (state == INSIDE and last == OUTSIDE):
            found.append([m.start(), m.end()])
        elif state == INSIDE:
            found[-1][1] = m.end()
        last = state
    # A secret has some length; single short tokens are names of settings.
    return [(s, e) for s, e in found if e - s >= 12]


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", tagger: Tagger | None = None) -> DataFrame:
    """(key, spans): secrets of every row, by start and kind; offsets in code points, end exclusive.

    Spans of the fixed patterns are marked ``base``; those of kind ``tagged`` come from the tagger and touch no base
    span. A null text counts as empty and has no spans; an empty table gives an empty result; repeated rows and null
    keys give a row each; other columns are not read. Without ``tagger``, one is fitted on a bounded sample.
    """
    tagger = tagger or fit(docs, text)

    def rows(part: dict) -> dict:
        spans = tagger.spans([t or "" for t in part["text"]])
        return {"key": part["key"], "spans": [[{"kind": KINDS[k], "start": s, "end": e, "base": b} for s, k, e, b in own] for own in spans]}

    kind = docs.schema[key].dataType.simpleString()
    return arrow_map(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), rows, f"key {kind}, spans {SPANS}").withColumnRenamed("key", key)
