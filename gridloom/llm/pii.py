"""Personal data in plain and disguised writing, with offsets into the untouched text.

A chain of transducers rewrites homoglyphs, spelled digits and at/dot disguises. Each rewritten character remembers
the source characters it stands for, so a span found in the normal form is mapped back exactly.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import arrow_map, replace_text

KINDS = ("email", "ip", "card", "phone")
SPANS = "array<struct<kind:string,start:int,end:int,base:boolean>>"

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# The look-behind only skips starts inside a digit run, which can't succeed where its first digit failed.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

# Letters of other scripts that look like Latin ones.
_LOOKALIKES = dict(zip(
    "АВЕЅІЈКМНОРСТУХаеѕіјорсухԁԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧαιορυν",
    "ABESIJKMHOPCTYXaesijopcyxdqwABEZHIKMNOPTYXaiopuv",
    strict=True,
))
# Dots, signs and hyphens in other forms; invisible characters.
_SIGNS = {
    "․": ".", "。": ".", "｡": ".", "﹒": ".", "﹫": "@",
    "‐": "-", "‑": "-", "‒": "-", " ": " ", " ": " ", " ": " ",
}
_HIDDEN = "­​‌‍‎‏⁠﻿"
_ODD = re.compile("[" + "".join([*_LOOKALIKES, *_SIGNS]) + _HIDDEN + "！-～①-⓿\U0001d400-\U0001d7ff٠-٩۰-۹]")
# The digits spelled in English, German, French and Spanish.
_SPELLED = {
    w: str(d)
    for words in (
        "zero one two three four five six seven eight nine",
        "null eins zwei drei vier fünf sechs sieben acht neun",
        "zéro un deux trois quatre cinq six sept huit neuf",
        "cero uno dos tres cuatro cinco seis siete ocho nueve",
    )
    for d, w in enumerate(words.split())
}
_WORD = "|".join(sorted(_SPELLED, key=lambda w: (-len(w), w)))
_POINT = "dot|punkt|point|punto"
_RUN = re.compile(rf"(?<!\w)(?:(?:plus|\+)[ -]*)?(?:{_WORD}|[0-9]+)(?:(?:[ .-]+(?:{_WORD}|{_POINT}|[0-9]+)(?!\w))){{3,}}", re.I)
# Every run has a spelled digit behind a separator; the second hint is dearer and looks at two units.
_DIGIT_HINT = re.compile(rf"[ .-](?:{_WORD})(?!\w)", re.I)
_RUN_HINT = re.compile(rf"(?<!\w)(?:{_WORD})[ .-]+(?:{_WORD}|{_POINT}|[0-9])", re.I)
_RUN_PART = re.compile(r"[^\W\d_]+|[0-9]+|\+|[ .-]+")
_BRACKET_HINT = re.compile(rf"[\[({{<]\s?(?:at|@|arroba|\.|{_POINT})\s?[\])}}>]", re.I)
_BRACKET_AT = re.compile(r"\s?[\[({<]\s?(?:at|@|arroba)\s?[\])}>]\s?", re.I)
_BRACKET_DOT = re.compile(rf"\s?[\[({{<]\s?(?:\.|{_POINT})\s?[\])}}>]\s?", re.I)
_BARE_HINT = re.compile(rf"[ @](?:{_POINT}) ", re.I)
_BARE = re.compile(rf"(?<=[A-Za-z0-9])( at | arroba |@)[A-Za-z0-9-]+(?:(?: (?:{_POINT}) |\.)[A-Za-z0-9-]+)+", re.I)
# Endings that make a bare "at ... dot ..." an address and not prose, besides all of two letters but these words.
_ENDINGS = frozenset("com org net edu gov info biz dev app cloud online shop site store xyz club blog tech mobi name pro int mil coop museum example test".split())
_WORDS = frozenset("ab an da du he if ob of on or ou où so to un up we wo ya yo zu".split())


def _is_ending(last: str) -> bool:
    last = last.lower()
    return last in _ENDINGS or (len(last) == 2 and last.isascii() and last.isalpha() and last not in _WORDS)


_BARE_DOT = re.compile(rf" (?:{_POINT}) ", re.I)


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches found from their @ signs, linear in the text for any input."""
    found, floor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((start, m.end()))
        floor = m.end() if m else at + 1
        at = text.find("@", floor)
    return found


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def identifiers(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of every plain identifier, by start and kind."""
    found = [(s, 0, e) for s, e in _emails(text)]
    found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p := part.lstrip("0")) <= 3 and int(p or "0") <= 255 for part in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and _luhn(digits):
                found.append((m.start(), 2, m.end()))
    if "+" in text:
        found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return sorted(found)


class Rewritten:
    """A text with, for each character, the source range it stands for and whether it was changed."""

    def __init__(self, text: str):
        self.text = text
        self.starts = list(range(len(text)))
        self.ends = list(range(1, len(text) + 1))
        self.changed = [False] * len(text)

    def edit(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace disjoint ranges, given in order. A character put in stands for the whole range it replaces."""
        text, starts, ends, changed, at = [], [], [], [], 0
        for s, e, new in [*edits, (len(self.text), len(self.text), "")]:
            text.append(self.text[at:s])
            starts += self.starts[at:s]
            ends += self.ends[at:s]
            changed += self.changed[at:s]
            if new:
                text.append(new)
                starts += [self.starts[s]] * len(new)
                ends += [self.ends[e - 1]] * len(new)
                changed += [True] * len(new)
            elif s < e and changed:
                changed[-1] = True  # something was removed behind it
            at = e
        self.text, self.starts, self.ends, self.changed = "".join(text), starts, ends, changed


def _fold_characters(state: Rewritten) -> None:
    edits = []
    for token in re.finditer(r"\S+|\s", state.text):
        if not _ODD.search(token[0]):
            continue
        # A word really written in another script is left alone.
        mixed = all(c in _LOOKALIKES or unicodedata.normalize("NFKC", c).isascii() for c in token[0] if c.isalpha())
        for i, c in enumerate(token[0], token.start()):
            if c in _HIDDEN:
                edits.append((i, i + 1, ""))
            elif c in _SIGNS:
                edits.append((i, i + 1, _SIGNS[c]))
            elif c in _LOOKALIKES:
                if mixed:
                    edits.append((i, i + 1, _LOOKALIKES[c]))
            elif not c.isascii() and _ODD.match(c):
                plain = unicodedata.normalize("NFKC", c)
                plain = plain if plain.isascii() else str(unicodedata.digit(c, "")) or plain
                if plain.isascii() and plain != c:
                    edits.append((i, i + 1, plain))
    state.edit(edits)


def _join_digits(state: Rewritten) -> None:
    edits = []
    for run in _RUN.finditer(state.text):
        parts = [(m.start(), m.end(), m[0]) for m in _RUN_PART.finditer(state.text, run.start(), run.end())]
        if sum(p[2].lower() in _SPELLED for p in parts) < 2:
            continue
        for i, (s, e, part) in enumerate(parts):
            word = part.lower()
            if word in _SPELLED:
                edits.append((s, e, _SPELLED[word]))
            elif word == "plus":
                edits.append((s, e, "+"))
            elif word in _POINT.split("|"):
                edits.append((s, e, "."))
            elif set(part) <= set(" -") and 0 < i < len(parts) - 1:
                edits.append((s, e, ""))
    state.edit(edits)


def _undo_at_dot(state: Rewritten) -> None:
    state.edit([(m.start(), m.end(), "@") for m in _BRACKET_AT.finditer(state.text)])
    state.edit([(m.start(), m.end(), ".") for m in _BRACKET_DOT.finditer(state.text)])
    edits = []
    for m in _BARE.finditer(state.text):
        dots = [(d.start(), d.end(), ".") for d in _BARE_DOT.finditer(state.text, m.end(1), m.end())]
        if dots and _is_ending(re.split(r"[ .]", m[0])[-1]):
            edits += ([] if m[1] == "@" else [(m.start(1), m.end(1), "@")]) + dots
    state.edit(edits)


def normalised(text: str) -> Rewritten | None:
    """The normal form of ``text``, or None if no transducer has anything to rewrite."""
    odd = not text.isascii() and _ODD.search(text)
    # Folding can only bring more disguises to light, so the hints on the raw text decide only if there is nothing to fold.
    if not (odd or _BRACKET_HINT.search(text) or _BARE_HINT.search(text) or (_DIGIT_HINT.search(text) and _RUN_HINT.search(text))):
        return None
    state = Rewritten(text)
    if odd:
        _fold_characters(state)
    _join_digits(state)
    _undo_at_dot(state)
    return state


def all_spans(text: str) -> list[tuple[int, int, int, bool]]:
    """(start, kind number, end, base) of plain identifiers and of those that show in the normal form only."""
    plain = identifiers(text)
    state = normalised(text)
    if state is None:
        return [(*x, True) for x in plain]
    known = set(plain)
    added = set()
    for s, kind, e in identifiers(state.text):
        if any(state.changed[s:e]) and (x := (state.starts[s], kind, state.ends[e - 1])) not in known:
            added.add(x)
    return sorted([(*x, True) for x in plain] + [(*x, False) for x in added])


def find_identifiers(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, spans): all identifiers of every row, by start and kind; offsets in code points, end exclusive.

    ``base`` marks the plain ones. A null text counts as empty and has no spans; repeated rows and null keys give a row
    each. Other columns, whatever their names, are not read. A row needs no other row, so there is no shuffle.
    """

    def rows(part: dict) -> dict:
        spans = [[{"kind": KINDS[k], "start": s, "end": e, "base": b} for s, k, e, b in all_spans(t)] if t else [] for t in part["text"]]
        return {"key": part["key"], "spans": spans}

    kind = docs.schema[key].dataType.simpleString()
    return arrow_map(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), rows, f"key {kind}, spans {SPANS}").withColumnRenamed("key", key)


def redacted(text: str | None) -> str | None:
    """The text with every identifier replaced by its kind in angle brackets; overlapping ones by the first kind."""
    if not text:
        return text
    out, at = [], 0
    for s, kind, e, _ in all_spans(text):
        if s >= at:
            out.append(text[at:s] + f"<{KINDS[kind].upper()}>")
        at = max(at, e)
    return "".join(out) + text[at:] if out else text


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with identifiers replaced in ``text``. Null stays null, every row and column stays."""
    return replace_text(docs, text, redacted)
