"""Main text of web pages as the best-scoring contiguous stretch of words and tags.

Every word and every tag of a page has a weight: words positive, tags negative, as learned from pages whose article is
marked up. The stretch with the highest sum is the content, on pages that mark an article too: the mark only changes
what words and tags score. Whole blocks are then read from it, without the parts that are never article text.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import add_column, arrow_map

# Elements whose content is not markup, that are never content, that begin a block, that have no content.
_RAW = ("script", "style", "textarea", "title", "noscript", "template", "iframe", "noembed", "noframes", "xmp", "svg", "math")
_NEVER = frozenset(_RAW) | {"head", "nav", "aside", "form", "footer", "button", "select", "option", "label", "fieldset", "dialog", "menu", "object", "canvas", "audio", "video"}
_BLOCK = frozenset(
    "address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup "
    "hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_ARTICLE = frozenset({"article", "main"})
_NOISE = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|adsense|banner|sponsor\w*|promo\w*|comment|comments|commentlist|replies|respond|disqus|sidebar|side|widget\w*|"
    r"menu|nav|navbar|navigation|breadcrumb\w*|footer|cookie\w*|consent|notice|notices|gdpr|popup|modal|overlay|newsletter|subscribe|signup|"
    r"share|sharing|social|related|recommended|toolbar|masthead|pagination|pager|login|search|skip|legal|copyright|disclaimer)(?:$|[\s_-])",
    re.I,
)
_NOISE_ROLES = frozenset({"navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar", "dialog", "alert", "alertdialog"})
_RAW_NAME = re.compile(r"(" + "|".join(_RAW) + r")\b", re.I)
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_QUOTED = re.compile("[>\"']")
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|aria-label)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)

_WORD, _LINK, _NOISE_WORD = "word", "link word", "noise word"
DEFAULT = {_WORD: 1.0, _LINK: 0.2, _NOISE_WORD: -1.0}
OTHER_TAG = -1.0
IN_ARTICLE = 1.0
FIT_CLIP = 6.0


def _noisy(name: str, attrs: str) -> bool:
    if name in _NEVER:
        return True
    for m in _ATTRIBUTE.finditer(attrs or ""):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "role" and value in _NOISE_ROLES):
            return True
        if key in ("class", "id") and value and name not in ("html", "body", "main") and _NOISE.search(value):
            return True
    return False


class _TagEnds:
    """Where tags end: the first ``>`` outside of quotes. One pass from the right answers for every start."""

    def __init__(self, page: str):
        self.at = [m.start() for m in _QUOTED.finditer(page)]
        self.end = [-1] * (len(self.at) + 1)
        following = {'"': -1, "'": -1}
        for i in range(len(self.at) - 1, -1, -1):
            mark = page[self.at[i]]
            if mark == ">":
                self.end[i] = self.at[i]
            else:
                close, following[mark] = following[mark], i
                self.end[i] = self.end[close + 1] if close >= 0 else -1

    def behind(self, start: int) -> int:
        """The place of the ``>`` of a tag whose name ends at ``start``, -1 if it has none."""
        return self.end[bisect_left(self.at, start)]


def markup(page: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(start, end, kind, name, attributes) of all markup in page order: kind is ``raw``, ``tag``, ``end`` or ``other``.

    A ``<`` that begins no markup is text. A raw element reaches to its end tag; without one, scripts and styles take the rest of the page
    and others are only their tag. Every character is looked at a bounded number of times.
    """
    last, at, n = page.rfind(">"), page.find("<"), len(page)
    ends: _TagEnds | None = None
    endless: set[str] = set()
    while at >= 0:
        following, stop = page[at + 1 : at + 2], -1
        if page.startswith("<!--", at):
            close = page.find("-->", at + 4)
            stop = close + 3 if close >= 0 else n
            yield at, stop, "other", "", ""
        elif at > last:
            # Only a comment can still begin.
            at = page.find("<!--", at)
            continue
        elif raw := _RAW_NAME.match(page, at + 1):
            close, name = page.find(">", raw.end()) + 1, raw[1].lower()
            if close:
                stop = close
                found = None if name in endless else re.compile(rf"</{name}\b[^>]*>", re.I).search(page, close)
                if found:
                    stop = found.end()
                else:
                    endless.add(name)
                    stop = n if name in ("script", "style") else close
                yield at, stop, "raw", name, ""
        elif following == "/" and (name := _NAME.match(page, at + 2)):
            stop = page.find(">", name.end()) + 1
            if stop:
                yield at, stop, "end", name[0].lower(), ""
        elif following and following in "!?/":
            stop = page.find(">", at + 2) + 1
            if stop:
                yield at, stop, "other", "", ""
        elif name := _NAME.match(page, at + 1):
            ends = ends or _TagEnds(page)
            close = ends.behind(name.end())
            if close >= 0:
                stop = close + 1
                yield at, stop, "tag", name[0].lower(), page[name.end() : close]
        at = page.find("<", stop if stop > at else at + 1)


class _Open:
    """The open elements: name, whether their words are noise, article; counted by name, blocks at hand."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, bool, int]] = []
        self.count: Counter[str] = Counter()
        self.blocks: list[int] = []

    def top(self) -> tuple[bool, int]:
        return self.stack[-1][1:] if self.stack else (False, 0)

    def push(self, name: str, noise: bool, article: int) -> None:
        if name in _BLOCK:
            self.blocks.append(len(self.stack))
        self.stack.append((name, noise, article))
        self.count[name] += 1

    def cut(self, depth: int) -> None:
        while len(self.stack) > depth:
            self.count[self.stack.pop()[0]] -= 1
        while self.blocks and self.blocks[-1] >= depth:
            self.blocks.pop()

    def close(self, name: str) -> None:
        """The innermost element of that name and all inside it; an end without a start closes nothing."""
        if self.count[name]:
            while self.stack[-1][0] != name:
                self.cut(len(self.stack) - 1)
            self.cut(len(self.stack) - 1)

    def close_before(self, name: str) -> None:
        """A new block ends an open paragraph, a new item the item before it; inline elements left open end too."""
        closes = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}.get(name, ())
        if self.blocks and (self.stack[self.blocks[-1]][0] == "p" or self.stack[self.blocks[-1]][0] in closes):
            self.cut(self.blocks[-1])


def parse(page: str) -> list[tuple[str, int, int, int, str]]:
    """The page as pieces (type, number of words, article, block, text) in page order.

    ``type`` is a kind of words or a tag; ``article`` numbers the outermost article element around it, 0 outside; ``block``
    numbers the block the text belongs to. Elements left open end with the page, ends without a start are only tags. Words anywhere
    inside a link are a link's. The time grows with the length of the page, however broken it is.
    """
    out: list[tuple[str, int, int, int, str]] = []
    opened = _Open()
    block = articles = at = 0

    def text(lo: int, hi: int) -> None:
        if lo < hi:
            piece = page[lo:hi]
            noise, article = opened.top()
            kind = _NOISE_WORD if noise else _LINK if opened.count["a"] else _WORD
            out.append((kind, len(piece.split()), article, block, piece))

    def tag(name: str) -> None:
        out.append((name, 0, opened.top()[1], block, ""))

    for start, stop, kind, name, attrs in markup(page):
        text(at, start)
        at = stop
        if kind == "raw":
            tag(f"<{name}")
        elif kind == "end":
            if name in _BLOCK:
                block += 1
            tag(f"</{name}")
            opened.close(name)
        elif kind == "tag":
            if name in _BLOCK:
                block += 1
            if name in _BLOCK or name == "option":
                opened.close_before(name)
            noise, article = opened.top()
            tag(f"<{name}")
            if name == "br":
                out.append((_NOISE_WORD if noise else _WORD, 0, article, block, "\n"))
            if name not in _VOID and not attrs.endswith("/"):
                own = _noisy(name, attrs) or (name == "header" and not article)
                if name in _ARTICLE and not (article or noise or own):
                    articles += 1
                    article = articles
                opened.push(name, noise or own, article)
    text(at, len(page))
    return out


def weigh(counts: dict[str, tuple[float, float]]) -> dict[str, float]:
    """Weights from counts inside and outside of marked articles: log odds, words kept positive and tags negative."""
    inside, outside = sum(a for a, _ in counts.values()), sum(b for _, b in counts.values())
    if not inside or not outside:
        return dict(DEFAULT)
    weights = dict(DEFAULT)
    for kind, (a, b) in counts.items():
        odds = math.log((a + 1) / (inside + 1)) - math.log((b + 1) / (outside + 1))
        odds = max(-FIT_CLIP, min(FIT_CLIP, odds))
        if kind == _NOISE_WORD:
            weights[kind] = min(-0.5, odds)
        elif kind in (_WORD, _LINK):
            weights[kind] = max(0.1, odds)
        else:
            weights[kind] = min(-0.05, odds)
    return weights


def fit(pages: DataFrame, content: str = "html") -> dict[str, float]:
    """Weights from every page that marks exactly one article; other pages have no label.

    Counts are summed per task and then by kind; the kinds are the words' and the known elements', a few hundred.
    """

    def rows(part: dict) -> dict:
        counts: dict[str, list[float]] = {}
        for page in part["page"]:
            pieces = parse(page or "")
            if {p[2] for p in pieces} != {0, 1}:
                continue
            for kind, words, article, _, _ in pieces:
                if kind[0] == "<" and kind.lstrip("</") not in _BLOCK | _NEVER | _VOID | _INLINE:
                    kind = "<other"
                own = counts.setdefault(kind, [0.0, 0.0])
                own[0 if article and kind != _NOISE_WORD else 1] += max(1, words) if kind[0] != "<" else 1
        return {"kind": list(counts), "a": [c[0] for c in counts.values()], "b": [c[1] for c in counts.values()]}

    found = arrow_map(pages.select(F.col(content).alias("page")), rows, "kind string, a double, b double")
    return weigh({r["kind"]: (r["a"], r["b"]) for r in found.groupBy("kind").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).collect()})


_INLINE = frozenset("a abbr b bdi bdo cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var img picture".split())


def best_stretch(scores: np.ndarray) -> tuple[int, int]:
    """The contiguous range with the highest sum, in one pass over prefix sums; the earliest and shortest of equals."""
    if not len(scores) or scores.max() <= 0:
        return 0, 0
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    lowest = np.minimum.accumulate(sums[:-1])
    end = int((sums[1:] - lowest).argmax())
    start = int(np.flatnonzero(sums[: end + 1] == lowest[end])[-1])
    return start, end + 1


def token_scores(pieces: list[tuple[str, int, int, int, str]], weights: dict[str, float]) -> np.ndarray:
    """The score of every piece. Marks of articles count as evidence only.

    Inside of one a tag costs ``IN_ARTICLE`` less and words that are left out anyway cost nothing; on a page that marks
    one, words outside of it count as little as those of links.
    """
    other, marked = weights.get("<other", OTHER_TAG), any(p[2] for p in pieces)

    def score(kind: str, words: int, article: int) -> float:
        if kind[0] == "<":
            weight = weights.get(kind, other)
            return min(0.0, weight + IN_ARTICLE) if article else weight
        if article and kind == _NOISE_WORD:
            return 0.0
        if marked and not article and kind == _WORD:
            kind = _LINK
        return weights[kind] * words

    return np.array([score(*p[:3]) for p in pieces])


def main_text(page: str | None, weights: dict[str, float]) -> str:
    """The main text of a page: its blocks in page order, parted by an empty line; empty if there is none."""
    pieces = parse(page or "")
    if not pieces:
        return ""
    start, end = best_stretch(token_scores(pieces, weights))
    if start == end:
        return ""
    blocks = {p[3] for p in pieces[start:end] if p[0] in (_WORD, _LINK) and p[1]}
    chosen = [p for p in pieces if p[3] in blocks]
    texts: list[tuple[int, list[str]]] = []
    for kind, _, _, block, piece in chosen:
        if kind not in (_WORD, _LINK):
            continue
        if not texts or texts[-1][0] != block:
            texts.append((block, []))
        texts[-1][1].append(piece)
    joined = (" ".join(html.unescape("".join(parts)).split()) for _, parts in texts)
    return "\n\n".join(t for t in joined if t)


def extract(pages: DataFrame, weights: dict[str, float] | None = None, content: str = "html") -> DataFrame:
    """``pages`` (all columns but ``content``) with ``text``, its main text. Null pages count as empty and have an empty text.

    Weights are learned from the pages themselves if none are given. Repeated rows give equal results; an empty table
    gives an empty result. A page needs no other page, so there is no shuffle. A column of the input named ``text`` (in
    any case) gives way to the result.
    """
    weights = weights or fit(pages, content)
    return add_column(pages, content, "text", "string", lambda page: main_text(page, weights))
