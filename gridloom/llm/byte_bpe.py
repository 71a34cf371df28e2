"""Byte-pair encoding and decoding by streaming transducers with bounded memory.

A merge list decides how far the text that follows can still change a token. Say that two texts agree up to byte e. A merge
(u, v) can move the first difference to the left only if u ends just there and v begins there in one of the two texts; from
then on the token at that place is u or one that begins with u, and only a later merge can move it again. So the lengths of u
along the longest chain of merges (u1, v1), (u2, v2), ... with rising ranks, in which every v begins with the u before
(``lookahead``), bound how far to the left anything can change. The encoder keeps the bytes of an open piece and gives out every
token that ends further than that before the last byte: it stays, and what follows is encoded as if it stood alone, because no
merge crosses a boundary that stays.

The decoder is a state machine over bytes: it holds at most three bytes of a character that has begun.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from array import array
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession

from gridloom.llm.common import add_column

#: Characters that an encoder reads at once, and the length from which an open piece is encoded while it is still open.
CHUNK, LONG = 1 << 16, 1 << 12
#: Pieces whose ids are remembered, and the longest of them in characters.
REMEMBERED, REMEMBERED_CHARS = 1 << 18, 64
#: Pieces of at most so many bytes are merged without a heap.
FEW = 32
#: Above every number of a merge.
_NO_MERGE = 1 << 62

# Characters that newer Unicode tables call letters or numbers, but the tables behind the published vocabulary do not.
NEWER = (
    r"\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c-\uab6d\U000107bb-\U000107bf"
    r"\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb\U00011de0-\U00011de9\U00011df1\U0001246f"
    r"\U00012475-\U0001247f\U00012550-\U00012686\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6\U000187f8-\U000187ff"
    r"\U00018cd6-\U00018cda\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168"
    r"\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2"
    r"\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead"
    r"\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)


class Cutter:
    """The pattern that cuts text into pieces before the merges, with the runs that one piece can consist of."""

    def __init__(self, compile_: Callable, letter: str, number: str, other: str, space: str):
        runs = {"letters": f"{letter}+", "numbers": f"{number}+", "others": f"{other}+", "spaces": f"{space}+"}
        words = [f" ?{runs[kind]}" for kind in ("letters", "numbers", "others")]
        named = [f" ?(?P<{kind}>{runs[kind]})" for kind in ("letters", "numbers", "others")]
        short = "'(?:s|t|re|ve|m|ll|d)"
        self.pieces = compile_("|".join([words[0], short, *words[1:], f"{space}+(?!{letter}|{number}|{other})", f"{space}+"]))
        self.kinds = compile_("|".join([named[0], short, *named[1:], f"(?P<spaces>{space}+)"]))
        self.runs = {kind: compile_(run) for kind, run in runs.items()}


def _near(kind: str) -> str:
    """The characters of a class up to U+024F, as a list for the faster engine."""
    return "".join(re.escape(chr(c)) for c in range(0x250) if regex.match(kind, chr(c)))


def _sets(letter: str, number: str, space: str) -> tuple[str, str, str, str]:
    return f"[{letter}]", f"[{number}]", f"[^{letter}{number}{space}]", f"[{space}]"


def _new(pattern: str) -> regex.Pattern:
    return regex.compile(pattern, regex.V1)


# The same pattern three times: for texts of near characters, for others, and for texts with characters of NEWER.
NEAR = Cutter(re.compile, *_sets(_near(r"\p{L}"), _near(r"\p{N}"), _near(r"\s")))
PLAIN = Cutter(_new, *_sets(r"\p{L}", r"\p{N}", r"\s"))
EXACT = Cutter(_new, rf"[\p{{L}}--[{NEWER}]]", rf"[\p{{N}}--[{NEWER}]]", rf"[[^\s\p{{L}}\p{{N}}]||[{NEWER}]]", r"\s")
HAS_FAR, HAS_NEWER = re.compile("[^\0-\u024f]"), regex.compile(f"[{NEWER}]")


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable Latin-1 itself, the rest from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Merges and tokens of a byte-level vocabulary file, with the lookahead that its merge list needs."""

    def __init__(self, content: str):
        data = json.loads(content)
        model, alphabet = data["model"], byte_alphabet()
        cut = data.get("pre_tokenizer") or {}
        if model.get("type") != "BPE" or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or data.get("normalizer") or model.get("end_of_word_suffix"):
            raise ValueError("only byte-level merge lists without normalisation, prefix space or word endings can be read")
        self.special = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        self.ids = {bytes(alphabet[c] for c in token): i for token, i in model["vocab"].items() if token not in self.special}
        self.tokens = {i: token for token, i in self.ids.items()} | {i: text.encode() for text, i in self.special.items()}
        self.ranks: dict[tuple[bytes, bytes], int] = {}
        for rank, merge in enumerate(model["merges"]):
            u, v = (bytes(alphabet[c] for c in part) for part in (merge.split(" ") if isinstance(merge, str) else merge))
            self.ranks[u, v] = rank
        self.lookahead = lookahead(list(self.ranks))
        # The same merges by number: a token's id, or a number behind all ids for bytes that only merges know.
        numbers = dict(self.ids)
        self.known = max(numbers.values(), default=-1) + 1
        for token in [*(bytes([b]) for b in range(256)), *(part for u, v in self.ranks for part in (u, v, u + v))]:
            numbers.setdefault(token, self.known + len(numbers))
        self.singles, self.width = [numbers[bytes([b])] for b in range(256)], max(numbers.values()) + 1
        # Pair -> rank times the width, plus the number of what the merge makes.
        self.joins = {numbers[u] * self.width + numbers[v]: rank * self.width + numbers[u + v] for (u, v), rank in self.ranks.items()}


def lookahead(merges: list[tuple[bytes, bytes]]) -> int:
    """Bytes behind the end of a token beyond which no text can change it; the merges in the order of their ranks.

    Every part of a merge must be a single byte or made by earlier merges, as in every learned list.
    """
    beginnings: dict[bytes, set[bytes]] = defaultdict(set)
    reach: dict[bytes, int] = defaultdict(int)
    longest = 0
    for u, v in merges:
        for part in (u, v):
            if len(part) > 1 and part not in beginnings:
                raise ValueError("a merge uses a token that no earlier merge makes")
        chain = len(u) + max(reach.get(first, 0) for first in beginnings[v] | {v})
        reach[u] = max(reach[u], chain)
        longest = max(longest, chain)
        beginnings[u + v] |= beginnings[u] | {u, u + v}
    return longest


def merged(data: bytes, ranks: dict[tuple[bytes, bytes], int]) -> list[bytes]:
    """The tokens of ``data``: the merge of the lowest rank first, from the left among equal ones; pairs wait in a heap."""
    parts: list[bytes | None] = [data[i : i + 1] for i in range(len(data))]
    after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
    heap = [(rank, i) for i in range(len(parts) - 1) if (rank := ranks.get((parts[i], parts[i + 1]))) is not None]
    heapq.heapify(heap)
    while heap:
        rank, i = heapq.heappop(heap)
        j = after[i]
        if parts[i] is None or j == len(parts) or ranks.get((parts[i], parts[j])) != rank:
            continue
        parts[i], parts[j] = parts[i] + parts[j], None
        after[i] = k = after[j]
        if k < len(parts):
            before[k] = i
            if (new := ranks.get((parts[i], parts[k]))) is not None:
                heapq.heappush(heap, (new, i))
        if (h := before[i]) >= 0 and (new := ranks.get((parts[h], parts[i]))) is not None:
            heapq.heappush(heap, (new, h))
    return [p for p in parts if p is not None]


def few_merged(data: bytes, vocabulary: Vocabulary) -> list[int]:
    """Ids of the tokens of a word: the lowest rank is looked for anew after each merge, which changes the ranks of two pairs."""
    parts, get, width, none = list(map(vocabulary.singles.__getitem__, data)), vocabulary.joins.get, vocabulary.width, _NO_MERGE
    found = [get(u * width + v, none) for u, v in zip(parts, parts[1:])]
    while found:
        low = min(found)
        if low == none:
            break
        i, made = found.index(low), low % width
        parts[i : i + 2] = [made]
        del found[i]
        if i:
            found[i - 1] = get(parts[i - 1] * width + made, none)
        if i < len(found):
            found[i] = get(made * width + parts[i + 1], none)
    if parts and max(parts) >= vocabulary.known:
        raise KeyError("the vocabulary lacks a token that its merges make")
    return parts


class _Remembered(dict):
    """Piece -> its ids packed as little-endian unsigned 32-bit integers; unknown pieces are merged when asked for."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    def packed(self, tokens: list[bytes]) -> bytes:
        return np.array([self.vocabulary.ids[t] for t in tokens], "<u4").tobytes()

    def __missing__(self, piece: str) -> bytes:
        data = piece.encode()
        found = array("I", few_merged(data, self.vocabulary)).tobytes() if len(data) <= FEW else self.packed(merged(data, self.vocabulary.ranks))
        if len(piece) <= REMEMBERED_CHARS:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = found
        return found


class Encoder:
    """Text in chunks of any size to packed ids: ``feed`` gives those that are certain, ``finish`` the rest.

    Kept between calls: fewer than ``LONG`` characters of an open piece, or, inside a longer piece, its last bytes (the lookahead
    and up to ``LONG`` more). With ``special`` the strings of special tokens give their ids, else they are text like any other.
    """

    def __init__(self, vocabulary: Vocabulary, special: bool = True, known: _Remembered | None = None):
        self.vocabulary, self.known = vocabulary, known if known is not None else _Remembered(vocabulary)
        self.strings = sorted(vocabulary.special, key=len, reverse=True) if special else []
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.strings)) + ")") if self.strings else None
        self.held = self.rest = ""
        self.kind: str | None = None
        self.window = b""

    def feed(self, text: str) -> bytes:
        if self.split is None:
            return self._text(text, False)
        out, parts = [], self.split.split(self.held + text)
        for part in parts[:-1]:
            special = self.vocabulary.special.get(part)
            out.append(self._text(part, True) if special is None else np.array([special], "<u4").tobytes())
        last = parts[-1]
        keep = max((k for s in self.strings for k in range(1, min(len(s), len(last) + 1)) if last.endswith(s[:k])), default=0)
        self.held = last[len(last) - keep :]
        out.append(self._text(last[: len(last) - keep], False))
        return b"".join(out)

    def finish(self) -> bytes:
        held, self.held = self.held, ""
        return self._text(held, True)

    def _text(self, text: str, end: bool) -> bytes:
        """Ids of plain text; ``end`` says that nothing follows it."""
        text, out = self.rest + text, []
        self.rest = ""
        cut = NEAR if not HAS_FAR.search(text) else EXACT if HAS_NEWER.search(text) else PLAIN
        while text or (end and self.kind):
            if self.kind:
                run = cut.runs[self.kind].match(text)
                stop = run.end() if run else 0
                closed = end or stop < len(text)
                # The last white space before a word belongs to what follows it.
                use = stop - 1 if self.kind == "spaces" and (stop < len(text) or not end) else stop
                out.append(self._bytes(text[: max(use, 0)].encode(), closed))
                text = text[max(use, 0) :]
                if not closed:
                    break
                self.kind = None
                continue
            pieces = cut.pieces.findall(text)
            if not end:
                # Three characters behind a piece decide where it ends; before that it stays open.
                closed = len(text)
                while pieces and closed > len(text) - 3:
                    closed -= len(pieces.pop())
                text = text[closed:]
            else:
                text = ""
            out.append(b"".join(map(self.known.__getitem__, pieces)))
            if len(text) < LONG:
                break
            first = cut.kinds.match(text)
            self.kind = first.lastgroup
            lead = first.start(self.kind)
            out.append(self._bytes(text[:lead].encode(), False))
            text = text[lead:]
        self.rest = text
        return b"".join(out)

    def _bytes(self, data: bytes, closed: bool) -> bytes:
        """Ids of a long piece that are certain; all that are left where it is closed."""
        out, ahead = [], self.vocabulary.lookahead
        data, self.window = self.window + data, b""
        size = max(ahead, LONG)
        while len(data) > ahead + size or (closed and data):
            here = data[: ahead + size]
            tokens = merged(here, self.vocabulary.ranks)
            if len(here) == len(data) and closed:
                out.append(self.known.packed(tokens))
                return b"".join(out)
            done = stable = 0
            for token in tokens:
                if done + len(token) > len(here) - ahead:
                    break
                done, stable = done + len(token), stable + 1
            out.append(self.known.packed(tokens[:stable]))
            data = data[done:]
        self.window = data
        return b"".join(out)


def incomplete(data: bytes) -> int:
    """How many bytes at the end of ``data`` begin a character that further bytes can still make whole (0 to 3)."""
    for back in range(1, min(3, len(data)) + 1):
        lead = data[-back]
        if lead >= 0xC0:
            needs = 2 if 0xC2 <= lead <= 0xDF else 3 if 0xE0 <= lead <= 0xEF else 4 if 0xF0 <= lead <= 0xF4 else 0
            if needs <= back:
                return 0
            if back > 1:
                # Second bytes that give a shorter form, a surrogate or a number beyond the last character end the attempt.
                low, high = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(lead, (0x80, 0xBF))
                return back if low <= data[1 - back] <= high else 0
            return back
        if lead < 0x80:
            return 0
    return 0


class Decoder:
    """Packed ids in chunks to text; a character cut between two chunks is held until it is whole.

    Bytes that are no UTF-8 become U+FFFD, one for each longest beginning of a character.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.tokens, self.held = vocabulary.tokens, b""

    def feed(self, packed: bytes) -> str:
        data = self.held + b"".join(map(self.tokens.__getitem__, np.frombuffer(packed, "<u4").tolist()))
        keep = incomplete(data)
        self.held = data[len(data) - keep :]
        return data[: len(data) - keep].decode("utf-8", "replace")

    def finish(self) -> str:
        held, self.held = self.held, b""
        return held.decode("utf-8", "replace")


_LOADED: dict[str, tuple[Vocabulary, _Remembered]] = {}


def digest(*contents: bytes) -> str:
    return hashlib.sha256(b"".join(contents)).hexdigest()


def loaded(key: str, content: Callable[[], bytes]) -> tuple[Vocabulary, _Remembered]:
    """Vocabulary and remembered pieces of a file with the digest ``key``, once per worker process; only the last two files stay."""
    if key not in _LOADED:
        while len(_LOADED) > 1:
            _LOADED.pop(next(iter(_LOADED)))
        vocabulary = Vocabulary(content().decode())
        _LOADED[key] = vocabulary, _Remembered(vocabulary)
    return _LOADED[key]


def sent(spark: SparkSession, file: str) -> Callable[[], tuple[Vocabulary, _Remembered]]:
    """The file, read on the driver (a few megabytes) and broadcast, as a function for the workers."""
    with open(file, "rb") as source:
        content = source.read()
    key, shared = digest(content), spark.sparkContext.broadcast(content)
    return lambda: loaded(key, lambda: shared.value)


def encoded_chunks(text: str, encoder: Encoder) -> Iterator[bytes]:
    for at in range(0, len(text), CHUNK):
        yield encoder.feed(text[at : at + CHUNK])
    yield encoder.finish()


def encode(df: DataFrame, file: str, text: str = "text", ids: str = "ids", special: bool = True) -> DataFrame:
    """All columns of ``df`` but ``text``, and the ids of every whole text as packed little-endian unsigned 32-bit integers.

    A null text is empty: no ids. A column ``ids`` of ``df`` is
    replaced. ``special`` as in ``Encoder``.
    """
    known = sent(df.sparkSession, file)

    def packed(value: str | None) -> bytes:
        vocabulary, pieces = known()
        return b"".join(encoded_chunks(value or "", Encoder(vocabulary, special, pieces)))

    return add_column(df, text, ids, "binary", packed)


def decode(df: DataFrame, file: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """All columns of ``df`` but ``ids``, and the text that the packed ids stand for; special tokens stand for their strings.

    Null ids are empty. An id that the vocabulary lacks is an error. A column ``text`` of ``df`` is replaced.
    """
    known = sent(df.sparkSession, file)

    def whole(value: bytes | None) -> str:
        decoder, data = Decoder(known()[0]), value or b""
        return "".join([*(decoder.feed(data[at : at + 4 * CHUNK]) for at in range(0, len(data), 4 * CHUNK)), decoder.finish()])

    return add_column(df, ids, text, "string", whole)
