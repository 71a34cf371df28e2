"""Text to tokens. Everything here is a Column expression except Unicode normal forms and word pieces."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.functions import arrays as A

# Character classes of the tokenisers (Java regular expression syntax).
PUNCTUATION = r"[\p{Punct}\p{IsPunctuation}]"
PUNCTUATION_OR_WORD = r"[\p{Punct}\p{IsPunctuation}]|[^\s\p{Punct}\p{IsPunctuation}]+"
WHITESPACE = r"[\p{Z}\t\n\x0B\f\r\x1C-\x1F]"
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]"
NULL_OR_REPLACEMENT_OR_CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F\x{FFFD}]"
NON_SPACING_MARK = r"[\p{Mn}&&[\x{0}-\x{FFFF}]]"

# Code points written as "-"; the soft hyphen is removed instead.
SOFT_HYPHEN = chr(0x00AD)
HYPHEN_CODES = [
    0x002D, 0x007E, 0x058A, 0x05BE, 0x2010, 0x2011, 0x2012, 0x2013, 0x2014, 0x2015, 0x2053, 0x207B,
    0x208B, 0x2212, 0x2E3A, 0x2E3B, 0x301C, 0x3030, 0xFE31, 0xFE32, 0xFE58, 0xFE63, 0xFF0D,
]
HYPHENS = "".join(map(chr, HYPHEN_CODES))

# Reserved tokens.
UNKNOWN, PADDING, BEGIN, END = "<unk>", "<pad>", "<bos>", "<eos>"
BERT_UNKNOWN, BERT_CLASS, BERT_SEPARATOR, BERT_PADDING = "[UNK]", "[CLS]", "[SEP]", "[PAD]"
CODE_RESERVED = ["<unk>", "<cls>", "<sep>", "<msk>"]
MAX_WORD_CHARS = 200
#: Bytes of text that a step in Python takes at once.
SLICE_BYTES = 1 << 20


def split_spaces(text: Column) -> Column:
    """Split on single blanks; empty tokens at the end are dropped, others stay."""
    return (
        F.when(text == "", F.array(F.lit("")))
        .when(text.rlike("^ +$"), F.array().cast("array<string>"))
        .otherwise(F.split(F.regexp_replace(text, " +$", ""), " "))
    )


def join_tokens(tokens: Column, delimiter: str = " ") -> Column:
    return F.array_join(tokens, delimiter)


def lower_tokens(tokens: Column) -> Column:
    return F.transform(tokens, F.lower)


def separate_punctuation(tokens: Column) -> Column:
    """Every punctuation mark becomes a token of its own; blanks separate, empty tokens vanish."""
    return F.flatten(F.transform(tokens, lambda x: F.regexp_extract_all(x, F.lit(PUNCTUATION_OR_WORD), F.lit(0))))


def default_tokens(text: Column) -> Column:
    """Split on blanks, lower-case, separate punctuation: one pass over the text with one pattern."""
    return F.regexp_extract_all(F.lower(text), F.lit(PUNCTUATION_OR_WORD), F.lit(0))


def normalize_hyphens(text: Column) -> Column:
    return F.translate(F.replace(text, F.lit(SOFT_HYPHEN), F.lit("")), HYPHENS, "-" * len(HYPHENS))


def remove_matching(text: Column, pattern: str) -> Column:
    return F.regexp_replace(text, pattern, "")


def replace_matching(text: Column, pattern: str, replacement: str) -> Column:
    return F.regexp_replace(text, pattern, replacement)


def is_whitespace(char: Column) -> Column:
    return char.rlike(f"^{WHITESPACE}$")


def is_control(char: Column) -> Column:
    return char.rlike(f"^{CONTROL}$")


def is_punctuation(char: Column) -> Column:
    return char.rlike(f"^{PUNCTUATION}$")


def unicode_normal(text: Column, form: str = "NFKC") -> Column:
    """Unicode normal form, the one text step without a Spark function; ASCII text passes unchanged."""

    def slice_(values: pa.Array) -> pa.Array:
        if pc.all(pc.fill_null(pc.string_is_ascii(values), True)).as_py():
            return values
        return pa.array([s if s is None or s.isascii() else unicodedata.normalize(form, s) for s in values.to_pylist()], pa.string())

    @F.arrow_udf("string")
    def normal(values: pa.Array) -> pa.Array:
        # Slices of bounded size, as whole batches as Python strings would take several times their bytes.
        values = values.cast(pa.string())
        before = np.cumsum(pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        made, start = [pa.array([], pa.string())], 0
        while start < len(values):
            done = int(before[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(before, done + SLICE_BYTES, "right")))
            made.append(slice_(values.slice(start, stop - start)))
            start = stop
        return pa.concat_arrays(made)

    return normal(text)


def truncate_tokens(tokens: Column, size: int) -> Column:
    return F.slice(tokens, 1, size)


def terminate_tokens(tokens: Column, begin: str | None = BEGIN, end: str | None = END) -> Column:
    parts = [F.array(F.lit(begin))] if begin else []
    parts.append(tokens)
    if end:
        parts.append(F.array(F.lit(end)))
    return F.concat(*parts)


def map_tokens(tokens: Column, function: Callable[[Column], Column]) -> Column:
    """User-defined token processor given as a Column function."""
    return F.transform(tokens, function)


def process(text: Column, *steps: Callable[[Column], Column]) -> Column:
    """A chain of processors, each from token list to token list, starting with the whole text."""
    tokens = F.array(text)
    for step in steps:
        tokens = step(tokens)
    return tokens


def bert_basic_tokens(text: Column, lower: bool = True) -> Column:
    """Clean, lower-case, drop accents and separate punctuation."""
    cleaned = replace_matching(remove_matching(text, NULL_OR_REPLACEMENT_OR_CONTROL), WHITESPACE, " ")
    cleaned = F.lower(cleaned) if lower else cleaned
    bare = remove_matching(unicode_normal(cleaned, "NFD"), NON_SPACING_MARK)
    return F.regexp_extract_all(bare, F.lit(PUNCTUATION_OR_WORD), F.lit(0))


def simple_bert_tokens(text: Column) -> Column:
    """Words between blanks, with one final mark of ``. , ? !`` cut off as a token."""
    pattern = r"(?<=\S)[.,?!](?=\s|\z)|\S+?(?=[.,?!]?(?:\s|\z))"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def camel_case_tokens(line: Column) -> Column:
    """Source code tokens: words broken at capitals and lower-cased, other characters one by one."""
    small = r"[\p{IsAlphabetic}&&[^\p{IsUppercase}]]"
    pattern = rf"\p{{IsUppercase}}{small}*|{small}+|(?s:[^\p{{IsAlphabetic}}])"
    words = F.transform(F.regexp_extract_all(line, F.lit(pattern), F.lit(0)), F.lower)
    return F.when(F.length(line) == 1, F.array(line)).otherwise(words)


def encode_pair(question: Column, paragraph: Column, width: int | None = None) -> dict[str, Column]:
    """``[CLS] question [SEP] paragraph [SEP]`` with type ids, mask and the length without specials."""
    first = F.concat(F.array(F.lit(BERT_CLASS)), question, F.array(F.lit(BERT_SEPARATOR)))
    second = F.concat(paragraph, F.array(F.lit(BERT_SEPARATOR)))
    tokens = F.concat(first, second)
    types = F.concat(F.array_repeat(F.lit(0), F.size(first)), F.array_repeat(F.lit(1), F.size(second)))
    mask = F.array_repeat(F.lit(1), F.size(first) + F.size(second))
    if width is not None:
        tokens = A.pad(tokens, F.lit(BERT_PADDING), width)
        types, mask = A.pad(types, F.lit(0), width), A.pad(mask, F.lit(0), width)
    return {"tokens": tokens, "types": types, "mask": mask, "valid_length": F.size(question) + F.size(paragraph)}


def code_lines(text: Column) -> Column:
    """Lines without trailing blanks, NFKC normalised, blank lines dropped."""
    lines = F.split(unicode_normal(text, "NFKC"), r"\r\n|\r|\n")
    kept = F.transform(lines, lambda s: F.regexp_replace(s, r"[\s\x1C-\x1F]+\z", ""))
    return F.filter(kept, lambda s: s != "")


def review_star_label(rating: Column) -> Column:
    return rating.cast("float") - F.lit(1.0)
