"""Identifiers against the plain patterns, disguises, and edge cases."""

import hashlib
import random
import re

import pytest

from gridloom.llm import pii, queries


def luhn(digits):
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def plain(text):
    """The patterns as written down, leftmost and without overlaps."""
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    found += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(found)


def test_base_spans_equal_the_patterns():
    rng = random.Random(1)
    alphabet = ["a", "B.c", "@", "@x", ".", "1", "22", "255", "256", "4", "0", " ", "-", "+", "(", ")", "é", "\n", "x@y.z", "4111111111111111", "10.0.0.1", "%", "_"]
    for _ in range(4000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
        assert pii.identifiers(text) == plain(text), text


def found(text):
    return [(pii.KINDS[k], text[s:e], b) for s, k, e, b in pii.all_spans(text)]


def test_disguises_map_back_to_the_source():
    assert found("jo [at] mail [dot] example [dot] com") == [("email", "jo [at] mail [dot] example [dot] com", False)]
    assert found("ask anna at example dot org today") == [("email", "anna at example dot org", False)]
    assert found("jоhn@exаmple.com") [0][1:] == ("jоhn@exаmple.com", False) or ("email", "jоhn@exаmple.com", False) in found("jоhn@exаmple.com")
    assert found("call plus four nine one seven zero one two three four five six seven now") == [
        ("phone", "plus four nine one seven zero one two three four five six seven", False)]
    assert found("one nine two dot one six eight dot zero dot one") == [("ip", "one nine two dot one six eight dot zero dot one", False)]
    assert found("４１１１１１１１１１１１１１１１") == [
        ("card", "４" + "１" * 15, False)]
    assert found("a​.b@c­.org") [-1][1] in ("a​.b@c­.org", ".b@c­.org")


def test_plain_prose_has_no_spans():
    for text in ("We met at noon. One of seven people saw two dots.", "почта дом", "look at the dot on page three", "un deux trois", "1 2 3 4"):
        assert found(text) == []


def test_query_columns(spark, make_docs, edge_rows):
    rows = queries.span_columns(pii.find_identifiers(make_docs(edge_rows)), pii.KINDS).collect()
    assert len(rows) == len(edge_rows)
    by_text = {}
    for r in rows:
        by_text.setdefault(r["doc_id"], r)
    text = edge_rows[0][1]
    spans = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in plain(text))
    assert by_text[1]["spans"] == spans and by_text[1]["base_sha256"] == hashlib.sha256(spans.encode()).hexdigest()
    assert (by_text[1]["n_email"], by_text[1]["n_phone"], by_text[1]["n_card"]) == (1, 1, 0)
    for key in (2, 3, 4, 5, 7, 8, None):
        assert by_text[key]["spans"] == "" and by_text[key]["base_sha256"] == hashlib.sha256(b"").hexdigest()


def test_empty_table_and_redaction(spark, make_docs, edge_rows):
    assert pii.find_identifiers(make_docs([])).count() == 0
    docs = make_docs(edge_rows)
    out = pii.redact(docs)
    assert out.columns == docs.columns and out.count() == len(edge_rows)
    texts = {r["doc_id"]: r["text"] for r in out.collect()}
    assert texts[1] == "Hello there, write to <EMAIL> or <PHONE> now." and texts[2] is None and texts[3] == ""


@pytest.mark.parametrize("digits", [5_000, 50_000])
def test_long_runs_of_digits(digits):
    zeros, nines = "0" * digits, "9" * digits
    found = pii.identifiers(f"{zeros}.1.1.1 and {nines}.1.1.1 and 1.{zeros}7.255.000255")
    assert [(k, e - s) for s, k, e in found if k == 1] == [(1, digits + 6), (1, digits + 14)]


@pytest.mark.parametrize(("text", "disguised"), [("anna at host dot it", True), ("anna at host dot at", True), ("anna at host dot cloud", True), ("anna at host dot of", False), ("anna at noon dot maybe", False)])
def test_endings_of_bare_addresses(spark, text, disguised):
    row = pii.find_identifiers(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert bool(row["spans"]) is disguised
