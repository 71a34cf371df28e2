"""Main text of pages; packaged archives."""

import re
import time
import random
import hashlib
import base64
import struct
import zipfile

import numpy as np
import pyarrow.fs as fs
import pytest

from gridloom.llm import page_text, warc
from gridloom.llm.common import table

PAGES = "page_id long, url string, html string, TEXT string, digest string, original string, path string"


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], PAGES)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><article>";</script></head><body>
<header><h1>Site name</h1></header><nav><ul><li><a href="/x">Menu entry</a></li></ul></nav><!-- <article>no</article> -->
<div class="cookie-notice">We use cookies all of the time, please accept them now.</div>
<article class="post"><h1>A   title &amp; more</h1><p>First <b>bold</b>&nbsp;words<br>and line.<p>Second &#x41;&eacute; text 1 &lt; 2.
<div class="ad">Buy this thing now, it is really very cheap today</div><aside>On the side</aside>
<ul><li>one<li>two</ul><form><label>Your mail</label><input name=q></form></article>
<section id="comments"><article class="comment">I disagree with all of this, it is wrong.</article></section>
<footer>Copyright words of the footer</footer></body></html>"""


def test_article_without_its_surroundings():
    assert page_text.main_text(PAGE, page_text.DEFAULT) == "A title & more\n\nFirst bold words and line.\n\nSecond Aé text 1 < 2.\n\none\n\ntwo"


def test_pages_without_marked_articles():
    page = "<body><div class=menu><a href=a>Home</a> <a href=b>About</a></div><div><p>Long text of the page that is the content here.</p><p>And more of it, in a second block.</p></div><div id=footer>Imprint</div>"
    assert page_text.main_text(page, page_text.DEFAULT) == "Long text of the page that is the content here.\n\nAnd more of it, in a second block."
    assert page_text.main_text("only plain text", page_text.DEFAULT) == "only plain text"
    for nothing in (None, "", "<p></p>", "<script>x", "<!-- never closed <p>text", "<nav>menu</nav>"):
        assert page_text.main_text(nothing, page_text.DEFAULT) == ""


def test_article_marks_are_evidence_not_the_rule():
    long = "plain words of a long text " * 4
    nested = f"<body><nav>menu</nav><main><h1>The title</h1><p>Some words before it.</p><article><p>{long}</p></article></main><footer>end</footer></body>"
    assert page_text.main_text(nested, page_text.DEFAULT) == f"The title\n\nSome words before it.\n\n{long.strip()}"
    assert {p[2] for p in page_text.parse(nested)} == {0, 1}
    parts = f"<body><article><p>First part. {long}</p></article><article><p>Second part. {long}</p></article></body>"
    assert page_text.main_text(parts, page_text.DEFAULT) == f"First part. {long.strip()}\n\nSecond part. {long.strip()}"
    weights = page_text.DEFAULT | {"<li": -6.0, "<ul": -6.0}
    links = f"<article><p>{long}</p><ul>" + "<li><a href=x>more</a>" * 5 + "</ul></article>"
    assert page_text.main_text(links, weights) == long.strip()
    teaser = f"<body><article><p>One teaser of a few words</p></article><div><p>{long * 20}</p></div></body>"
    assert long.strip() in page_text.main_text(teaser, page_text.DEFAULT)


def test_stretch_equals_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(300):
        x = rng.integers(-3, 4, rng.integers(0, 12)).astype(float)
        sums = [x[i:j].sum() for i in range(len(x)) for j in range(i + 1, len(x) + 1)]
        s, e = page_text.best_stretch(x)
        assert x[s:e].sum() == max([0.0, *sums])


def test_weights_and_edge_cases(spark):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (3, "v", ""), (None, "w", "<p>" + "word " * 50_000), (5, "x", "<<<>>>&&&;&#xFFFFFFFF;")]
    out = page_text.extract(pages_of(spark, rows))
    assert out.columns == ["page_id", "url", "digest", "original", "path", "text"] and out.count() == len(rows)
    got = {r["page_id"]: r["text"] for r in out.collect()}
    assert got[2] == got[3] == "" and len(got[None]) == 50_000 * 5 - 1 and got[1].startswith("A title & more")
    weights = page_text.fit(pages_of(spark, rows))
    assert weights["word"] > 0 > weights["<article"]
    assert page_text.extract(pages_of(spark, [])).count() == 0 and page_text.fit(pages_of(spark, [])) == page_text.DEFAULT


def test_given_pages(spark):
    """On the given pages the content is what the article element holds, block by block."""
    import html
    import re

    pages = table(spark, "/root/testdata/sf0.01", "pages")
    truth = {r["page_id"]: r["html"] for r in pages.collect()}
    for r in page_text.extract(pages).collect():
        inner = re.sub(r"</?(p|h1)\b[^>]*>", "\0", re.search(r"<article>(.*)</article>", truth[r["page_id"]], re.S)[1]).replace("<br>", " ")
        blocks = (" ".join(html.unescape(b).split()) for b in re.sub(r"<[^>]*>", "", inner).split("\0"))
        assert r["text"] == "\n\n".join(b for b in blocks if b)


def digest(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def test_round_trip(spark, tmp_path):
    rows = [(1, "http://a/", "same"), (5, "http://b/", "same"), (5, "http://b/", "same"), (3, "bad url\r\nX: y", "same"), (4, None, None), (2, "e", ""),
            (None, "n", "alone"), (None, "n", "same"), (7, "l", "long é " * 40_000), (8, "c", "a\r\n\r\nWARC/1.1\r\n")]
    out = warc.round_trip(pages_of(spark, rows), str(tmp_path / "p")).collect()
    assert len(out) == len(rows)
    expect = []
    for i, _, html in rows:
        body = (html or "").encode()
        peers = [j for j, _, h in rows if (h or "") == (html or "")]
        top = max((j for j in peers if j is not None), default=None)
        again = len(peers) > 1 and top is not None and i != top
        expect.append((i, len(body), digest(body), "revisit" if again else "response", top if again else None))
    assert sorted(map(repr, expect)) == sorted(repr((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"])) for r in out)
    assert warc.round_trip(pages_of(spark, []), str(tmp_path / "e")).count() == 0


def test_payloads_and_small_packages(spark, tmp_path):
    rows = [(i, f"u{i}", f"page {i} " * (i + 1)) for i in range(300)]
    manifest = warc.write_packages(pages_of(spark, rows).coalesce(1), str(tmp_path / "p"), package_bytes=20_000)
    assert manifest.count() > 1
    got = {r["page_id"]: bytes(r["payload"]).decode() for r in warc.read_packages(manifest, payloads=True, at_once=7).collect()}
    assert got == {i: h for i, _, h in rows}


@pytest.mark.parametrize("wide", [False, True])
def test_directories(tmp_path, monkeypatch, wide):
    """Plain and ZIP64 directories, comments, and members that can't be read by range."""
    if wide:
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
        monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 2)
    path = str(tmp_path / "x.zip")
    with zipfile.ZipFile(path, "w") as z:
        z.comment = b"a comment with PK\x05\x06 inside"
        z.writestr(zipfile.ZipInfo("a"), b"0123456789" * 5)
        z.writestr(zipfile.ZipInfo("b/c"), b"tail of the file")
        z.writestr("d", b"x" * 1000, compress_type=zipfile.ZIP_DEFLATED)
        z.writestr(zipfile.ZipInfo("e"), b"")
    with fs.LocalFileSystem().open_input_file(path) as source:
        found = {m.name: m for m in warc.members(source)}
        assert list(found) == ["a", "b/c", "d", "e"]
        for name, body in (("a", b"0123456789" * 5), ("b/c", b"tail of the file"), ("e", b"")):
            assert source.read_at(found[name].size, warc.data_offset(source, found[name])) == body
        with pytest.raises(ValueError):
            warc.data_offset(source, found["d"])
    bad = str(tmp_path / "bad.zip")
    with open(bad, "wb") as f:
        f.write(struct.pack("<I", 7) * 30)
    with fs.LocalFileSystem().open_input_file(bad) as source, pytest.raises(ValueError):
        warc.members(source)


def test_damaged_payload_is_noticed():
    raw = warc.record(1, "u", b"payload", None, False)
    assert warc.parse_record(raw)["payload"] == b"payload"
    with pytest.raises(ValueError):
        warc.parse_record(raw.replace(b"payload\r\n", b"PAYLOAD\r\n"))


@pytest.mark.parametrize("page", [
    "<a " * 350_000, "<svg>" * 200_000, "<span>" * 80_000 + "</b>" * 120_000, "<span>" * 80_000 + "<hr>" * 120_000, '<a "' * 250_000, "<a '\"" * 200_000 + ">",
    "</p" * 330_000, "<!" * 500_000, "<p><b>" * 160_000, "<" * 1_000_000, "<script" * 140_000, "<!--" * 250_000, "<p>" + "<i>" * 300_000 + "</p>" * 20_000,
])
def test_broken_pages_of_a_megabyte(page):
    started = time.perf_counter()
    page_text.main_text(page + " words", page_text.DEFAULT)
    assert time.perf_counter() - started < 20


def test_words_deep_inside_a_link_are_its_words():
    pieces = page_text.parse("<a><b><i><u><s><em>deep</em></s></u></i></b></a> plain")
    assert [(p[0], p[4].strip()) for p in pieces if p[1]] == [("link word", "deep"), ("word", "plain")]


def test_tag_ends_are_those_of_a_pattern():
    draw = random.Random(6)
    attributes = re.compile(r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>")
    for _ in range(2000):
        page = "".join(draw.choice("ab <>'\"=") for _ in range(draw.randint(0, 25)))
        ends = page_text._TagEnds(page)
        for at in range(len(page) + 1):
            m = attributes.match(page, at)
            assert ends.behind(at) == (m.end() - 1 if m else -1)
