"""Byte-pair transducers, token alignment and phrases against the libraries and plain versions."""

from __future__ import annotations

import hashlib
import json
import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from gridloom.llm import byte_bpe, phrases, queries, token_align
from gridloom.session import scratch_paths

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, lang string, ids string, pairs string, n_a string, count_sum string, w1 string, f string, rank string"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BYTES)


@pytest.fixture(scope="module")
def vocabulary():
    with open(BYTES, "rb") as file:
        return byte_bpe.loaded("file of the tests", file.read)


@pytest.fixture(scope="module")
def docs(spark, edge_rows):
    extra = [(11, "ends in <|endoftext|>", "en"), (12, "<|endoftext|> and <|endof", None), (13, "a▁b has the space sign", "en"), (14, "\U0001f600é日本", "de"),
             (15, "x" * 20_000 + " " * 9_000 + "y", "en"), (15, "repeated key, other text", "en")]
    rows = [(i, t, "en" if (i or 0) % 2 else None) for i, t in edge_rows] + extra
    return spark.createDataFrame([(i, t, lang, *["x"] * 7) for i, t, lang in rows], DOCS).repartition(3)


def packed(ids):
    return np.array(ids, "<u4").tobytes()


def in_chunks(encoder, text, sizes):
    out, at = [], 0
    while at < len(text):
        step = sizes()
        out.append(encoder.feed(text[at : at + step]))
        at += step
    return np.frombuffer(b"".join(out) + encoder.finish(), "<u4").tolist()


def test_chunks_of_any_size_encode_as_the_library(vocabulary, library):
    draw = random.Random(5)
    parts = [*"aab  \n\t'srltedm!?.1234 é日本😀\x00", "<|endoftext|>", "<|end", "'re", "            ", "-----", "guarantee", "ing", "՘", "\U0002ebf0"]
    for _ in range(1500):
        text = "".join(draw.choice(parts) for _ in range(draw.randint(0, 60)))
        got = in_chunks(byte_bpe.Encoder(*vocabulary[:1], True, vocabulary[1]), text, lambda: draw.randint(1, 7))
        assert got == library.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("text", ["a" * 60_000, " " * 30_000 + "x", "-=" * 20_000, "1234567" * 5_000, "日本語" * 9_000, "'" * 9_000 + "s", " " * 5_000 + "'s", "guaranteeing" * 3_000, "\n " * 5_000 + "<|endoftext|>" + " " * 5_000])
def test_long_pieces_keep_a_bounded_window(vocabulary, library, text):
    encoder = byte_bpe.Encoder(vocabulary[0], True, vocabulary[1])
    out, held = [], 0
    for at in range(0, len(text), 1_000):
        out.append(encoder.feed(text[at : at + 1_000]))
        held = max(held, len(encoder.window) + len(encoder.rest) + len(encoder.held))
    assert np.frombuffer(b"".join(out) + encoder.finish(), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert held <= 2 * byte_bpe.LONG + vocabulary[0].lookahead + 1_000


def test_lookahead_is_enough_on_small_merge_lists():
    draw = random.Random(9)
    for _ in range(60):
        tokens, merges = [b"a", b"b", b"c"], []
        while len(merges) < 12:
            u, v = draw.choice(tokens), draw.choice(tokens)
            if u + v not in tokens:
                tokens.append(u + v)
                merges.append((u, v))
        ahead, ranks = byte_bpe.lookahead(merges), {m: i for i, m in enumerate(merges)}
        for _ in range(60):
            text = bytes(draw.choice(b"abc") for _ in range(draw.randint(1, 60)))
            whole, cut = byte_bpe.merged(text, ranks), draw.randint(0, len(text))
            ends = np.cumsum([len(t) for t in whole]).tolist()
            seen = np.cumsum([len(t) for t in byte_bpe.merged(text[:cut], ranks)]).tolist()
            assert [e for e in ends if e <= cut - ahead] == [e for e in seen if e <= cut - ahead]
    with pytest.raises(ValueError):
        byte_bpe.lookahead([(b"ab", b"c")])


def test_decoder_gives_the_library_s_text_for_any_ids(vocabulary, library):
    draw = random.Random(7)
    raw = [0x41, 0x80, 0xBF, 0xA0, 0xE0, 0xED, 0xF0, 0xF4, 0xC2, 0xC1, 0xF5, 0x90, 0x9F]
    for turn in range(600):
        ids = [draw.randrange(50_257) for _ in range(20)] if turn % 2 else [vocabulary[0].ids[bytes([draw.choice(raw)])] for _ in range(60)]
        decoder, data = byte_bpe.Decoder(vocabulary[0]), packed(ids)
        text = "".join([*(decoder.feed(data[at : at + 4]) for at in range(0, len(data), 4)), decoder.finish()])
        assert text == library.decode(ids, skip_special_tokens=False)
        assert len(decoder.held) == 0


def test_round_trip_over_rows(spark, docs, library):
    encoded = byte_bpe.encode(docs, BYTES)
    back = byte_bpe.decode(encoded, BYTES, text="decoded")
    assert set(back.columns) == set(docs.columns) - {"text", "ids"} | {"decoded"}
    got = sorted((r["doc_id"] or 0, r["decoded"]) for r in back.collect())
    assert got == sorted((r["doc_id"] or 0, r["text"] or "") for r in docs.collect())
    ids = sorted((r["doc_id"] or 0, bytes(r["ids"])) for r in encoded.collect())
    assert ids == sorted((r["doc_id"] or 0, packed(library.encode(r["text"] or "", add_special_tokens=False).ids)) for r in docs.collect())
    assert byte_bpe.encode(docs.limit(0), BYTES).count() == 0


def test_byte_bpe_query_equals_the_library(spark, library):
    got = {r["doc_id"]: r for r in queries.op13_byte_bpe(spark, "/root/testdata/sf0.001").collect()}
    for doc_id, text in duckdb.sql("SELECT doc_id, text FROM '/root/testdata/sf0.001/documents.parquet'").fetchall():
        ids = library.encode(text or "", add_special_tokens=False).ids
        want = (len(ids), hashlib.sha256(packed(ids)).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())
        assert (got[doc_id]["n_tokens"], got[doc_id]["ids_sha256"], got[doc_id]["decoded_sha256"]) == want


def test_other_kinds_of_files_are_refused():
    data = json.load(open(BYTES, encoding="utf-8"))
    data["normalizer"] = {"type": "Lowercase"}
    with pytest.raises(ValueError):
        byte_bpe.Vocabulary(json.dumps(data))


def plain_alignment(rows):
    """Every pair of tokens compared by their byte ranges."""
    first, second = Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    first.encode_special_tokens = True
    alphabet, out, counts = byte_bpe.byte_alphabet(), [], Counter()
    for key, text in rows:
        a = first.encode(f" {text}", add_special_tokens=False).ids if text else []
        b = second.encode(text) if text else []
        a_bytes = [bytes(alphabet[c] for c in first.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(second.id_to_piece(i)[3:5], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or not b"".join(a_bytes) == b"".join(b_bytes) == f" {text}".encode():
            out.append((key, [], [], [], []))
            continue
        a_ends, b_ends = np.cumsum([len(t) for t in a_bytes]).tolist(), np.cumsum([len(t) for t in b_bytes]).tolist()
        shared = sorted(set(a_ends) & set(b_ends))
        groups, i, j = [], 0, 0
        for end in shared:
            i_end, j_end = a_ends.index(end, i) + 1, b_ends.index(end, j) + 1
            groups.append((a[i:i_end], b[j:j_end]))
            i, j = i_end, j_end
        pairs = []
        low = 0
        for i, end in enumerate(a_ends):
            start = end - len(a_bytes[i])
            while b_ends[low] <= start:
                low += 1
            j = low
            while j < len(b) and b_ends[j] - len(b_bytes[j]) < end:
                pairs.append((a[i], b[j]))
                j += 1
        counts.update(pairs)
        out.append((key, a, b, groups, pairs))
    top = {}
    for (_, y), n in counts.items():
        top[y] = max(top.get(y, 0), n)
    return sorted(
        (key or 0, len(a), len(b), len(groups), len(pairs), sum(counts[p] == top[p[1]] for p in pairs), sum(counts[p] for p in pairs),
         hashlib.sha256(";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups).encode()).hexdigest() if a else "")
        for key, a, b, groups, pairs in out
    )


def digests(found):
    return sorted((r["doc_id"] or 0, r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"],
                   hashlib.sha256(r["groups"].encode()).hexdigest() if r["n_a"] else "") for r in found.collect())


@pytest.mark.parametrize("common", [1 << 17, 40, 0])
def test_alignment_equals_pairwise_ranges(spark, docs, common, monkeypatch):
    monkeypatch.setattr(token_align, "COMMON", common)
    some = docs.where("length(text) < 40000 or text is null")
    aligned = token_align.align(some, BYTES, PIECES)
    assert {"lang", "rank", "w1"} < set(aligned.columns)
    got = token_align.associate(aligned, token_align.b_width(PIECES))
    assert digests(got) == plain_alignment([(r["doc_id"], r["text"]) for r in some.collect()])
    assert token_align.associate(token_align.align(docs.limit(0), BYTES, PIECES), 32_000).count() == 0


def test_alignment_query_equals_pairwise_ranges(spark):
    got = queries.op12_token_align(spark, "/root/testdata/sf0.001").collect()
    rows = duckdb.sql("SELECT doc_id, text FROM '/root/testdata/sf0.001/documents.parquet'").fetchall()
    assert sorted(tuple(r[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) for r in got) == plain_alignment(rows)


def test_words_encode_as_whole_texts():
    draw, model = random.Random(8), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    words = token_align._Words(model)
    assert words.apart
    parts = [*"aab   \n\té日本😀\x00.,!1234", "the", "hello", "   ", "▁", "<s>", "Ã", "\u00a0", "\u3000", "ing"]
    for _ in range(3000):
        text = "".join(draw.choice(parts) for _ in range(draw.randint(1, 40)))
        assert words.encode(text) == model.encode(text), repr(text)


def test_stretches_of_all_kinds():
    draw = random.Random(3)
    for _ in range(500):
        total = draw.randint(1, 60)
        a, b = (sorted({*(draw.randint(1, total) for _ in range(draw.randint(0, 60))), total}) for _ in range(2))
        found = token_align.stretches(a, b)
        assert [x[0] for x in found] == [0, *(x[1] for x in found[:-1])] and found[-1][1::2] == (len(a), len(b))
        ends = []
        for i, i_end, j, j_end in found:
            ends += a[i:i_end] if a[i] == b[j] else [a[i_end - 1]]
            assert a[i] != b[j] or a[i:i_end] == b[j:j_end]
        assert ends == sorted(set(a) & set(b))
        left, right = (x.tolist() for x in token_align.links(np.array(a), np.array(b)))
        spans = [[(x, y) for x, y in zip([0, *e[:-1]], e, strict=True)] for e in (a, b)]
        assert list(zip(left, right, strict=True)) == [(i, j) for i, (x, y) in enumerate(spans[0]) for j, (u, v) in enumerate(spans[1]) if x < v and u < y]


def plain_phrases(rows, least, longest, top):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lowered):
            words = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for n in range(1, longest + 1):
                counts.update((lang, tuple(words[i : i + n])) for i in range(len(words) - n + 1))
    found = {key: a for key, a in counts.items() if len(key[1]) > 1 and a >= least}
    out = {}
    for (lang, words), a in found.items():
        inside = any(m == lang and len(longer) > len(words) and 100 * f >= 50 * a and any(longer[o : o + len(words)] == words for o in range(len(longer) - len(words) + 1))
                     for (m, longer), f in found.items())
        if not inside:
            cuts = [(counts[lang, words[:k]], counts[lang, words[k:]]) for k in range(1, len(words))]
            score, _, left, right = min((1_000_000 * a * a // (x * y), k, x, y) for k, (x, y) in enumerate(cuts))
            out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), left, right))
    return sorted((lang, i + 1, p.decode(), -a, x, y, totals[lang], -s) for lang, rows in out.items() for i, (s, a, p, x, y) in enumerate(sorted(rows)[:top]))


def small_corpus(seed):
    draw = random.Random(seed)
    words = ["the", "The", "cat", "sat", "é", "mat-x", "日本", "on", "o", "...", "a", "\x0b"]
    weights = [9, 2, 6, 5, 2, 2, 1, 4, 1, 3, 8, 1]
    return [(draw.choice(["en", "de", None]), " ".join(draw.choices(words, weights, k=draw.randint(0, 60))).replace("o a", "o\ta").replace("sat on", "sat, on")) for _ in range(150)]


@pytest.mark.parametrize(("least", "longest", "top", "small"), [(10, 3, 2000, False), (3, 4, 15, False), (4, 3, 50, True)])
def test_phrases_equal_a_plain_count(spark, monkeypatch, least, longest, top, small):
    if small:
        monkeypatch.setattr(phrases, "DICTIONARY", 6)
        monkeypatch.setattr(phrases, "BLOCK", 10)
        monkeypatch.setattr(phrases, "AT_ONCE", 2_000)
    rows = [*small_corpus(least), ("en", None), ("en", ""), ("fr", " \t.,"), (None, "the cat " * 20_000), ("en", "x" * 50_000)]
    docs = spark.createDataFrame([(i, t, lang, *["x"] * 7) for i, (lang, t) in enumerate(rows)], DOCS).repartition(4)
    got = phrases.collocations(docs, least=least, longest=longest, top=top)
    assert sorted(tuple(r) for r in got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()) == plain_phrases(rows, least, longest, top)


def test_phrases_of_empty_tables(spark):
    for rows in ([], [(1, None, None, *["x"] * 7)]):
        assert phrases.collocations(spark.createDataFrame(rows, DOCS)).count() == 0


def test_scores_are_exact_beyond_64_bits(spark):
    big = 3_000_000_000_000
    words = spark.createDataFrame([(1, "en", "a", big), (2, "en", "b", big + 1)], "id int, lang string, word string, f long")
    levels = {2: spark.createDataFrame([(1, 2, big - 1)], "w1 int, w2 int, f long")}
    row = phrases.scored(levels, 2, words).first()
    assert row["score"] == 1_000_000 * (big - 1) ** 2 // (big * (big + 1))


def test_trie_finds_what_a_set_finds():
    draw = np.random.default_rng(4)
    for n, most in ((2, 5), (3, 40), (3, 3000)):
        rows = np.unique(draw.integers(1, most + 1, (4000, n)), axis=0)
        trie = phrases.Trie(rows.astype(np.int64), math.isqrt(most) + 1)
        again = phrases.Trie.unpacked(trie.packed(), trie.base, n)
        ids = np.append(draw.integers(0, most + 1, 30_000), 0).astype(np.int32)
        ids[:n] = rows[7]
        known = {tuple(r): k for k, r in enumerate(rows.tolist())}
        got = {}
        for at, state in again.states(ids):
            ends = again.accept[state]
            got |= dict(zip(at[ends >= 0].tolist(), ends[ends >= 0].tolist(), strict=True))
        want = {i: known[key] for i in range(len(ids)) if (key := tuple(ids[i : i + n].tolist())) in known}
        assert got == want and want


@pytest.mark.parametrize(("n", "size"), [(2, 5), (2, 1 << 31), (3, 1 << 20), (3, 1 << 30), (4, 1 << 31)])
def test_packed_phrases_come_back(n, size):
    draw = np.random.default_rng(n)
    ids = draw.integers(max(0, size - 40), size, 5_000).astype(np.int32)
    at = np.arange(len(ids) - n)
    packing = phrases.Packing(n, size)
    keys, times = phrases.distinct(packing.keys(ids, at), np.ones(len(at), np.int32), 7)
    again, counts = packing.unpack(packing.pack(keys, times), len(times))
    got = dict(zip(map(tuple, np.stack(packing.words(again), 1).tolist()), counts.tolist(), strict=True))
    assert got == {key: min(f, 7) for key, f in Counter(tuple(ids[i : i + n].tolist()) for i in at).items()}
    parts = packing.parts(keys, 8)
    assert parts.min() >= 0 and parts.max() < 8
    assert packing.unpack(packing.pack([k[:0] for k in keys], times[:0]), 0)[1].size == 0


def id_rows(spark, rows):
    return spark.createDataFrame([(len(r), phrases._pressed(np.array(r, np.int32)), None) for r in rows], "size int, ids binary, marks binary").repartition(2)


def test_rare_phrases_are_sent_packed(spark, monkeypatch):
    draw = np.random.default_rng(2)
    rows = [[*draw.integers(1, 50_000, 20_000).tolist(), 7, 8] for _ in range(8)]
    corpus = id_rows(spark, rows)
    sent = phrases.proposals(corpus, 2, 3, 50_000, 4).toPandas()
    assert len(sent) <= 2 * 4 and sent["packed"].map(len).sum() < 5 * sent["size"].sum()
    pairs = Counter(pair for r in rows for pair in zip(r, r[1:], strict=False))
    for keys in (phrases.KEYS, 3_000):
        monkeypatch.setattr(phrases, "KEYS", keys)
        found = {tuple(r) for r in phrases.proposed(corpus, 2, 3, 50_000, 160_000).collect()}
        assert found == {pair for pair, f in pairs.items() if f >= 3} and (7, 8) in found


def test_one_copy_of_the_corpus_stays_and_counts_are_sent_in_slots(spark, monkeypatch):
    monkeypatch.setattr(phrases, "BLOCK", 50)
    draw = np.random.default_rng(3)
    rows = [draw.integers(0, 30, 3_000).tolist() for _ in range(6)]
    corpus, wanted = id_rows(spark, rows), spark.createDataFrame([(i, j) for i in range(1, 15) for j in range(1, 15)], "w1 int, w2 int")
    built = phrases.built_tries(wanted, 2, 6)
    assert built.count() > 2
    before = scratch_paths(spark)
    marks = phrases.marked(corpus.select("size", "ids"), phrases.tries(built, 2, 6))
    assert len(scratch_paths(spark)) == len(before) + 1
    pairs = Counter(pair for r in rows for pair in zip(r, r[1:], strict=False) if 1 <= min(pair) and max(pair) < 15)
    assert sum(int(m[:-1].sum()) for _, m in phrases._task_rows(marks.toArrow().to_batches())) == pairs.total()
    counts = phrases.counted(corpus, phrases.tries(built, 2, 6), 2)
    assert {(r["w1"], r["w2"]): r["f"] for r in counts.collect()} == pairs


def counting_copies(monkeypatch):
    """The number of tables written by the module, in a list."""
    copies, cut_lineage = [], phrases.cut_lineage
    monkeypatch.setattr(phrases, "cut_lineage", lambda df: copies.append(1) or cut_lineage(df))
    return copies


def test_the_corpus_is_read_once_whatever_the_number_of_tries(spark, monkeypatch):
    monkeypatch.setattr(phrases, "BLOCK", 20)
    draw = np.random.default_rng(5)
    corpus, wanted = id_rows(spark, [draw.integers(0, 30, 2_000).tolist() for _ in range(4)]), spark.createDataFrame([(i, j) for i in range(1, 15) for j in range(1, 15)], "w1 int, w2 int")
    built = phrases.built_tries(wanted, 2, 6)
    assert built.count() > 6
    copies = counting_copies(monkeypatch)
    phrases.counted(corpus, phrases.tries(built, 2, 6), 2)
    assert len(copies) == 1
    phrases.marked(corpus.select("size", "ids"), phrases.tries(built, 2, 6))
    assert len(copies) == 2


@pytest.mark.parametrize(("n", "base", "filtered"), [(2, 6, 1 << 25), (3, 6, 60), (3, 40_000, 1 << 25)])
def test_phrases_that_only_pass_the_filter_are_not_counted_or_marked(spark, monkeypatch, n, base, filtered):
    """With the third base, keys of three words take two columns."""
    monkeypatch.setattr(phrases, "BLOCK", 50)
    monkeypatch.setattr(phrases, "BITS", 1)
    monkeypatch.setattr(phrases, "FILTERED", filtered)
    monkeypatch.setattr(phrases, "KEYS", 700)
    draw = np.random.default_rng(n)
    rows = [draw.integers(0, 12, 3_000).tolist() for _ in range(5)]
    every = Counter(x for r in rows for x in zip(*(r[k:] for k in range(n)), strict=False) if min(x))
    wanted = {x for x in every if sum(x) % 3 == 0}
    built = phrases.built_tries(spark.createDataFrame(sorted(wanted), ", ".join(f"w{k + 1} int" for k in range(n))), n, base)
    corpus = id_rows(spark, rows)
    groups = phrases.tries(built, n, base)
    assert len(groups) == 1 or filtered == 60
    found = phrases.counted(corpus, groups, n).collect()
    assert {tuple(r)[:-1]: r["f"] for r in found} == {x: every[x] for x in wanted} and len(found) == len(wanted)
    assert sum(g.answers.where("f = 0").count() for g in groups)
    for known in (groups, phrases.tries(built, n, base)):
        marks = phrases.marked(corpus.select("size", "ids"), known)
        got = [(ids[:-1].tolist(), np.flatnonzero(m).tolist()) for ids, m in phrases._task_rows(marks.toArrow().to_batches())]
        assert sorted(got) == sorted((r, [i for i in range(len(r)) if tuple(r[i : i + n]) in wanted]) for r in rows)


def test_collocations_with_many_small_tries_and_a_weak_filter(spark, monkeypatch):
    for name, value in (("BLOCK", 5), ("BITS", 1), ("FILTERED", 40), ("KEYS", 300)):
        monkeypatch.setattr(phrases, name, value)
    rows = small_corpus(8)
    docs = spark.createDataFrame([(i, t, lang, *["x"] * 7) for i, (lang, t) in enumerate(rows)], DOCS).repartition(3)
    got = phrases.collocations(docs, least=3, longest=3, top=100)
    assert sorted(tuple(r) for r in got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()) == plain_phrases(rows, 3, 3, 100)


def test_words_of_one_hash_keep_their_ids(monkeypatch):
    draw = random.Random(6)
    words = sorted({"".join(draw.choices("abé日", k=draw.randint(1, 9))) for _ in range(3_000)})
    asked = pa.array(["no", *words[::3], "x" * 70_000, "b" * 12])
    want = [{w: i + 5 for i, w in enumerate(words[::2])}.get(w, 0) for w in asked.to_pylist()]
    assert phrases.Numbered(pa.array(words[::2]), 5).of(asked).tolist() == want
    assert phrases.Numbered(pa.array(words[::2]), 5).of(asked.slice(7, 90)).tolist() == want[7:97]
    hashes = phrases.word_hashes
    monkeypatch.setattr(phrases, "word_hashes", lambda found: hashes(found) % np.uint64(200))
    assert phrases.Numbered(pa.array(words[::2]), 5).of(asked).tolist() == want


def test_texts_are_cut_once_for_all_blocks_of_the_dictionary(spark, monkeypatch):
    """Later blocks work on the distinct words of a row, which hold no text."""
    monkeypatch.setattr(phrases, "DICTIONARY", 6)
    docs = spark.createDataFrame([("en" if i % 3 else "de", f"the cat sat on. the mat {'again and ' * i}") for i in range(40)], "lang string, text string").repartition(2)
    counts = phrases.word_counts(docs).where("word is not null")
    written, cut_lineage = [], phrases.cut_lineage
    monkeypatch.setattr(phrases, "cut_lineage", lambda df: written.append(df.columns) or cut_lineage(df))
    corpus, words = phrases.number_words(docs, counts)
    passes = [columns for columns in written if columns != ["id", "lang", "word", "f"]]
    assert len(passes) > 1 and all("words" in c for c in passes[:-1]) and passes[-1] == ["size", "ids"]
    spelled = {r["id"]: (r["lang"], r["word"]) for r in words.collect()}
    found = Counter(spelled[i] for ids, _ in phrases._task_rows(corpus.toArrow().to_batches()) for i in ids.tolist() if i)
    assert found == {(r["lang"], r["word"]): r["f"] for r in counts.collect()}


def test_languages_of_short_texts_are_cut_together(monkeypatch):
    monkeypatch.setattr(phrases, "AT_ONCE", 4_000)
    draw = random.Random(3)
    rows = [(draw.choice(["en", "de", "fr"]), draw.choice([None, "", "short text", "x" * draw.randint(0, 900)])) for _ in range(3_000)]
    batches = pa.RecordBatch.from_pydict({"lang": [r[0] for r in rows], "text": pa.array([r[1] for r in rows], pa.string())})
    found = list(phrases._by_language(batches.slice(at, 40) for at in range(0, len(rows), 40)))
    assert Counter((lang, t) for lang, texts in found for t in texts) == Counter(rows)
    assert len(found) < 150 and max(sum(len(t or "") for t in texts) for _, texts in found) < 20_000


def test_both_encoders_of_the_aligner_agree():
    with open(BYTES) as one, open(PIECES, "rb") as two:
        vocabulary, model = byte_bpe.Vocabulary(one.read()), two.read()
    pair = token_align.Pair(vocabulary, byte_bpe._Remembered(vocabulary), model)
    slow = token_align.Pair(vocabulary, pair.known, model)
    slow.quick = None
    draw = random.Random(11)
    texts = ["".join(draw.choice("abcdeinorst"[: draw.choice([3, 11])]) for _ in range(draw.randint(1, 40))) for _ in range(3000)]
    texts += [f"x{c}1{c}!{c} {c}y  {c}" for c in map(chr, [*range(0x3000), *range(0x3000, 0xD800, 97), *range(0xE000, 0x110000, 211)])]
    texts += ["x" * 3000, "a" + " " * 3000 + "b", "<|endoftext|> it's  \n\n end "]
    assert pair.quick is not None
    for text in texts:
        assert pair.encode_a(text) == slow.encode_a(text), repr(text)


def test_remembered_parts_over_generations(monkeypatch):
    monkeypatch.setattr(token_align, "REMEMBERED", 8)
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    words, draw = token_align._Words(model), random.Random(4)
    for _ in range(500):
        text = " ".join(draw.choice("abcdefghijklmnop") * draw.choice([1, 2, 90]) for _ in range(draw.randint(1, 12)))
        assert words.parts(text) == (model.encode(text), True)
        assert all(len(part) <= byte_bpe.REMEMBERED_CHARS for part in words)


def test_words_are_merged_by_number_with_few_lookups(vocabulary):
    known, draw = vocabulary[0], random.Random(6)

    class Counting(dict):
        asked = 0

        def get(self, key, default=None):
            self.asked += 1
            return super().get(key, default)

    joins, known.joins = known.joins, Counting(known.joins)
    try:
        for _ in range(2_000):
            data = "".join(draw.choices("etaoin shrdlu'é日\U0001f600\0ABC019", k=draw.randint(0, 9))).encode()[: byte_bpe.FEW]
            before = known.joins.asked
            ids = byte_bpe.few_merged(data, known)
            assert [known.tokens[i] for i in ids] == byte_bpe.merged(data, known.ranks)
            # The pairs at the beginning, and two for each merge.
            assert known.joins.asked - before <= max(0, len(data) - 1) + 2 * (len(data) - len(ids))
    finally:
        known.joins = joins


def test_a_merge_to_no_token_is_an_error():
    letters = byte_bpe.byte_alphabet()
    model = {"type": "BPE", "vocab": {c: i for i, c in enumerate(letters)}, "merges": ["a b"]}
    lacks = byte_bpe.Vocabulary(json.dumps({"model": model, "pre_tokenizer": {"type": "ByteLevel"}}))
    assert byte_bpe.few_merged(b"ba", lacks) == [lacks.ids[b"b"], lacks.ids[b"a"]]
    with pytest.raises(KeyError):
        byte_bpe.few_merged(b"ab", lacks)


def test_groups_are_spelled_as_walked_and_parts_encoded_once():
    with open(BYTES) as one, open(PIECES, "rb") as two:
        vocabulary, model = byte_bpe.Vocabulary(one.read()), two.read()
    pair, draw = token_align.Pair(vocabulary, byte_bpe._Remembered(vocabulary), model), random.Random(5)
    for _ in range(300):
        total = draw.randint(1, 60)
        ends = [np.array(sorted({*(draw.randint(1, total) for _ in range(draw.randint(0, 60))), total})) for _ in range(2)]
        a, b = (np.array([draw.randrange(30_000) for _ in e]) for e in ends)
        walked, i, j = [], 0, 0
        for end in sorted(set(ends[0].tolist()) & set(ends[1].tolist())):
            i_end, j_end = (int(np.searchsorted(e, end)) + 1 for e in ends)
            walked.append(f"{','.join(map(str, a[i:i_end]))}|{','.join(map(str, b[j:j_end]))}")
            i, j = i_end, j_end
        found = np.array(token_align.stretches(*(e.tolist() for e in ends)))
        irregular = found[ends[0][found[:, 0]] != ends[1][found[:, 2]]]
        assert pair.spell(a, b, irregular) == (";".join(walked), len(walked))
    real, asked = pair.words.model, []

    class Asked:
        def encode(self, part, **options):
            asked.append(part)
            return real.encode(part, **options)

    pair.words.model = Asked()
    text = "some words and some more words and words"
    assert pair.words.parts(text) == (real.encode(text), True) and pair.words.parts(text) == (real.encode(text), True)
    assert sorted(asked) == sorted(set(text.split()))
