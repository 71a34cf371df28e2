"""Quality, decontamination, mixing, vector index and the pipeline against plain versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gridloom.llm import decontaminate, mixing, multi_index, pii, quality, simhash
from gridloom.llm.common import fold, table
from gridloom.llm.queries import quality_model

SMALL = "/root/testdata/sf0.01"


def test_pairs_in_linear_time():
    rng = np.random.default_rng(0)
    machine = quality.Machine(rank=3)
    machine.factors = rng.normal(size=machine.factors.shape)
    machine.linear = rng.normal(size=machine.linear.shape)
    at, x = rng.choice(500, 12, replace=False), rng.normal(size=12)
    pairs = sum(machine.factors[at[i]] @ machine.factors[at[j]] * x[i] * x[j] for i in range(12) for j in range(i))
    assert math.isclose(machine.margin(at, x), machine.bias + machine.linear[at] @ x + pairs)


def test_quality_held_out(spark):
    folder = "/root/testdata/sf0.1"
    scored = quality.score(table(spark, folder, "documents"), quality_model(spark, folder))
    rows = scored.join(table(spark, folder, "labels").where(fold("doc_id", 3) == 1), "doc_id").select("quality", "score").collect()
    assert sum((r["score"] >= 0.5) == (r["quality"] == 1) for r in rows) >= 0.98 * len(rows)


def test_quality_edge_cases(spark, make_docs, edge_rows):
    docs = make_docs(edge_rows)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    machine = quality.fit(docs, none, fold("doc_id", 3) != 1)
    rows = quality.score(docs, machine).collect()
    assert len(rows) == len(edge_rows) and all(abs(r["score"] - 0.5) < 0.01 for r in rows)
    assert quality.score(docs, machine, n_chars=None).count() == len(edge_rows)
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 0), (None, 1, 1), (2, None, None), (7, 1, 0)], "doc_id long, quality int, toxic int")
    machine = quality.fit(docs, labels, fold("doc_id", 3) != 9)
    scores = {r["doc_id"]: r["score"] for r in quality.score(docs, machine).collect()}
    assert scores[2] == scores[3] and all(0 <= s <= 1 for s in scores.values())
    assert quality.keep_good(docs, machine).columns == docs.columns
    assert quality.score(make_docs([]), machine).count() == quality.keep_good(make_docs([]), machine).count() == 0


def smith_waterman(a, b):
    best, table_ = 0, np.zeros((len(a) + 1, len(b) + 1), dtype=int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table_[i + 1, j + 1] = max(0, table_[i, j] + (1 if x == y else -1), table_[i, j + 1] - 1, table_[i + 1, j] - 1)
            best = max(best, table_[i + 1, j + 1])
    return best


def test_alignment_equals_the_plain_recurrence():
    rng = np.random.default_rng(3)
    for _ in range(400):
        a, b = rng.integers(1, 5, rng.integers(0, 14)), rng.integers(1, 5, rng.integers(0, 9))
        score, s, e = decontaminate.align(a, b)
        assert score == smith_waterman(a, b)
        if score:
            assert smith_waterman(a[s:e], b) == score


WORDS = [f"w{i}" for i in range(300)]


def test_every_mix_of_edits_that_scores_enough_is_found():
    """Replaced, added and left out words at separate places and in one stretch, in items of 1 to 40 words."""
    rng = np.random.default_rng(6)
    items = [(i, " ".join(rng.choice(WORDS, n))) for i, n in enumerate([*range(1, 14), *[20] * 12, *[30] * 4, 40])]
    items += [(100 + i, "what is the best of the " + " ".join(rng.choice(WORDS, 6))) for i in range(20)]
    texts = []
    for _, text in items:
        own, m = text.split(), len(text.split())
        spread = list(own)
        for k in range(min(m - 1, int(0.4 * m)), 0, -1):
            spread.insert(2 * k, "more")
        texts += [spread, own[: m // 2] + ["more"] * int(0.4 * m) + own[m // 2 :]]
        for _ in range(3):
            copy = list(own)
            for _ in range(int(rng.integers(0, int(0.4 * m) + 2))):
                at, kind = int(rng.integers(0, max(1, len(copy)))), rng.integers(0, 4)
                if kind == 0 and copy:
                    copy[at] = "changed"
                elif kind == 1 and copy:
                    del copy[at]
                else:
                    copy.insert(at, "more")
            texts.append(copy)
    blocks = [decontaminate.Block(items), *(decontaminate.Block(items[k::3]) for k in range(3))]
    hits = 0
    for copy in texts:
        text = " ".join([*rng.choice(WORDS, 10), *copy, *rng.choice(WORDS, 10)])
        words = text.split()
        truth = {i: smith_waterman(words, it.split()) / len(it.split()) for i, it in items}
        truth = {i: s for i, s in truth.items() if s >= 0.6}
        hits += len(truth)
        assert {i: s for i, s, _, _ in blocks[0].matches(text)} == truth
        assert {i: s for block in blocks[1:] for i, s, _, _ in block.matches(text)} == truth
    assert hits > 150


def test_copies_are_found_and_clean_texts_left_alone(spark, make_docs):
    rng = np.random.default_rng(4)
    items = [(i, " ".join(rng.choice(WORDS, 30))) for i in range(25)]
    items += [(25, items[0][1]), (26, None), (27, ""), (28, "two words")]
    docs, truth = [], set()
    for d in range(60):
        words = list(rng.choice(WORDS, 80))
        if d % 3:
            item = int(rng.integers(0, 25))
            copy = items[item][1].split()
            for k in rng.choice(30, d % 5, replace=False):
                copy[k] = "changed"
            if d % 2:
                del copy[int(rng.integers(3, 27))]
            words[20:20] = copy
        docs.append((d, " ".join(words).upper() if d % 4 == 0 else ", ".join(words)))
    docs += [(100, None), (101, ""), (None, items[3][1]), (102, "x " * 50_000 + items[4][1]), (102, "x " * 50_000 + items[4][1])]
    for d, t in docs:
        for i, it in items:
            a, b = decontaminate.words(t), decontaminate.words(it)
            if b and len(a) < 1000 and smith_waterman(a, b) / len(b) >= 0.6:
                truth.add((d, i))
    frame = make_docs(docs)
    table_ = spark.createDataFrame(items, "item_id long, text string")
    for extra in ({}, {"block_items": 7}):
        rows = decontaminate.contaminated(frame, table_, **extra).collect()
        assert {(r["doc_id"], r["item_id"]) for r in rows if r["doc_id"] != 102} == truth
        assert sum(r["doc_id"] == 102 and r["item_id"] == 4 for r in rows) == 2
        clean = decontaminate.keep_clean(frame, table_, **extra)
        assert clean.columns == frame.columns
        assert {r["doc_id"] for r in clean.collect()} == {d for d, _ in docs} - {d for d, _ in truth} - {102}
    assert decontaminate.contaminated(frame, table_.limit(0)).count() == 0 and decontaminate.keep_clean(frame, table_.limit(0)).count() == len(docs)
    assert decontaminate.contaminated(make_docs([]), table_).count() == 0


def test_rates_meet_the_targets(spark):
    documents, labels = table(spark, SMALL, "documents"), table(spark, SMALL, "labels")
    mixed = mixing.mix(documents, documents, labels, {"en": 0.25, "de": 0.25, "es": 0.25, "fr": 0.25}).collect()
    assert len(mixed) == documents.count() and all(r["mix_rate"] >= 0 for r in mixed)
    p = np.array([r["mix_posterior"] for r in mixed])
    n, rate = np.array([r["mix_tokens"] for r in mixed]), np.array([r["mix_rate"] for r in mixed])
    assert np.allclose(p.sum(1), 1) and np.allclose((n * rate) @ p / n.sum(), 0.25, atol=0.002)
    assert sum(r["mix_domain"] == r["lang"] for r in mixed) >= 0.95 * len(mixed)
    assert abs(sum(r["mix_copies"] * r["mix_tokens"] for r in mixed) / n.sum() - 1) < 0.1


def test_rates_equal_a_plain_descent(spark):
    """The same steps with whole vectors of rates."""
    rng = np.random.default_rng(6)
    p = rng.dirichlet([0.4] * 3, 200)
    n = rng.integers(0, 500, 200)
    frame = spark.createDataFrame([(i, int(n[i]), p[i].tolist()) for i in range(200)], "i long, n long, p array<double>")
    domains = mixing.Domains(["a", "b", "c"], [0.0] * 3, {})
    rate, have = mixing.fit_rates(frame, domains, {"a": 0.8, "b": 0.1, "c": 0.1}, "n", "p")
    got = np.array([r["r"] for r in frame.select("i", rate.alias("r")).orderBy("i").collect()])
    want = np.array([0.8, 0.1, 0.1]) * n.sum()
    gram = p.T @ (n[:, None] * p)
    scale = 1 / np.diag(gram)
    step = 1 / (np.sqrt(np.outer(scale, scale)) * gram).sum(1).max()
    r = np.ones(200)
    for _ in range(mixing.STEPS):
        gap = (p.T @ (n * r) - want) * scale
        if np.allclose(r, got, atol=1e-9):
            break
        r = np.maximum(0, r - step * (p @ gap))
    assert np.allclose(r, got, atol=1e-9) and (got >= 0).all()
    assert np.allclose(list(have.values()), p.T @ (n * got))


def test_mixing_edge_cases(spark, make_docs, edge_rows):
    docs = make_docs(edge_rows)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = mixing.mix(docs, docs, none).collect()
    assert len(rows) == len(edge_rows) and {r["mix_rate"] for r in rows} == {1.0}
    labels = spark.createDataFrame([(1, 1, 1), (5, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    clashing = docs.withColumn("mix_rate", F.lit("x"))
    out = mixing.mix(clashing, docs, labels, {"en": 1.0})
    assert out.count() == len(edge_rows) and out.columns[: len(docs.columns)] == docs.columns
    assert mixing.mix(make_docs([]), docs, labels).count() == 0
    assert mixing.mix(docs, docs, labels, {"nowhere": 1.0}).count() == len(edge_rows)


def brute_links(rows, cosine=0.93):
    def usable(v):
        return v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)

    unit = [np.array(v, dtype=float) / np.linalg.norm(np.array(v, dtype=float)) if usable(v) and label is not None else None for _, label, v in rows]
    near = [[i != j and unit[i] is not None and unit[j] is not None and rows[i][1] == rows[j][1] and float(unit[i] @ unit[j]) >= cosine for j in range(len(rows))] for i in range(len(rows))]
    low = [r[0] for r in rows]
    for _ in rows:
        low = [min([low[i], *(low[j] for j in range(len(rows)) if near[i][j])]) for i in range(len(rows))]
    return {r[0]: (sum(n), c) for r, n, c in zip(rows, near, low, strict=True)}


@pytest.mark.parametrize("chunk", [4, 2048])
def test_links_equal_brute_force(spark, chunk, monkeypatch):
    monkeypatch.setattr(multi_index.links, "__defaults__", (0.93, chunk))
    rng = np.random.default_rng(9)
    rows, base = [], rng.normal(size=(30, 16))
    for i in range(220):
        v = base[i % 30] + rng.normal(size=16) * (0.02 if i % 2 else 0.25)
        rows.append((i, i % 3, v.astype(np.float32).tolist()))
    rows += [(300 + k, 1, rows[1][2]) for k in range(25)]
    rows += [(400, 1, None), (401, 1, [0.0] * 16), (402, 1, [math.nan] * 16), (403, 1, [None] * 16), (404, None, rows[1][2]), (405, 1, [math.inf] * 16)]
    frame = spark.createDataFrame([(*r, "x", "x", "x") for r in rows], "vec_id long, label int, embedding array<float>, id string, copies string, v string")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in multi_index.near_duplicates(frame, recall=1.0).collect()}
    truth = brute_links(rows)
    same = sum(got[k] == truth[k] for k in truth)
    assert set(got) == set(truth) and same >= 0.97 * len(truth)
    assert all(got[k][0] <= truth[k][0] for k in truth)
    assert all(got[k] == (0, k) for k in range(400, 406))
    assert sum(n for n, _ in got.values()) >= 0.98 * sum(n for n, _ in truth.values())


def test_vector_edge_cases(spark):
    kind = "vec_id long, label int, embedding array<float>"
    assert multi_index.near_duplicates(spark.createDataFrame([], kind)).count() == 0
    rows = [(1, 0, [1.0, 0.0]), (1, 0, [1.0, 0.0]), (None, 0, [1.0, 0.01]), (2, 0, [1.0]), (3, 1, [1.0, 0.0]), (4, 0, [])]
    got = sorted(map(repr, multi_index.near_duplicates(spark.createDataFrame(rows, kind)).collect()))
    assert len(got) == 6
    by = multi_index.near_duplicates(spark.createDataFrame(rows, kind)).where("vec_id = 1").select("n_links", "component_id", "kept").distinct().collect()
    assert [tuple(r) for r in by] == [(2, 1, True)]


def test_traversal_visits_cells_in_order():
    rng = np.random.default_rng(2)
    a, b = rng.random(6), rng.random(5)
    a, b = a - a.min(), b - b.min()
    seen = list(multi_index._traverse(a, b, a.argsort(), b.argsort(), 0.7))
    sums = [a[c // 5] + b[c % 5] for c in seen]
    assert sums == sorted(sums) and len(seen) == len(set(seen)) == int((a[:, None] + b <= 0.7).sum())


def planted_vectors(n, seed=11, width=16):
    """Clusters of many sizes with cosines from 0.93 to 1 around their centres' neighbourhood, under several labels."""
    draw = np.random.default_rng(seed)
    rows = []
    while len(rows) < n:
        centre = draw.normal(size=width)
        centre /= np.linalg.norm(centre)
        label = int(draw.integers(0, 4))
        for _ in range(int(draw.choice([1, 1, 1, 2, 3, 8, 40]))):
            noise = draw.normal(size=width)
            noise -= (noise @ centre) * centre
            noise /= np.linalg.norm(noise)
            turn = np.arccos(draw.uniform(0.955, 1.0))
            rows.append((len(rows), (draw.uniform(0.5, 3) * (np.cos(turn) * centre + np.sin(turn) * noise)).tolist(), label))
    return rows[:n]


def planted_links(rows, cosine=0.93):
    """(links by key, pairs) with every row against every row of its label and length."""
    groups = {}
    for key, v, label in rows:
        groups.setdefault((label, len(v)), []).append((key, v))
    counts = {}
    for members in groups.values():
        x = np.array([v for _, v in members])
        x = x / np.abs(x).max(1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        near = (x @ x.T >= cosine).sum(1) - 1
        counts |= {key: int(c) for (key, _), c in zip(members, near, strict=True)}
    return counts


def test_recall_on_planted_vectors(spark):
    rows = planted_vectors(12_000)
    found = {r["vec_id"]: r["n_links"] for r in multi_index.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    want = planted_links(rows)
    assert sum(want.values()) > 20_000 and all(found[k] <= want[k] for k in want)
    assert sum(found.values()) / sum(want.values()) >= 0.99


def test_vectors_of_two_lengths(spark):
    rows = [(k, v, 1) for k, v, _ in planted_vectors(500, 2, 8)] + [(1000 + k, v, 1) for k, v, _ in planted_vectors(490, 3, 5)] + [(5000, [1.0] * 300, 1), (5001, [2.0], 1), (5002, [3.0], 1)]
    found = {r["vec_id"]: r["n_links"] for r in multi_index.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    want = planted_links(rows)
    assert sum(found.values()) >= 0.99 * sum(want.values()) and all(found[k] <= want[k] for k in want)
    assert found[5001] == found[5002] == 1 and found[5000] == 0


def test_vectors_near_the_ends_of_the_range(spark):
    rows = [(1, [1e200, 2e200, 1e199]), (2, [1.01e200, 2e200, 1e199]), (3, [1e-200, 2e-200, 1e-201]), (4, [-1e-200, 2e-200, 0.0]), (5, [5e-324, 0.0, 0.0]), (6, [1e300, 0.0, 0.0])]
    table = spark.createDataFrame([(k, v, 0) for k, v in rows], "vec_id long, embedding array<double>, label int")
    found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in multi_index.near_duplicates(table).collect()}
    assert found == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (0, 4), 5: (1, 5), 6: (1, 5)}



def test_pipeline_equals_its_stages_by_hand(spark):
    documents = {r["doc_id"]: r for r in table(spark, SMALL, "documents").collect()}
    machine = quality_model(spark, SMALL)
    scorer = quality._Scorer(machine)
    good = [i for i, r in documents.items() if scorer.scores([r["text"]], [r["n_chars"]])[0] >= 0.5]
    prints = {i: simhash.fingerprint(documents[i]["text"] or "") for i in good}
    low = {i: i for i in good}
    values = np.array([prints[i] for i in good], dtype=np.uint64)
    near = np.bitwise_count(values[:, None] ^ values) <= 2
    moved = True
    while moved:
        moved = False
        for k, i in enumerate(good):
            least = min(low[good[j]] for j in np.flatnonzero(near[k]))
            if least < low[i]:
                low[i], moved = least, True
    single = [i for i in good if low[i] == i]
    block = decontaminate.Block([(r["item_id"], r["text"]) for r in table(spark, SMALL, "benchmark").collect()])
    clean = [i for i in single if not block.matches(documents[i]["text"])]
    out = corpus_pipeline.run(spark, SMALL).collect()
    assert {r["doc_id"] for r in out} == set(clean) and len(out) == len(clean)
    assert all(r["text"] == pii.redacted(documents[r["doc_id"]]["text"]) and r["mix_rate"] >= 0 for r in out)
    assert len(corpus_pipeline.STAGES) == 5


def test_pipeline_keeps_the_columns(spark, make_docs, edge_rows):
    docs = make_docs(edge_rows)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns and out.count() <= len(edge_rows)
        assert stage(spark, make_docs([]), SMALL).count() == 0
