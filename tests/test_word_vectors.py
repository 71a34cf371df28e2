"""Word vectors: single steps against plain loops, blocks, copies put together, lookups of large vocabularies."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from gridloom.operators import text_models as TM
from gridloom.operators import vocabulary as V
from gridloom.operators import word_vectors as W


def plain(ids, ends, counts, size, window, reach, rate):
    """word2vec's skip-gram steps one after another."""
    n, (parent, side) = len(counts), W.huffman_tree(np.array(counts))
    words, nodes = W.first_vectors(np.arange(n), size, 1).astype(float), np.zeros((n, size))
    # Blocks of one centre word: of each three, those of the least reach come first.
    for i in sorted(range(len(ids)), key=lambda i: (i // window, reach[i])):
        word = ids[i]
        sentence = np.searchsorted(ends, i, "right")
        low, high = ends[sentence - 1] if sentence else 0, ends[sentence]
        start = words.copy(), nodes.copy()
        for j in range(max(low, i - reach[i]), min(high, i + reach[i] + 1)):
            if j == i:
                continue
            at, moved = word, np.zeros(size)
            while at != 2 * n - 2:
                node, code = parent[at] - n, (1 - side[at]) / 2
                g = (1 - code - 1 / (1 + np.exp(-start[0][ids[j]] @ start[1][node]))) * rate
                moved += g * start[1][node]
                nodes[node] += g * start[0][ids[j]]
                at = parent[at]
            words[ids[j]] += moved
    return words, nodes


def test_steps_are_those_of_plain_loops():
    rng = np.random.default_rng(3)
    counts, lengths = [40, 30, 9, 5, 5, 2], np.array([7, 0, 1, 12])
    ids = rng.integers(0, 6, 20)
    model = W.SkipGram(*W.huffman_tree(np.array(counts)), 4, 3, 1, [8], centres=1)
    model.learn(ids, lengths, lambda done: 0.025)
    reach = np.random.default_rng([8]).integers(1, 4, 20)
    words, nodes = plain(ids, np.array([7, 8, 20]), counts, 4, 3, reach, 0.025)
    assert np.allclose(model.words[:6], words, atol=1e-6) and np.allclose(model.nodes[:5], nodes[:5], atol=1e-6)
    assert not model.word_met[ids[7]] or ids[7] in np.delete(ids, 7)


def test_tree_is_of_least_cost_and_sides_tell_words_apart():
    counts = np.array([8, 4, 2, 1, 1])
    nodes, sides = W.tree_paths(*W.huffman_tree(counts), np.arange(5))
    depth = (nodes != 4).sum(1)
    assert (depth * counts).sum() == 8 + 8 + 6 + 4 + 4
    assert len({tuple(zip(n[:d], s[:d], strict=True)) for n, s, d in zip(nodes.tolist(), sides.tolist(), depth, strict=True)}) == 5
    assert W.tree_paths(*W.huffman_tree(np.array([3])), np.arange(1))[0].shape == (1, 0)


def test_long_rows_are_cut_into_sentences():
    assert W._sentence_ends(np.array([2500, 0, 3, 1000])).tolist() == [1000, 2000, 2500, 2503, 3503]


def test_blocks_of_one_word_do_not_overshoot():
    ids = np.where(np.arange(60_000) % 3 < 2, 0, np.arange(60_000) % 50)
    model = W.SkipGram(*W.huffman_tree(np.sort(np.bincount(ids))[::-1]), 8, 5, 1, [2])
    model.learn(ids, np.full(60, 1000), lambda done: 0.025)
    assert np.isfinite(model.words).all() and np.linalg.norm(model.words, axis=1).max() < 20


@pytest.fixture(scope="module")
def topics(spark):
    rng = np.random.default_rng(0)
    rows = [([f"{'ab'[i % 2]}{k}" for k in rng.integers(0, 10, 30)] + [None],) for i in range(1200)]
    return spark.createDataFrame([*rows, (None,), ([],), (["alone"],)], "tokens array<string>").repartition(6).cache()


def fitted(df, **options):
    rows = TM.fit_word_vectors(df, "tokens", size=8, window=3, min_count=1, **options).getVectors()
    return {r["word"]: np.array(r["v"]) for r in rows.select("word", vector_to_array("vector").alias("v")).collect()}


def test_several_tasks_learn_which_words_go_together_and_always_the_same(topics):
    one, two = (fitted(topics, partitions=4, epochs=2) for _ in range(2))
    assert len(one) == 21 and all(np.allclose(one[w], two[w], atol=1e-6) for w in one)
    rows = {w: v / np.linalg.norm(v) for w, v in one.items() if w != "alone"}
    cosines = {(a, b): rows[a] @ rows[b] for a in rows for b in rows if a < b}
    near, far = ([c for (a, b), c in cosines.items() if (a[0] == b[0]) == same] for same in (True, False))
    assert min(near) > max(far)


def test_words_that_stand_alone_keep_their_first_vector(topics):
    vectors = fitted(topics, partitions=2)
    order = [r["token"] for r in V.token_counts(topics, "tokens").where("token IS NOT NULL").orderBy(F.desc("freq"), "token").collect()]
    assert np.allclose(vectors["alone"], W.first_vectors(np.array([order.index("alone")]), 8, 1)[0])


def test_no_frequent_word(topics):
    with pytest.raises(ValueError, match="empty"):
        TM.fit_word_vectors(topics, "tokens", min_count=10**6)


def test_known_ids_by_lookup_and_by_join(spark):
    df = spark.createDataFrame([(["x", "z", None, "y", "x"],), (["y"],), (["x"],), (["x"],)], "tokens array<string>")
    vocabulary = spark.createDataFrame([("x", 0), ("y", 1)], "token string, id long")
    for most in (None, 1):
        assert sorted(r["ids"] for r in V.known_ids(df, "tokens", vocabulary, max_rows=most).collect()) == [[0], [0], [0, 1, 0], [1]]
