"""Skip-gram word vectors with a Huffman tree over the words: the steps of one task on whole Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Centre words whose steps are worked out together, from one state of the vectors.
CENTRES = 256
#: Centre words whose tree paths and windows are laid out at once.
LAID_OUT = CENTRES * 1024
#: Longer rows are cut into sentences of so many words, and steps at a node with a larger product than this are left out, as MLlib does.
SENTENCE, MOST_PRODUCT = 1000, 6.0
ROWS_OUT = 50_000


def huffman_tree(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parent and side (1 or -1) of every leaf and inner node; ``counts`` descend, leaves come first, the root is last."""
    n = len(counts)
    weight = counts.tolist() + [0] * (n - 1)
    parent, side = np.zeros(2 * n - 1, np.int32), np.ones(2 * n - 1, np.float32)
    leaf, inner = n - 1, n
    for made in range(n, 2 * n - 1):
        pair = []
        for _ in range(2):
            if leaf >= 0 and (inner >= made or weight[leaf] < weight[inner]):
                pair.append(leaf)
                leaf -= 1
            else:
                pair.append(inner)
                inner += 1
        weight[made] = weight[pair[0]] + weight[pair[1]]
        parent[pair] = made
        side[pair[1]] = -1
    return parent, side


def tree_paths(parent: np.ndarray, side: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inner nodes above each word and the side taken there; shorter paths end in the unused node ``n - 1``."""
    n, root = (len(parent) + 1) // 2, len(parent) - 1
    at, nodes, sides = words, [], []
    while (at != root).any():
        above = np.where(at == root, root, parent[at])
        nodes.append(np.where(at == root, n - 1, above - n))
        sides.append(side[at])
        at = above
    if not nodes:
        return np.zeros((len(words), 0), np.int64), np.zeros((len(words), 0), np.float32)
    return np.ascontiguousarray(np.transpose(nodes), np.int64), np.ascontiguousarray(np.transpose(sides), np.float32)


def first_vectors(ids: np.ndarray, size: int, seed: int) -> np.ndarray:
    """Uniform numbers from -0.5 to 0.5 over ``size``, a hash of seed, word and place."""
    x = ids.astype(np.uint64)[:, None] * np.uint64(size) + np.arange(size, dtype=np.uint64)
    x += np.uint64(seed % (1 << 32)) << np.uint64(32)
    x *= np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    x ^= x >> np.uint64(31)
    return (((x >> np.uint64(40)) / np.float64(1 << 24) - 0.5) / size).astype(np.float32)


class SkipGram:
    """The vectors of one task: ``words`` and, of the tree's inner nodes, ``nodes``; both end in a row that stays zero.

    The steps of a block of centre words are taken from one state of the vectors and added up. Where a vector meets so many
    others in a block that their sum would overshoot (learning rate / 4 x their squared lengths above 1), the sum is
    divided by that number; all other sums are those of single steps.
    """

    def __init__(self, parent: np.ndarray, side: np.ndarray, size: int, window: int, seed: int, stream: list[int], centres: int = CENTRES):
        self.parent, self.side, self.size, self.window, self.centres = parent, side, size, window, centres
        self.n = n = (len(parent) + 1) // 2
        self.words = np.concatenate([first_vectors(np.arange(n), size, seed), np.zeros((1, size), np.float32)])
        self.nodes = np.zeros((n, size), np.float32)
        self.word_met, self.node_met = np.zeros(n + 1, bool), np.zeros(n, bool)
        #: How far each vector has gone towards where its steps lead: learning rate / 4 x the squared lengths it met, all in all.
        self.word_way, self.node_way = np.zeros(n + 1, np.float32), np.zeros(n, np.float32)
        self._word_sum, self._node_sum = np.zeros(n + 1, np.float32), np.zeros(n, np.float32)
        self._random = np.random.default_rng(stream)

    def learn(self, ids: np.ndarray, lengths: np.ndarray, rate) -> None:
        """All steps of sentences of ``lengths`` words that follow each other in ``ids``; ``rate``: words done to learning rate.

        A block holds centre words of one reach, so that no place in it stays empty but at the ends of sentences.
        """
        window, total = self.window, len(ids)
        ends = _sentence_ends(lengths)
        padded = np.concatenate([np.full(window, self.n), ids, np.full(window, self.n)])
        most = self.centres + self.centres // 2
        offsets = [np.delete(np.arange(-r, r + 1), r) for r in range(window + 1)]
        for start in range(0, total, LAID_OUT):
            centre = np.arange(start, min(start + LAID_OUT, total))
            sentence = np.searchsorted(ends, centre, "right")
            reach = self._random.integers(1, window + 1, len(centre))
            low, high = np.where(sentence > 0, ends[sentence - 1], 0), ends[sentence] - 1
            company = high > low
            distinct, place = np.unique(ids[centre], return_inverse=True)
            nodes, sides = tree_paths(self.parent, self.side, distinct)
            depth = (nodes != self.n - 1).sum(1)
            self.word_met[ids[centre[company]]] = True
            self.node_met[nodes[np.unique(place[company])]] = True
            for first in range(0, len(centre), self.centres * window):
                now = rate(start + first)
                for r in range(1, window + 1):
                    alike = first + np.flatnonzero(reach[first : first + self.centres * window] == r)
                    for s in range(0, len(alike), most):
                        block = alike[s : s + most]
                        met = centre[block, None] + offsets[r]
                        inside = ((met >= low[block, None]) & (met <= high[block, None])).astype(np.float32)
                        of = place[block]
                        deep = depth[of].max()
                        self._step(padded.take(met + window), nodes.take(of, 0)[:, :deep], sides.take(of, 0)[:, :deep], inside, now)

    def _step(self, around: np.ndarray, path: np.ndarray, sides: np.ndarray, inside: np.ndarray, rate: float) -> None:
        count, size = len(path), self.size
        if path.size == 0:
            return
        near, nodes = self.words.take(around, 0), self.nodes.take(path, 0)
        # 1 - code - sigmoid(f) is half of side - tanh(f / 2).
        error = np.matmul(nodes, (near * np.float32(0.5)).transpose(0, 2, 1))
        far = max(error.max(), -error.min()) >= MOST_PRODUCT / 2
        kept = np.abs(error) < MOST_PRODUCT / 2 if far else None
        np.tanh(error, out=error)
        np.subtract(sides[:, :, None], error, out=error)
        if far:
            error *= kept
        weight = (inside * np.float32(rate / 2))[:, :, None]
        node_step = np.matmul(error, near * weight)
        word_step = np.matmul(error.transpose(0, 2, 1), nodes)
        word_step *= weight
        flat = nodes.reshape(count, -1)
        word_met = np.einsum("bi,bi->b", flat, flat)[:, None] * inside
        node_met = np.repeat((np.einsum("bkd,bkd->bk", near, near) * inside).sum(1), path.shape[1])
        _add(self.words, self._word_sum, self.word_way, around.ravel(), word_step.reshape(-1, size), word_met.ravel(), rate)
        _add(self.nodes, self._node_sum, self.node_way, path.ravel(), node_step.reshape(-1, size), node_met, rate)
        self.words[self.n] = self.nodes[self.n - 1] = 0


def _sentence_ends(lengths: np.ndarray) -> np.ndarray:
    """Where the sentences end, when those of more than ``SENTENCE`` words are cut."""
    lengths = lengths[lengths > 0]
    pieces = -(-lengths // SENTENCE)
    sizes = np.full(pieces.sum(), SENTENCE)
    sizes[np.cumsum(pieces) - 1] = lengths - (pieces - 1) * SENTENCE
    return np.cumsum(sizes)


def _add(vectors: np.ndarray, sums: np.ndarray, way: np.ndarray, at: np.ndarray, steps: np.ndarray, lengths: np.ndarray, rate: float) -> None:
    """Add each row of ``steps`` to its vector, less where the summed squared ``lengths`` say that they would overshoot."""
    lengths *= np.float32(rate / 4)
    sums[at] = 0
    np.add.at(sums, at, lengths)
    np.add.at(way, at, lengths)
    share = sums.take(at)
    steps /= np.maximum(share, 1)[:, None]
    if vectors.shape[1] % 2 == 0:  # Two numbers are added at once.
        vectors, steps = vectors.view(np.complex64), steps.view(np.complex64)
    size = vectors.shape[1]
    np.add.at(vectors.reshape(-1), ((at * size)[:, None] + np.arange(size)).ravel(), steps.ravel())


def learn_batches(batches: Iterator[pa.RecordBatch], model: SkipGram, rate) -> Iterator[pa.RecordBatch]:
    """Learn from batches of one list column of word ids; give out the changes of all vectors met: (node, id, change, way)."""
    words, nodes, done = model.words.copy(), model.nodes.copy(), 0
    for batch in batches:
        column = batch.column(0)
        ids = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        model.learn(ids, lengths, lambda k, before=done: rate(before + k))
        done += len(ids)
    of_words = (False, model.words - words, model.word_way, model.word_met[: model.n])
    for node, change, way, met in (of_words, (True, model.nodes - nodes, model.node_way, model.node_met[: model.n - 1])):
        rows = np.flatnonzero(met)
        for start in range(0, len(rows), ROWS_OUT):
            part = rows[start : start + ROWS_OUT]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(part), node)), pa.array(part), vector_array(change[part]), pa.array(way[part].astype(np.float64) / model.size)],
                names=["node", "id", "change", "way"],
            )


def vector_array(vectors: np.ndarray) -> pa.Array:
    offsets = np.arange(len(vectors) + 1, dtype=np.int32) * vectors.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(vectors.ravel()))
