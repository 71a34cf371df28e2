"""Linear-chain conditional random fields over hashed token features, as arrays.

The score of a state at a token is the sum of the weights of the token's own features, of its neighbours' features (with
weights of their own) and of the features of its file. Training maximises the regularised likelihood of labelled
windows; forward-backward and Viterbi work on many sequences at once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import chain as chain_of
from zlib import crc32

import numpy as np

OFFSETS = 3  # the token itself, the token before, the token behind


@dataclass
class Chain:
    weights: np.ndarray  # offsets x hashed features x states
    context: np.ndarray  # file features x states
    moves: np.ndarray  # state x next state
    start: np.ndarray

    @property
    def states(self) -> int:
        return len(self.start)


def hashed(features: list[str], size: int) -> list[int]:
    return [crc32(f.encode("utf-8", "surrogatepass")) % size for f in features]


class TokenScores(dict):
    """token -> row of a growing table with its weights at the three offsets; emptied when it holds ``most`` tokens.

    Plain words outside ``known``, if that is given, share the row that ``form`` names: no training window held them, so
    nothing was learned about the word itself.
    """

    def __init__(self, chain: Chain, features: Callable[[str], list[str]], form: Callable[[str], str | None] | None = None, known: frozenset[str] = frozenset(), most: int = 200_000):
        super().__init__()
        self.chain, self.features, self.form, self.known, self.most = chain, features, form, known, most
        self.size = chain.weights.shape[1]
        self.table = np.zeros((OFFSETS, 1024, chain.states))
        self.rows = 0

    def clear(self) -> None:
        super().clear()
        self.rows = 0

    def __missing__(self, token: str) -> int:
        form = self.form(token) if self.form and token not in self.known else None
        if form is not None and form != token:
            self[token] = row = self[form]
            return row
        row, self.rows = self.rows, self.rows + 1
        if row == self.table.shape[1]:
            self.table = np.concatenate([self.table, np.zeros_like(self.table)], axis=1)
        self.table[:, row] = self.chain.weights[:, hashed(self.features(token), self.size)].sum(1)
        self[token] = row
        return row

    def emissions(self, sequences: list[list[str]], context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores (tokens x states) of all sequences one behind the other, and their lengths."""
        if len(self) > self.most:
            self.clear()
        lengths = np.array([len(s) for s in sequences], dtype=np.int64)
        rows = np.fromiter(map(self.__getitem__, chain_of.from_iterable(sequences)), dtype=np.int64, count=int(lengths.sum()))
        scores = self.table[0].take(rows, axis=0)
        if len(rows):
            inner = np.ones(len(rows) - 1, dtype=bool)
            begins = (np.cumsum(lengths) - lengths)[lengths > 0]
            inner[begins[1:] - 1] = False
            scores[1:] += self.table[1].take(rows[:-1], axis=0) * inner[:, None]
            scores[:-1] += self.table[2].take(rows[1:], axis=0) * inner[:, None]
            scores += np.repeat(context @ self.chain.context, lengths, axis=0)
        return scores, lengths


def marginals(chain: Chain, scores: np.ndarray, lengths: np.ndarray, block: int = 128) -> np.ndarray:
    """State probabilities (tokens x states) by forward-backward.

    All sequences are laid end to end and cut into blocks of equal length. Inside the blocks, messages are computed for
    every state the block may be entered with, all blocks at once; a short loop over the blocks then joins them. The
    work does not depend on how long a single sequence is, and the result is exact.
    """
    n, k = scores.shape
    if n == 0:
        return np.zeros((0, k))
    likely = np.exp(scores - scores.max(1, keepdims=True))
    step = np.exp(chain.moves - chain.moves.max())
    begin = np.exp(chain.start - chain.start.max())
    firsts = np.zeros(n, dtype=bool)
    firsts[(np.cumsum(lengths) - lengths)[lengths > 0]] = True
    blocks = -(-n // block)
    pad = blocks * block - n
    likely_b = np.concatenate([likely, np.ones((pad, k))]).reshape(blocks, block, k)
    first_b = np.concatenate([firsts, np.ones(pad, dtype=bool)]).reshape(blocks, block)
    # move[b, t]: from the state before position t to the state at t; a first token doesn't look back.
    restart = np.broadcast_to(begin, (k, k))

    def move(t: int) -> np.ndarray:
        return np.where(first_b[:, t, None, None], restart, step)

    # alpha[b, t, i, s]: weight of state s at t if the block was entered from state i.
    alpha = np.empty((blocks, block, k, k))
    now = np.broadcast_to(np.eye(k), (blocks, k, k))
    for t in range(block):
        now = (now @ move(t)) * likely_b[:, t, None, :]
        now = now / now.max((1, 2), keepdims=True)
        alpha[:, t] = now
    entered = np.empty((blocks, k))
    state = np.ones(k) / k
    for b in range(blocks):
        entered[b] = state
        state = state @ alpha[b, -1]
        state = state / state.sum()
    # beta[b, t, s, j]: weight of what follows t inside the block if it is left with message j.
    beta = np.empty((blocks, block, k, k))
    now = np.broadcast_to(np.eye(k), (blocks, k, k))
    beta[:, -1] = now
    for t in range(block - 1, 0, -1):
        now = (move(t) * likely_b[:, t, None, :]) @ now
        now = now / now.max((1, 2), keepdims=True)
        beta[:, t - 1] = now
    whole = (move(0) * likely_b[:, 0, None, :]) @ beta[:, 0]
    left = np.empty((blocks, k))
    state = np.ones(k)
    for b in range(blocks - 1, -1, -1):
        left[b] = state
        state = whole[b] @ state
        state = state / state.sum()
    ahead = np.einsum("btis,bi->bts", alpha, entered)
    behind = np.einsum("btsj,bj->bts", beta, left)
    both = (ahead * behind).reshape(-1, k)[:n]
    return both / both.sum(1, keepdims=True)


def viterbi(chain: Chain, scores: np.ndarray, lengths: np.ndarray, idle: int = 0) -> np.ndarray:
    """The best state of every token.

    Where ``idle`` leads every other state by more than the moves around a token can make up for, the best path passes
    through it. Sequences are cut at such tokens and only the stretches between them are searched; the result is exact.
    """
    n, k = scores.shape
    path = np.full(n, idle, dtype=np.int64)
    if n == 0 or k == 1:
        return path
    into = np.vstack([chain.moves, chain.start])
    lead = max((into[:, s] - into[:, idle]).max() + max(0.0, (chain.moves[s] - chain.moves[idle]).max()) for s in range(k) if s != idle)
    at = np.flatnonzero(scores[:, idle] - np.delete(scores, idle, axis=1).max(1) <= max(0.0, lead))
    if not len(at):
        return path
    sequence = np.repeat(np.arange(len(lengths)), lengths)
    firsts, lasts = np.ones(n, dtype=bool), np.ones(n, dtype=bool)
    firsts[1:] = lasts[:-1] = sequence[1:] != sequence[:-1]
    begins = np.ones(len(at), dtype=bool)
    begins[1:] = (np.diff(at) > 1) | firsts[at[1:]]
    ends = np.append(begins[1:], True)
    own = scores[at] + np.where(begins[:, None], np.where(firsts[at][:, None], chain.start, chain.moves[idle]), 0.0)
    own += np.where((ends & ~lasts[at])[:, None], chain.moves[:, idle], 0.0)
    stretches = np.diff(np.append(np.flatnonzero(begins), len(at)))
    path[at] = _best_paths(Chain(chain.weights, chain.context, chain.moves, np.zeros(k)), own, stretches)
    return path


def _best_paths(chain: Chain, scores: np.ndarray, lengths: np.ndarray, block: int = 64) -> np.ndarray:
    """The best states of whole sequences.

    Blocks as for the marginals: the best way through each block from every state it may be entered with, all blocks
    at once; a loop over the blocks for the scores at their borders; then every block is traced back from each state it may
    be left with, and a last loop picks the one that fits. Ties go to the lower state.
    """
    n, k = scores.shape
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    firsts = np.zeros(n, dtype=bool)
    firsts[(np.cumsum(lengths) - lengths)[lengths > 0]] = True
    blocks = -(-n // block)
    pad = blocks * block - n
    score_b = np.concatenate([scores, np.zeros((pad, k))]).reshape(blocks, block, k)
    first_b = np.concatenate([firsts, np.ones(pad, dtype=bool)]).reshape(blocks, block)
    restart = np.broadcast_to(chain.start, (k, k))
    blocked = np.where(np.eye(k, dtype=bool), 0.0, -1e18)

    def move(t: int) -> np.ndarray:
        return np.where(first_b[:, t, None, None], restart, chain.moves)

    through = np.broadcast_to(blocked, (blocks, k, k))
    for t in range(block):
        through = (through[:, :, :, None] + move(t)[:, None]).max(2) + score_b[:, t, None, :]
    entered = np.empty((blocks, k))
    state = np.zeros(k)
    for b in range(blocks):
        entered[b] = state
        state = (state[:, None] + through[b]).max(0)
        state = state - state.max()
    back = np.empty((blocks, block, k), dtype=np.int8)
    now = entered
    for t in range(block):
        ways = now[:, :, None] + move(t)
        back[:, t] = ways.argmax(1)
        now = ways.max(1) + score_b[:, t]
    # path[b, t, j]: the state at t if the block is left with state j.
    path = np.empty((blocks, block, k), dtype=np.int8)
    at = np.broadcast_to(np.arange(k), (blocks, k))
    for t in range(block - 1, -1, -1):
        path[:, t] = at
        at = np.take_along_axis(back[:, t], at, axis=1).astype(np.int64)
    leave = np.empty(blocks, dtype=np.int64)
    state_at = int(now[-1].argmax())
    for b in range(blocks - 1, -1, -1):
        leave[b] = state_at
        state_at = int(at[b, state_at])
    return np.take_along_axis(path, leave[:, None, None], axis=2)[:, :, 0].reshape(-1)[:n].astype(np.int64)


def train(
    windows: list[tuple[list[list[int]], np.ndarray, list[int]]],
    states: int,
    size: int,
    context_size: int,
    epochs: int = 8,
    rate: float = 0.3,
    decay: float = 1e-4,
    batch: int = 128,
    forbidden: list[tuple[int, int]] | None = None,
    seed: int = 7,
) -> Chain:
    """Fit by AdaGrad on windows (features of each token, file features, states)."""
    chain = Chain(np.zeros((OFFSETS, size, states)), np.zeros((context_size, states)), np.zeros((states, states)), np.zeros(states))
    for i, j in forbidden or []:
        chain.moves[i, j] = -8.0
    fixed = chain.moves < 0
    if not windows:
        return chain
    sums = [np.full_like(p, 1e-6) for p in (chain.weights, chain.context, chain.moves, chain.start)]
    rng = np.random.default_rng(seed)
    placed = [_placed(w[0]) for w in windows]
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), batch):
            chosen = order[at : at + batch]
            part = [windows[i] for i in chosen]
            lengths = np.array([len(w[0]) for w in part])
            base = np.cumsum(lengths) - lengths
            token = np.concatenate([placed[i][0] + b for i, b in zip(chosen, base, strict=True)])
            offset = np.concatenate([placed[i][1] for i in chosen])
            feature = np.concatenate([placed[i][2] for i in chosen])
            context = np.array([w[1] for w in part], dtype=float).reshape(len(part), context_size)
            truth = np.concatenate([w[2] for w in part]).astype(int)
            total = int(lengths.sum())
            scores = np.zeros((total, states))
            np.add.at(scores, token, chain.weights[offset, feature])
            scores += np.repeat(context @ chain.context, lengths, axis=0)
            prob, pairs, begins = _expected(chain, scores, lengths)
            gap = np.eye(states)[truth] - prob
            sequence = np.repeat(np.arange(len(part)), lengths)
            inner = np.flatnonzero(sequence[1:] == sequence[:-1])
            seen = np.zeros((states, states))
            np.add.at(seen, (truth[inner], truth[inner + 1]), 1)
            first = np.cumsum(lengths) - lengths
            grad_w = np.zeros_like(chain.weights)
            np.add.at(grad_w, (offset, feature), gap[token])
            by_file = np.add.reduceat(gap, first, axis=0)
            grads = [grad_w, context.T @ by_file, np.where(fixed, 0, seen - pairs), np.eye(states)[truth[first]].sum(0) - begins]
            for p, g, s in zip((chain.weights, chain.context, chain.moves, chain.start), grads, sums, strict=True):
                g = g / len(part) - decay * p * (g != 0)
                s += g * g
                p += rate * g / np.sqrt(s)
    return chain


def _placed(features: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token, offset, feature) of all features that a token of the window sees."""
    token, offset, feature = [], [], []
    for t, own in enumerate(features):
        for o, u in ((0, t), (1, t + 1), (2, t - 1)):
            if 0 <= u < len(features):
                token += [u] * len(own)
                offset += [o] * len(own)
                feature += own
    return np.array(token, dtype=np.int64), np.array(offset, dtype=np.int64), np.array(feature, dtype=np.int64)


def _expected(chain: Chain, scores: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token marginals, expected moves summed over all sequences, and expected first states, for short windows."""
    k, longest, many = chain.states, int(lengths.max()), len(lengths)
    first = np.cumsum(lengths) - lengths
    at = first[:, None] + np.minimum(np.arange(longest), lengths[:, None] - 1)
    inside = np.arange(longest) < lengths[:, None]
    likely = np.exp(scores - scores.max(1, keepdims=True))[at]
    step, begin = np.exp(chain.moves), np.exp(chain.start)
    alpha, beta = np.zeros((many, longest, k)), np.ones((many, longest, k))
    alpha[:, 0] = begin * likely[:, 0]
    alpha[:, 0] /= alpha[:, 0].sum(1, keepdims=True)
    for t in range(1, longest):
        now = (alpha[:, t - 1] @ step) * likely[:, t]
        alpha[:, t] = now / now.sum(1, keepdims=True)
    for t in range(longest - 2, -1, -1):
        now = (beta[:, t + 1] * likely[:, t + 1]) @ step.T
        now /= now.sum(1, keepdims=True)
        beta[:, t] = np.where(inside[:, t + 1, None], now, 1.0)
    both = alpha * beta
    both /= both.sum(2, keepdims=True)
    joint = alpha[:, :-1, :, None] * step * (likely * beta)[:, 1:, None, :]
    joint /= joint.sum((2, 3), keepdims=True)
    pairs = (joint * inside[:, 1:, None, None]).sum((0, 1))
    return both[inside], pairs, both[:, 0].sum(0)
