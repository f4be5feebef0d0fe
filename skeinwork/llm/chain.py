"""Two-state linear-chain conditional random fields over ragged batches of sequences.

States are compared by log odds (state 1 against 0), so one number a position carries each recursion. Positions of all
sequences are laid out time-major, longest sequence first: one step handles the same position of every sequence at once.
A step maps odds x to E (b + d x) / (a + c x), and such maps compose as 2 x 2 matrices. So a long sequence is cut into chunks
for the recursions: the map of each chunk comes first, then the odds at which each chunk begins, then all chunks at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Positions of a chunk, and of the sequences that are laid out together when fitting.
CHUNK, TOGETHER = 256, 1 << 17


class Layout:
    """Maps positions of sequences (row-major, ``lengths`` each) to time-major order and back.

    With ``chunk``, sequences are laid out as chunks of at most so many positions: ``parent`` has the chunk before each (or -1).
    """

    def __init__(self, lengths: np.ndarray, chunk: int | None = None):
        lengths = np.asarray(lengths, np.int64)
        start = np.cumsum(lengths) - lengths
        self.lengths, self.turned = lengths, None
        self.row = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        self.time = (np.arange(len(self.row)) - start[self.row]).astype(np.int32)
        laid = lengths
        self.linked = bool(chunk and len(lengths) and lengths.max() > chunk)
        if self.linked:
            pieces = np.maximum(1, -(-lengths // chunk))
            index = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            laid = np.minimum(chunk, np.repeat(lengths, pieces) - index * chunk)
            self.index = index
        order = np.argsort(-laid, kind="stable")
        rank = np.empty(len(laid), np.int64)
        rank[order] = np.arange(len(laid))
        self.rank = rank
        self.steps = int(laid.max()) if len(laid) else 0
        ended = np.bincount(laid, minlength=self.steps + 1)
        self.active = len(laid) - np.cumsum(ended)[: self.steps]  # sequences longer than t
        self.base = np.concatenate([[0], np.cumsum(self.active)]).astype(np.int64)
        column = np.repeat(np.arange(len(laid)), laid)
        time = np.arange(len(self.row)) - (np.cumsum(laid) - laid)[column]
        self.place = (self.base[time] + rank[column]).astype(np.int32 if len(self.row) < 2**31 else np.int64)

    def lay(self, x: np.ndarray) -> np.ndarray:
        out = np.empty_like(x)
        out[self.place] = x
        return out

    def back(self, x: np.ndarray) -> np.ndarray:
        return x[self.place]

    def reverse(self) -> Layout:
        """The layout of the same sequences read from their ends (row-major arrays reversed as a whole)."""
        if self.turned is None:
            self.turned = Layout(self.lengths[::-1], CHUNK if self.linked else None)
        return self.turned


def layouts(lengths: np.ndarray, most: int = TOGETHER) -> Iterator[tuple[slice, Layout]]:
    """Layouts of runs of sequences with about ``most`` positions together, and where their positions are."""
    ends = np.cumsum(lengths)
    lo = at = 0
    while lo < len(lengths):
        hi = max(lo + 1, int(np.searchsorted(ends, at + most, "right")))
        yield slice(at, int(ends[hi - 1])), Layout(lengths[lo:hi], CHUNK)
        lo, at = hi, int(ends[hi - 1])


def _odds(at: Layout, e: np.ndarray, start: float, trans: np.ndarray) -> np.ndarray:
    """Log odds of each position with all before it: log E at t plus the log of (b + d x) / (a + c x), x the odds before."""
    if not at.steps:
        return e
    (a, b), (c, d) = np.exp(trans)
    x, base = at.lay(np.exp(e)), at.base.tolist()
    if not at.linked:
        x[: base[1]] *= np.exp(start)
    else:  # the first step of a sequence's first chunk doesn't look back: its map is constant
        first = np.empty(len(at.rank), bool)
        first[at.rank] = at.index == 0
        head = np.where(first, 1.0, a), np.where(first, np.exp(start), b), np.where(first, 0.0, c), np.where(first, 0.0, d)
        before = np.empty(len(first))
        before[at.rank] = _chunk_starts(at, x, (a, b, c, d), head)
        x[: base[1]] *= ((head[1] + head[3] * before) / (head[0] + head[2] * before))[: base[1]]
    for t in range(1, at.steps):
        k = base[t + 1] - base[t]
        y = x[base[t - 1] : base[t - 1] + k]
        x[base[t] : base[t + 1]] *= (b + d * y) / (a + c * y)
    return at.back(np.log(x))


def _chunk_starts(at: Layout, laid: np.ndarray, step: tuple, head: tuple) -> np.ndarray:
    """The odds before each chunk: maps of whole chunks, composed along each sequence."""
    a, b, c, d = head
    n, base = len(at.rank), at.base.tolist()
    up, up1, down, down1 = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    for t in range(at.steps):
        k = base[t + 1] - base[t]
        e = laid[base[t] : base[t + 1]]
        if t == 0:
            up[:k], up1[:k], down[:k], down1[:k] = e * d[:k], e * b[:k], c[:k], a[:k]
            a, b, c, d = step
            continue
        p, q, r, s = up[:k], up1[:k], down[:k], down1[:k]
        up[:k], up1[:k], down[:k], down1[:k] = e * (d * p + b * r), e * (d * q + b * s), c * p + a * r, c * q + a * s
        if t % 8 == 0 or t + 1 == at.steps:
            size = up + up1 + down + down1
            size[size == 0] = 1
            for m in (up, up1, down, down1):
                m /= size
    before = np.ones(n)
    by = np.argsort(at.index, kind="stable")
    cuts = np.searchsorted(at.index[by], np.arange(1, int(at.index.max()) + 2))
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        own = by[lo:hi]  # the chunks at one index; the chunk before is the one ahead in order
        x, k = before[own - 1], at.rank[own - 1]
        before[own] = (up[k] * x + up1[k]) / (down[k] * x + down1[k])
    return before


@dataclass
class Chain:
    """start: log odds of state 1 at the first position; trans[i][j]: log potential of i followed by j."""

    start: float
    trans: np.ndarray

    def passes(self, at: Layout, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Forward log odds with the position's own, and backward ones without; row-major in and out."""
        e = np.clip(e, -30, 30).astype(float)
        behind = _odds(at.reverse(), e[::-1], 0.0, self.trans.T)[::-1]
        return _odds(at, e, self.start, self.trans), behind - e

    def marginals(self, at: Layout, e: np.ndarray) -> np.ndarray:
        """Log odds of state 1 at each position, by forward and backward passes; row-major in and out."""
        return np.add(*self.passes(at, e))

    def viterbi(self, at: Layout, e: np.ndarray) -> np.ndarray:
        """The likeliest states."""
        (a, b), (c, d) = self.trans
        m = at.lay(np.asarray(e, float))
        base = at.base.tolist()
        state = np.zeros(len(m), bool)
        if not at.steps:
            return state
        m[: base[1]] += self.start
        for t in range(1, at.steps):
            p = m[base[t - 1] : base[t - 1] + base[t + 1] - base[t]]
            m[base[t] : base[t + 1]] += np.maximum(b, d + p) - np.maximum(a, c + p)
        for t in range(at.steps - 1, -1, -1):
            lo, hi = base[t], base[t + 1]
            k = base[t + 2] - hi if t + 1 < at.steps else 0
            state[lo + k : hi] = m[lo + k : hi] > 0  # sequences that end here
            if k:
                after, p = state[hi : hi + k], m[lo : lo + k]
                state[lo : lo + k] = np.where(after, d + p > b, c + p > a)
        return at.back(state)

    def expectations(self, at: Layout, e: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """For learning: P(state 1) less ``y`` at each position, the same for each kind of transition, and for the start."""
        r, z = self.passes(at, e)
        p = 1 / (1 + np.exp(-np.clip(r + z, -40, 40)))
        first = np.flatnonzero(at.time[1:] > 0)  # positions that have a next one
        nxt = first + 1
        x, w = np.exp(r[first]), np.exp(np.clip(e[nxt], -30, 30) + z[nxt])
        (stay, on), (off, keep) = np.exp(self.trans)
        joint = np.stack([np.full(len(x), stay), on * w, off * x, keep * x * w])
        joint /= joint.sum(0)
        seen = np.bincount((y[first] * 2 + y[nxt]).astype(np.int64), minlength=4)
        heads = at.time == 0
        return p - y, (joint.sum(1) - seen).reshape(2, 2), float((p - y)[heads].sum())


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton steps; the last column of x should be ones."""
    w = np.zeros(x.shape[1])
    weight = np.ones(len(y)) if weight is None else weight
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - y)) + ridge * w
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        size = np.abs(step).max()
        w -= step * min(1, 2 / max(size, 1e-12))
        if size < 1e-8:
            break
    return w


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))
