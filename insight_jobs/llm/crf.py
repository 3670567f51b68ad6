"""A two-state linear-chain conditional random field in numpy.

A sequence is an array of item numbers; each item has numbered features whose weights sum to the score of state 1 over
state 0. Sequences of like length are worked through side by side, one position at a time, so that the cost in
Python is a position's, not a token's.
"""

from __future__ import annotations

import numpy as np

AREA = 400_000


def blocks(lengths: np.ndarray):
    """Groups of sequences (as index arrays, longest first) whose padded area stays bounded."""
    order = np.argsort(-lengths, kind="stable")
    order = order[lengths[order] > 0]
    start = 0
    while start < len(order):
        longest = int(lengths[order[start]])
        stop = min(len(order), start + max(1, AREA // longest))
        yield order[start:stop]
        start = stop


def padded(values: list[np.ndarray], dtype) -> tuple[np.ndarray, np.ndarray]:
    """Position-major matrix of sequences sorted longest first, and how many are still open at each position."""
    lengths = np.array([len(v) for v in values])
    out = np.zeros((lengths[0], len(values)), dtype)
    for k, v in enumerate(values):
        out[: len(v), k] = v
    return out, np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")


class Chain:
    def __init__(self, features: int):
        self.w = np.zeros(features, np.float64)
        self.start = -2.0
        self.t = np.zeros((2, 2))

    def marginals(self, scores: np.ndarray, active: np.ndarray, pairs: bool = False):
        """Probability of state 1 at each position (forward-backward on odds); with `pairs` also summed pair marginals."""
        e = np.exp(np.clip(scores, -30, 30))
        t = np.exp(self.t)
        steps = len(e)
        fwd, back = np.empty_like(e), np.ones_like(e)
        fwd[0] = e[0] * np.exp(self.start)
        for k in range(1, steps):
            n = active[k]
            o = fwd[k - 1, :n]
            fwd[k, :n] = np.clip(e[k, :n] * (t[0, 1] + o * t[1, 1]) / (t[0, 0] + o * t[1, 0]), 1e-14, 1e14)
        for k in range(steps - 2, -1, -1):
            n = active[k + 1]
            x = e[k + 1, :n] * back[k + 1, :n]
            back[k, :n] = (t[1, 0] + t[1, 1] * x) / (t[0, 0] + t[0, 1] * x)
        odds = fwd * back
        p = odds / (1 + odds)
        if not pairs:
            return p
        expected = np.zeros((2, 2))
        for k in range(1, steps):
            n = active[k]
            o, x = fwd[k - 1, :n], e[k, :n] * back[k, :n]
            m = np.array([[np.full(n, t[0, 0]), t[0, 1] * x], [o * t[1, 0], o * t[1, 1] * x]])
            expected += (m / m.sum((0, 1))).sum(2)
        return p, expected

    def viterbi(self, scores: np.ndarray) -> np.ndarray:
        """The likeliest states of one sequence."""
        (t00, t01), (t10, t11) = self.t.tolist()
        off, on = 0.0, self.start + float(scores[0])
        came = []
        for score in scores[1:].tolist():
            came.append((on + t10 > off + t00, on + t11 > off + t01))
            off, on = max(off + t00, on + t10), max(off + t01, on + t11) + score
        out = np.empty(len(scores), np.int8)
        state = out[-1] = int(on > off)
        for k in range(len(came) - 1, -1, -1):
            state = out[k] = int(came[k][state])
        return out

    def fit(self, features: list[tuple[int, ...]], sequences: list[np.ndarray], states: list[np.ndarray], rounds: int = 60, rate: float = 0.5, decay: float = 1e-4) -> Chain:
        """Adagrad on the whole sample. features: of each item."""
        flat = np.fromiter((f for fs in features for f in fs), np.int64)
        owner = np.repeat(np.arange(len(features)), [len(fs) for fs in features])
        lengths = np.array([len(s) for s in sequences])
        parts = []
        for group in blocks(lengths):
            ids, active = padded([sequences[k] for k in group], np.int64)
            y, _ = padded([states[k] for k in group], np.float64)
            there = np.arange(len(ids))[:, None] < lengths[group][None, :]
            seen = np.zeros((2, 2))
            for i in (0, 1):
                for j in (0, 1):
                    seen[i, j] = ((y[:-1] == i) & (y[1:] == j) & there[1:]).sum()
            parts.append((ids, active, y, there, seen))
        total = max(1, int(lengths.sum()))
        used = np.unique(flat)
        gw, gt, gs = np.full(len(self.w), 1e-8), np.full((2, 2), 1e-8), 1e-8
        for _ in range(rounds):
            item = np.bincount(owner, weights=self.w[flat], minlength=len(features))
            down, dt, ds = np.zeros(len(features)), np.zeros((2, 2)), 0.0
            for ids, active, y, there, seen in parts:
                p, expected = self.marginals(item[ids], active, pairs=True)
                miss = (y - p) * there
                down += np.bincount(ids.ravel(), weights=miss.ravel(), minlength=len(features))
                dt += seen - expected
                ds += float(miss[0].sum())
            dw = np.bincount(flat, weights=down[owner], minlength=len(self.w)) / total - decay / len(used) * self.w
            gw += dw * dw
            self.w += rate * dw / np.sqrt(gw)
            dt[0, 0] = 0.0
            gt += (dt / total) ** 2
            self.t += rate * dt / total / np.sqrt(gt)
            gs += (ds / total) ** 2
            self.start += rate * ds / total / np.sqrt(gs)
        return self
