"""Gradient-boosted trees for a binary label, small enough to train on the driver and to broadcast."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Logistic boosting of histogram trees of fixed depth, with Platt-scaled probabilities."""

    def __init__(self, rounds: int = 80, depth: int = 4, rate: float = 0.2, bins: int = 16, leaf: float = 2.0):
        self.rounds, self.depth, self.rate, self.bins, self.leaf = rounds, depth, rate, bins, leaf
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.scale = (1.0, 0.0)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        code = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], axis=1)
        n, width = x.shape
        self.bias = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        score = np.full(n, self.bias)
        inner = 2**self.depth - 1
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            grad, hess = y - p, p * (1 - p)
            feature, cut, value = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(2**self.depth)
            node = np.zeros(n, np.int64)
            for level in range(self.depth):
                first = 2**level - 1
                k = node * width * self.bins
                total_g, total_h = np.zeros((2**level, width, self.bins)), np.zeros((2**level, width, self.bins))
                for f in range(width):
                    at = k + f * self.bins + code[:, f]
                    total_g += np.bincount(at, grad, total_g.size).reshape(total_g.shape)
                    total_h += np.bincount(at, hess, total_h.size).reshape(total_h.shape)
                lg, lh = total_g.cumsum(2), total_h.cumsum(2)
                g, h = lg[:, :1, -1:], lh[:, :1, -1:]
                gain = lg**2 / (lh + self.leaf) + (g - lg) ** 2 / (h - lh + self.leaf) - g**2 / (h + self.leaf)
                gain[:, :, -1] = 0
                best = gain.reshape(2**level, -1).argmax(1)
                for i, b in enumerate(best):
                    f, c = divmod(int(b), self.bins)
                    feature[first + i] = f
                    if gain[i, f, c] > 1e-6 and c < len(edges[f]):
                        cut[first + i] = edges[f][c]
                go = x[np.arange(n), feature[first + node]] > cut[first + node]
                node = node * 2 + go
            num, den = np.bincount(node, grad, 2**self.depth), np.bincount(node, hess, 2**self.depth)
            value = self.rate * num / (den + self.leaf)
            score += value[node]
            self.trees.append((feature, cut, value))
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                at = 2**level - 1 + node
                node = node * 2 + (x[rows, feature[at]] > cut[at])
            score += value[node]
        return score

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        """Fit slope and offset of the log-odds on rows that took no part in ``fit``."""
        raw, (a, b) = self.raw(x), (1.0, 0.0)
        for _ in range(50):
            p = 1 / (1 + np.exp(-(a * raw + b)))
            w = p * (1 - p) + 1e-6
            design = np.stack([raw, np.ones_like(raw)])
            step = np.linalg.solve((design * w) @ design.T + 1e-3 * np.eye(2), design @ (y - p) - 1e-3 * np.array([a - 1, b]))
            a, b = a + step[0], b + step[1]
        self.scale = (float(a), float(b))
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale[0] * self.raw(x) + self.scale[1], -40, 40)))
