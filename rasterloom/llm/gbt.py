"""Gradient-boosted trees for a binary label, and isotonic calibration, on small dense matrices."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Isotonic:
    """Non-decreasing map from raw score to probability: pooled blocks, shrunk a little towards 1/2; between
    two blocks it rises linearly."""

    knots: np.ndarray
    values: np.ndarray

    @classmethod
    def fit(cls, raw: np.ndarray, label: np.ndarray, prior: float = 0.5) -> "Isotonic":
        order = np.argsort(raw, kind="stable")
        blocks: list[list[float]] = []  # lowest raw, positives, rows, highest raw
        for x, y in zip(raw[order], label[order]):
            if blocks and blocks[-1][3] == x:
                blocks[-1][1] += y
                blocks[-1][2] += 1
            else:
                blocks.append([x, float(y), 1.0, x])
            while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
                _, p, n, top = blocks.pop()
                blocks[-1][1] += p
                blocks[-1][2] += n
                blocks[-1][3] = top
        if not blocks:
            return cls(np.zeros(1), np.full(1, 0.5))
        values = np.maximum.accumulate([(b[1] + prior) / (b[2] + 2 * prior) for b in blocks])
        return cls(np.array([x for b in blocks for x in (b[0], b[3])]), np.repeat(values, 2))

    def __call__(self, raw: np.ndarray) -> np.ndarray:
        return np.interp(raw, self.knots, self.values)


@dataclass
class Boosted:
    """Trees of one depth stored level by level; ``calibrate`` maps their sum to a probability."""

    depth: int
    base: float = 0.0
    feature: list[np.ndarray] = field(default_factory=list)
    cut: list[np.ndarray] = field(default_factory=list)
    leaf: list[np.ndarray] = field(default_factory=list)
    calibrate: Isotonic | None = None

    def raw(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for f, c, v in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, f[node]] > c[node])
            out += v[node - len(f)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        raw = self.raw(x)
        return self.calibrate(raw) if self.calibrate else 1 / (1 + np.exp(-raw))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 48, least: int = 10, ridge: float = 2.0) -> Boosted:
    """Logistic boosting with histograms of quantile bins; deterministic. Leaves hold ``least`` rows, or fewer where
    the rarer label has few."""
    model = Boosted(depth)
    share = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
    model.base = float(np.log(share / (1 - share)))
    if len(np.unique(y)) < 2:
        return model
    n, d = x.shape
    least = max(2, min(least, int(min(y.sum(), n - y.sum())) // 5))
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for k in range(d)]
    code = np.stack([np.searchsorted(c, x[:, k], "left") for k, c in enumerate(cuts)], axis=1)  # x <= cuts[b] iff code <= b
    raw, span, column = np.full(n, model.base), d * bins, np.arange(d) * bins
    flat = (code + column).ravel()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, p * (1 - p)
        node = np.zeros(n, np.int64)
        feature, cut = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf)
        for level in range(depth):
            width, before = 2**level, 2**level - 1
            where = np.repeat((node - before) * span, d) + flat
            sums = [np.bincount(where, np.repeat(v, d), width * span).reshape(width, d, bins).cumsum(axis=2) for v in (g, h, np.ones(n))]
            (gl, hl, nl), (gt, ht, nt) = sums, (s[:, :, -1:] for s in sums)
            gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
            gain[(nl < least) | (nt - nl < least)] = -1
            best = gain.reshape(width, -1).argmax(axis=1)
            for k in range(width):
                f, b = divmod(int(best[k]), bins)
                if gain[k, f, b] > 1e-9 and b < len(cuts[f]):
                    feature[before + k], cut[before + k] = f, cuts[f][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > cut[node])
        at = node - (2**depth - 1)
        leaf = rate * np.bincount(at, g, 2**depth) / (np.bincount(at, h, 2**depth) + ridge)
        raw += leaf[at]
        model.feature.append(feature)
        model.cut.append(cut)
        model.leaf.append(leaf)
    return model


def fit_calibrated(x: np.ndarray, y: np.ndarray, folds: int = 4, seed: int = 5, **options) -> Boosted:
    """Trees on all rows, calibrated on out-of-fold scores."""
    model = fit(x, y, **options)
    if len(np.unique(y)) < 2 or len(y) < 5 * folds:
        return model
    part, raw = np.random.default_rng(seed).integers(0, folds, len(y)), np.zeros(len(y))
    for k in range(folds):
        raw[part == k] = fit(x[part != k], y[part != k], **options).raw(x[part == k])
    model.calibrate = Isotonic.fit(raw, y)
    return model
