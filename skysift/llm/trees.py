"""Gradient-boosted trees with monotone constraints, trained and scored with numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Forest:
    """All trees in flat node arrays; a leaf points to itself on both sides.

    ``feature[i] <= threshold[i]`` goes to ``left[i]``.  ``roots`` holds each tree's first node, ``depth`` the longest path.
    """

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        rows = np.arange(len(x))[:, None]
        node = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        for _ in range(self.depth):
            goes_left = x[rows, self.feature[node]] <= self.threshold[node]
            node = np.where(goes_left, self.left[node], self.right[node])
        return self.base + self.value[node].sum(axis=1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-self.margin(x)))


def train(
    x: np.ndarray,
    y: np.ndarray,
    monotone: dict[int, int],
    rounds: int = 60,
    depth: int = 3,
    rate: float = 0.2,
    bins: int = 32,
    smoothing: float = 1.0,
    least: float = 5.0,
) -> Forest:
    """Logistic loss, second-order splits on quantile bins.

    ``monotone[f]`` is +1 or -1: the score may only rise or only fall with feature ``f``.  A split whose leaf values are in
    the wrong order is refused, and the mid value bounds both sides below it, so the constraint holds for whole trees.
    """
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)])
    share = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    margin = np.full(len(y), base)
    nodes: list[list] = []
    roots = []

    def leaf_value(g: float, h: float, low: float, high: float) -> float:
        return float(np.clip(-g / (h + smoothing), low, high))

    def gain(g, h):
        return g * g / (h + smoothing)

    def grow(rows: np.ndarray, level: int, low: float, high: float) -> int:
        g_all, h_all = float(grad[rows].sum()), float(hess[rows].sum())
        me = len(nodes)
        nodes.append([0, 0.0, me, me, rate * leaf_value(g_all, h_all, low, high)])
        best = (1e-6, None)
        if level < depth:
            for f, c in enumerate(cuts):
                if not len(c):
                    continue
                b = binned[rows, f]
                g = np.cumsum(np.bincount(b, grad[rows], len(c) + 1))[:-1]
                h = np.cumsum(np.bincount(b, hess[rows], len(c) + 1))[:-1]
                n = np.cumsum(np.bincount(b, minlength=len(c) + 1))[:-1]
                won = gain(g, h) + gain(g_all - g, h_all - h) - gain(g_all, h_all)
                won[(n < least) | (len(rows) - n < least)] = -1
                if f in monotone:
                    a = np.clip(-g / (h + smoothing), low, high)
                    z = np.clip(-(g_all - g) / (h_all - h + smoothing), low, high)
                    won[monotone[f] * (z - a) < 0] = -1
                k = int(won.argmax())
                if won[k] > best[0]:
                    best = (float(won[k]), (f, k, float(g[k]), float(h[k])))
        if best[1]:
            f, k, g, h = best[1]
            a, z = leaf_value(g, h, low, high), leaf_value(g_all - g, h_all - h, low, high)
            mid, way = (a + z) / 2, monotone.get(f, 0)
            inside = binned[rows, f] <= k
            nodes[me][:2] = [f, float(cuts[f][k])]
            nodes[me][2] = grow(rows[inside], level + 1, mid if way < 0 else low, mid if way > 0 else high)
            nodes[me][3] = grow(rows[~inside], level + 1, mid if way > 0 else low, mid if way < 0 else high)
        else:
            margin[rows] += nodes[me][4]
        return me

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, p * (1 - p)
        roots.append(grow(np.arange(len(y)), 0, -np.inf, np.inf))
    flat = list(zip(*nodes, strict=True))
    return Forest(*(np.array(flat[0], np.int32), np.array(flat[1]), np.array(flat[2], np.int32), np.array(flat[3], np.int32), np.array(flat[4])), np.array(roots, np.int32), depth, base)
