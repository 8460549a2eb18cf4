"""Histogram gradient-boosted trees on a bounded training table, flattened into arrays.

Features are cut into quantile bins once; each tree grows level by level from histograms of
gradients, and all trees end up in five arrays that a batch of rows traverses level by level at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """Node ``i`` sends a row left if its ``feature[i]`` is at most ``threshold[i]``; a leaf's children are itself."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def raw(self, x: np.ndarray) -> np.ndarray:
        rows, out = np.arange(len(x)), np.full(len(x), self.base)
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            out += self.value[node]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, *, trees: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.15, l2: float = 1.0, least: float = 5.0) -> Trees:
    """Logistic loss; rows equally weighted.  No rows give 0.5 everywhere, one class the smoothed share of it."""
    n, k = x.shape
    share = (y.sum() + 1) / (n + 2)
    base = float(np.log(share / (1 - share)))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(0) for j in range(k)]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1).astype(np.int64) if n else np.zeros((0, k), np.int64)
    cells = binned + np.arange(k) * bins  # a row's cell in each feature's histogram
    nodes: list[list] = []
    roots, margin = [], np.full(n, base)
    if n and 0 < y.sum() < n:
        for _ in range(trees):
            p = 1 / (1 + np.exp(-margin))
            g, h = p - y, p * (1 - p)
            first = len(nodes)
            roots.append(first)
            nodes.append([0, np.inf, first, first, 0.0])
            where, open_nodes = np.full(n, first), [first]
            for level in range(depth + 1):
                slot = {i: s for s, i in enumerate(open_nodes)}
                of = np.full(len(nodes), -1)
                of[open_nodes] = range(len(open_nodes))
                rows = np.flatnonzero(of[where] >= 0)
                flat = (of[where[rows]][:, None] * (k * bins) + cells[rows]).ravel()
                size = len(open_nodes) * k * bins
                hg = np.bincount(flat, np.repeat(g[rows], k), size).reshape(len(open_nodes), k, bins)
                hh = np.bincount(flat, np.repeat(h[rows], k), size).reshape(len(open_nodes), k, bins)
                hn = np.bincount(flat, None, size).reshape(len(open_nodes), k, bins)
                grown = []
                for i in open_nodes:
                    sg, sh, sn = hg[slot[i]], hh[slot[i]], hn[slot[i]]
                    tg, th, tn = sg[0].sum(), sh[0].sum(), sn[0].sum()
                    nodes[i][4] = -rate * tg / (th + l2)
                    if level == depth:
                        continue
                    lg, lh, ln = sg.cumsum(1)[:, :-1], sh.cumsum(1)[:, :-1], sn.cumsum(1)[:, :-1]
                    gain = lg**2 / (lh + l2) + (tg - lg) ** 2 / (th - lh + l2) - tg**2 / (th + l2)
                    gain[(ln < least) | (tn - ln < least)] = -1
                    j, b = np.unravel_index(int(np.argmax(gain)), gain.shape)
                    if gain[j, b] <= 1e-9 or b >= len(edges[j]):
                        continue
                    nodes[i][:4] = [int(j), float(edges[j][b]), len(nodes), len(nodes) + 1]
                    grown += [len(nodes), len(nodes) + 1]
                    nodes += [[0, np.inf, len(nodes), len(nodes), 0.0], [0, np.inf, len(nodes) + 1, len(nodes) + 1, 0.0]]
                    own = rows[where[rows] == i]
                    where[own] = np.where(binned[own, j] <= b, grown[-2], grown[-1])
                open_nodes = grown
                if not grown:
                    break
            margin += np.array([x[4] for x in nodes])[where]
    cols = list(zip(*nodes, strict=True)) if nodes else [[]] * 5
    kinds = (np.int64, np.float64, np.int64, np.int64, np.float64)
    feature, threshold, left, right, value = (np.array(c, t) for c, t in zip(cols, kinds, strict=True))
    return Trees(np.array(roots, np.int64), feature, threshold, left, right, value, base, depth)
