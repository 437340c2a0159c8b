"""Regression trees of one series: split search over presorted columns, node arrays, vector walks.

A tree is grown a level at a time. Every column holds the rows of all open nodes, node by node and sorted by value, so
one pass of running sums over the columns scores every split of every node of the level. Gains have the second-order
form G^2 / (H + ridge): with H = rows and ridge = 0 this is the decrease of squared error.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
from pyspark import cloudpickle

# What runs in tasks travels to the workers as code, so they need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_GAIN_FLOOR = 1e-10


@dataclass
class Columns:
    """A series' features (rows x columns) with the ascending row order and the dense ranks of each column."""

    values: np.ndarray
    order: np.ndarray
    ranks: np.ndarray

    @staticmethod
    def of(values: np.ndarray) -> Columns:
        order = np.argsort(values, axis=0, kind="stable").T.copy()
        ordered = np.take_along_axis(values.T, order, axis=1)
        step = np.zeros(order.shape, np.int32)
        step[:, 1:] = np.cumsum(ordered[:, 1:] != ordered[:, :-1], axis=1)
        ranks = np.empty_like(step)
        np.put_along_axis(ranks, order, step, axis=1)
        return Columns(values, order, ranks)

    def first(self, rows: int) -> Columns:
        """The columns of the first rows only: training sets of the folds are prefixes."""
        width = self.order.shape[0]
        return Columns(self.values[:rows], self.order[self.order < rows].reshape(width, rows), self.ranks[:, :rows])


@dataclass
class Trees:
    """Trees as node arrays: a row goes to ``left`` if its value is at most the threshold, else to ``left + 1``.

    A leaf has ``feature`` -1. ``roots`` holds the first node of each tree.
    """

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray

    @staticmethod
    def joined(parts: list[Trees]) -> Trees:
        sizes = np.cumsum([0] + [len(p.feature) for p in parts])
        return Trees(
            np.concatenate([p.roots + at for p, at in zip(parts, sizes, strict=False)]).astype(np.int32),
            np.concatenate([p.feature for p in parts]),
            np.concatenate([p.threshold for p in parts]),
            np.concatenate([p.left + at for p, at in zip(parts, sizes, strict=False)]).astype(np.int32),
            np.concatenate([p.value for p in parts]),
        )

    def each(self, rows: np.ndarray) -> np.ndarray:
        """Values of all trees for all rows (rows x trees), every pair one step down at a time."""
        at = np.repeat(self.roots[None, :], len(rows), axis=0)
        line = np.arange(len(rows))[:, None]
        while True:
            feature = self.feature[at]
            inner = feature >= 0
            if not inner.any():
                return self.value[at]
            right = rows[line, np.maximum(feature, 0)] > self.threshold[at]
            at = np.where(inner, self.left[at] + right, at)

    def total(self, rows: np.ndarray, slice_rows: int = 512) -> np.ndarray:
        """Sum over the trees for each row."""
        parts = [self.each(rows[i : i + slice_rows]).sum(axis=1) for i in range(0, len(rows), slice_rows)]
        return np.concatenate(parts) if parts else np.zeros(0)


def _best_splits(cur, level, starts, sizes, sums, ridge, leaf, columns):
    """Per node: gain over the parent, column and position of its best split.

    Ties go to the first column, then to the smallest value.
    """
    (grad, hess, ranks), (total_g, total_h) = level, sums
    cg = np.cumsum(grad.take(cur), axis=1)
    seen = np.arange(1, cur.shape[1] + 1) - np.repeat(starts, sizes)
    rest = np.repeat(sizes, sizes) - seen
    if hess is None:
        hl, hr = seen.astype(float), rest.astype(float)
    else:
        hl = np.cumsum(hess.take(cur), axis=1)
        hl -= np.repeat(np.cumsum(total_h) - total_h, sizes)
        hr = np.repeat(total_h, sizes) - hl
    cg -= np.repeat(np.cumsum(total_g) - total_g, sizes)
    gain = np.repeat(total_g, sizes) - cg
    value = ranks.take(cur)
    closed = np.ones(cur.shape, bool)
    np.equal(value[:, :-1], value[:, 1:], out=closed[:, :-1])
    closed[:, (seen < leaf) | (rest < leaf)] = True
    if columns is not None:
        closed[~columns] = True
    # After the last row of a node nothing is on the right; those places are closed.
    if ridge:
        hl, hr = hl + ridge, hr + ridge
    gain *= gain
    with np.errstate(divide="ignore", invalid="ignore"):
        gain /= hr
    cg *= cg
    cg /= hl
    gain += cg
    gain[closed] = -np.inf
    best = np.maximum.reduceat(gain, starts, axis=1)
    column = np.argmax(best, axis=0)
    top = best[column, np.arange(len(starts))]
    own = gain.take(np.repeat(column, sizes) * cur.shape[1] + np.arange(cur.shape[1]))
    hit = np.flatnonzero(own == np.repeat(top, sizes))
    node = np.repeat(np.arange(len(starts)), sizes).take(hit)
    first = np.concatenate([[True], node[1:] != node[:-1]])
    return top - total_g * total_g / (total_h + ridge), column, hit[first]


def grow(
    data: Columns, grad: np.ndarray, hess: np.ndarray | None, depth: int, leaf: int = 1, ridge: float = 0.0,
    rows: np.ndarray | None = None, columns: np.ndarray | None = None,
) -> Trees:
    """A tree whose leaves hold G / (H + ridge); without ``hess`` every row weighs 1.

    ``rows`` marks the rows it sees and ``columns`` the features it may use (all by default). Every leaf has at least
    ``leaf`` rows; a node is split while that lowers the loss and ``depth`` allows.
    """
    width, n = data.order.shape
    # Places in the flattened (column, row) tables.
    cur = data.order + (np.arange(width) * n)[:, None]
    if rows is not None:
        cur = cur[rows[data.order]].reshape(width, -1)
    level_data = np.tile(grad, width), None if hess is None else np.tile(hess, width), data.ranks.ravel()
    made: list[tuple[np.ndarray, ...]] = []
    sizes, count = np.array([cur.shape[1]]), 1
    for level in range(depth + 1):
        starts = np.cumsum(sizes) - sizes
        feature = np.full(len(starts), -1, np.int16)
        threshold, left = np.zeros(len(starts)), np.zeros(len(starts), np.int32)
        g = np.add.reduceat(grad.take(cur[0]), starts)
        h = sizes.astype(float) if hess is None else np.add.reduceat(hess.take(cur[0]), starts)
        made.append((feature, threshold, left, g / (h + ridge)))
        open_ = np.flatnonzero(sizes >= 2 * leaf) if level < depth else starts[:0]
        if not len(open_):
            break
        if len(open_) < len(sizes):
            # Nodes too small for two leaves are leaves; their rows go no further.
            cur = cur.take(np.flatnonzero(np.repeat(sizes >= 2 * leaf, sizes)), axis=1)
            sizes = sizes[open_]
            starts = np.cumsum(sizes) - sizes
        g, h = g[open_], h[open_]
        gain, column, at = _best_splits(cur, level_data, starts, sizes, (g, h), ridge, leaf, columns)
        can = np.isfinite(gain) & (gain > _GAIN_FLOOR * (g * g / (h + ridge) + 1.0))
        split = np.flatnonzero(can)
        if not len(split):
            break
        low, high = cur[column[split], at[split]], cur[column[split], at[split] + 1]
        feature[open_[split]] = column[split]
        a, b = data.values[low % n, column[split]], data.values[high % n, column[split]]
        middle = a + (b - a) / 2
        threshold[open_[split]] = np.where(middle < b, middle, a)
        left[open_[split]] = count + 2 * np.arange(len(split))
        count += 2 * len(split)
        # Rows of the split nodes move on, each column sorted by child and, within, by value as before.
        place = np.flatnonzero(np.repeat(can, sizes))
        kept = sizes[split]
        number = np.repeat(np.arange(len(split)), kept)
        chosen = cur.take(np.repeat(column[split], kept) * cur.shape[1] + place) % n
        child = np.zeros(n, np.uint16 if 2 * len(split) <= 1 << 16 else np.int32)
        child[chosen] = 2 * number + (place > np.repeat(at[split], kept))
        cur = cur.take(place, axis=1) if len(place) < cur.shape[1] else cur
        key = np.tile(child, width).take(cur)
        inner = np.argsort(key, axis=1, kind="stable")
        inner += (np.arange(width) * cur.shape[1])[:, None]
        cur = cur.take(inner)
        sizes = np.bincount(key[0], minlength=2 * len(split))
    feature, threshold, left, value = (np.concatenate(c) for c in zip(*made, strict=True))
    return Trees(np.zeros(1, np.int32), feature, threshold, left, value)


def noise(*words: int) -> np.uint64:
    """A 64-bit seed of some numbers."""
    state = np.uint64(0x9E3779B97F4A7C15)
    for word in words:
        state = mixed(state ^ np.uint64(word & 0xFFFFFFFFFFFFFFFF))
    return state


def mixed(state):
    with np.errstate(over="ignore"):
        z = (state + np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def draws(seed: np.uint64, n: int) -> np.ndarray:
    """n 64-bit numbers that follow from the seed."""
    with np.errstate(over="ignore"):
        return mixed(mixed(np.arange(n, dtype=np.uint64) ^ seed) + seed)


def bootstrap(seed: np.uint64, n: int) -> np.ndarray:
    """How often each of n rows is drawn in n draws with replacement."""
    return np.bincount((draws(seed, n) % np.uint64(n)).astype(np.int64), minlength=n)
