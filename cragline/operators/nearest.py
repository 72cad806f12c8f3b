"""Nearest nodes of other components by a pyramid of cells: no distance matrix, memory in proportion to the nodes."""

from __future__ import annotations

import numpy as np

#: Nodes of a lowest cell, about; levels at most.
LEAF, DEEPEST = 4, 16
#: Allowance for rounding where bounds of distances are compared.
LOOSE = 1 + 1e-12


class Pyramid:
    """Nodes in the order of interleaved cell numbers; each level has its occupied cells, their boxes and the least label in each."""

    def __init__(self, at: np.ndarray, label: np.ndarray):
        depth = min(DEEPEST, max(0, int(np.ceil(np.log2(max(len(at), 1) / LEAF) / 2))))
        low, span = at.min(0), max(float(np.ptp(at, axis=0).max()), 1e-300)
        cell = np.minimum((at - low) / span * 2**depth, 2**depth - 1).astype(np.int64)
        code = np.zeros(len(at), np.int64)
        for bit in range(depth):
            code |= (cell[:, 0] >> bit & 1) << (2 * bit + 1) | (cell[:, 1] >> bit & 1) << (2 * bit)
        self.order = np.argsort(code, kind="stable")
        code, at, label = code[self.order], at[self.order], label[self.order]
        self.levels = []
        for k in range(depth + 1):
            cells, first = np.unique(code >> 2 * (depth - k), return_index=True)
            self.levels.append((cells, first, np.minimum.reduceat(label, first), np.minimum.reduceat(at, first), np.maximum.reduceat(at, first)))
        self.at, self.label = at, label

    def children(self, level: int, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last child (one beyond) of cells, as places in the next level."""
        codes, below = self.levels[level][0][cell], self.levels[level + 1][0]
        return np.searchsorted(below, codes << 2), np.searchsorted(below, (codes + 1) << 2)

    def nodes(self, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first = np.r_[self.levels[-1][1], len(self.at)]
        return first[cell], first[cell + 1]


def _spread(query: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each query with every number from its low to below its high."""
    many = high - low
    return np.repeat(query, many), np.arange(many.sum()) + np.repeat(low - np.r_[0, np.cumsum(many)[:-1]], many)


def nearest_lower(ids: np.ndarray, label: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(label, node, other) for each label but the least: the nearest pair of a node with that label and one with a lesser label.

    Among equally near pairs that of the least id counts, then of the least other id. All labels are searched at once, level by level: a pair of a node and a cell
    stays while the cell holds a lesser label and its box is no farther than the farthest corner of a box already known to hold one, for any node of the label.
    """
    order = np.argsort(ids, kind="stable")
    ids, label, at = ids[order], label[order], at[order].astype(np.float64)
    if not len(ids):
        return (np.zeros(0, label.dtype), np.zeros(0, ids.dtype), np.zeros(0, ids.dtype))
    names, of = np.unique(label, return_inverse=True)
    pyramid = Pyramid(at, of)
    query = np.flatnonzero(of > 0)
    cell, reach = np.zeros(len(query), np.int64), np.full(len(names), np.inf)
    for k, (_, _, least, low, high) in enumerate(pyramid.levels):
        if k:
            query, cell = _spread(query, *pyramid.children(k - 1, cell))
        keep = least[cell] < of[query]
        query, cell = query[keep], cell[keep]
        here = at[query]
        far = (np.maximum(np.abs(here - low[cell]), np.abs(high[cell] - here)) ** 2).sum(1)
        np.minimum.at(reach, of[query], far)
        near = (np.maximum(np.maximum(low[cell] - here, here - high[cell]), 0) ** 2).sum(1)
        keep = near <= reach[of[query]] * LOOSE
        query, cell = query[keep], cell[keep]
    query, node = _spread(query, *pyramid.nodes(cell))
    keep = pyramid.label[node] < of[query]
    query, node = query[keep], node[keep]
    apart = ((at[query] - pyramid.at[node]) ** 2).sum(1)
    other = pyramid.order[node]
    best = np.lexsort((other, query, apart, of[query]))
    first = best[np.r_[True, of[query][best][1:] != of[query][best][:-1]]] if len(best) else best
    return names[of[query[first]]], ids[query[first]], ids[other[first]]
