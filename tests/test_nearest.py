"""Nearest pairs between components against the full distance matrix."""

import time
import tracemalloc

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from cragline.operators.nearest import nearest_lower


def brute(ids, label, at):
    out = []
    for c in np.unique(label)[1:]:
        pairs = [(((at[i] - at[j]) ** 2).sum(), ids[i], ids[j]) for i in np.flatnonzero(label == c) for j in np.flatnonzero(label < c)]
        out.append((c, *min(pairs)[1:]))
    return out


@settings(max_examples=120, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 90), st.integers(1, 12), st.sampled_from([3, 1000]))
def test_pairs_equal_the_full_matrix(seed, n, labels, grid):
    draw = np.random.default_rng(seed)
    ids, label = draw.permutation(10 * n)[:n], draw.integers(0, labels, n)
    at = draw.integers(0, grid, (n, 2)).astype(float) * [1, draw.choice([0, 1, 50])]  # ties, equal places, a line
    assert [tuple(x) for x in zip(*nearest_lower(ids, label, at))] == brute(ids, label, at)


def test_no_nodes_and_one_label():
    none = np.zeros(0, np.int64)
    assert [len(x) for x in nearest_lower(none, none, np.zeros((0, 2)))] == [0, 0, 0]
    assert [len(x) for x in nearest_lower(np.arange(5), np.full(5, 3), np.zeros((5, 2)))] == [0, 0, 0]


def test_a_large_tile_in_bounded_time_and_memory():
    draw = np.random.default_rng(0)
    centre, label = draw.random((200, 2)) * 1000, draw.integers(0, 200, 20_000)
    at = centre[label] + draw.standard_normal((20_000, 2)) * 15
    tracemalloc.start()
    began = time.perf_counter()
    names, node, other = nearest_lower(np.arange(20_000), label, at)
    took, most = time.perf_counter() - began, tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(names) == 199 and took < 5 and most < 500e6
    for k in (1, 77, 199):
        mine, lesser = np.flatnonzero(label == k), np.flatnonzero(label < k)
        d = ((at[mine][:, None] - at[lesser][None]) ** 2).sum(-1)
        i, j = np.unravel_index(np.argmin(d), d.shape)
        assert (node[k - 1], other[k - 1]) == (mine[i], lesser[j])
