import itertools
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidegrid.functions import kernels as k


def brute_loops(d):
    n = len(d)
    edges = sorted((d[a, b], a, b) for a, b in itertools.combinations(range(n), 2))
    at = {(a, b): i for i, (_, a, b) in enumerate(edges)}
    low, bars = {}, []
    for r, a, b, c in sorted((max(at[a, b], at[a, c], at[b, c]), a, b, c) for a, b, c in itertools.combinations(range(n), 3)):
        column = (1 << at[a, b]) ^ (1 << at[a, c]) ^ (1 << at[b, c])
        while column and (p := column.bit_length() - 1) in low:
            column ^= low[p]
        if column:
            low[column.bit_length() - 1] = column
            if edges[r][0] > edges[column.bit_length() - 1][0]:
                bars.append((edges[column.bit_length() - 1][0], edges[r][0]))
    return np.array(sorted(bars)).reshape(-1, 2)


@settings(max_examples=25, deadline=None)
@given(st.integers(3, 14), st.integers(0, 10_000))
def test_loops_equal_full_reduction(n, seed):
    d = k.distance(k.weighted_correlation(np.random.default_rng(seed).normal(size=(60, n))))
    h0, h1 = k.rips_diagrams(d)
    assert np.allclose(h1, brute_loops(d)) and len(h0) == n - 1


def test_square_and_ties():
    p = np.array([[0, 0], [1, 0], [1, 1], [0, 1.0]])
    assert np.allclose(k.rips_diagrams(np.sqrt(((p[:, None] - p[None]) ** 2).sum(2)))[1], [[1, math.sqrt(2)]])
    assert k.rips_diagrams(np.ones((5, 5)) - np.eye(5))[1].size == 0
    with pytest.raises(ValueError):
        k.rips_diagrams(np.zeros((5, 5)), most=4)


def test_known_values():
    grid = np.array([0, 0.5, 1, 1.5, 2])
    assert k.landscape(np.array([[0, 2.0]]), grid).tolist() == [0, 0.5, 1, 0.5, 0]
    assert not k.landscape(np.zeros((0, 2)), grid).any()
    assert k.network_summary(np.eye(3)) == (0, 0) and np.allclose(k.network_summary(np.ones((3, 3))), (1, 1.5))
    none = np.zeros((0, 2))
    assert k.wasserstein(none, none) == 0 and math.isclose(k.wasserstein(np.array([[0, 2.0]]), none), math.sqrt(2))


def test_correlation_properties():
    a = np.array([[1, 2, 3], [2, 3, 1], [4, 1, 2], [3, 5, 6.0]])
    rho = k.weighted_correlation(a)
    assert np.allclose(rho, rho.T) and np.allclose(np.diag(rho), 1) and np.linalg.eigvalsh(rho)[0] >= 0.1 - 1e-12
    assert np.allclose(rho, k.weighted_correlation(a + 100))
    d = k.distance(rho)
    assert all(d[i, j] <= d[i, m] + d[m, j] + 1e-9 for i, j, m in itertools.permutations(range(3)))
    for bad in (np.nan, np.inf):
        with pytest.raises(ValueError):
            k.weighted_correlation(np.where(a == 6, bad, a))
    with pytest.raises(ValueError):
        k.weighted_correlation(np.ones((5, 3)))


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 6), st.integers(0, 1000))
def test_assignment(n, seed):
    c = np.random.default_rng(seed).random((n, n))
    assert math.isclose(k.assignment_cost(c), min(sum(c[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n))))


def test_delay_embedding_is_affine_invariant():
    x = np.random.default_rng(0).normal(size=60)
    assert np.allclose(k.delay_summary(x), k.delay_summary(3 * x + 2), rtol=1e-5)
    assert k.delay_summary(np.full(60, 2.0)) is None and k.delay_summary(np.r_[x[:-1], np.nan]) is None


def test_image_mass_and_cdf():
    assert math.isclose(k.persistence_image(np.array([[0.5, 1.5]])).sum(), 1.0, rel_tol=1e-6)
    assert k.normal_cdf(np.array([0.0]))[0] == 0.5


def test_kendall():
    x = np.array([[1, 2, 3, 4.0], [4, 3, 2, 1], [1, 1, 2, 2], [1, 1, 1, 1]])
    got = k.kendall_tau_b(x)
    assert got[0] == 1 and got[1] == -1 and math.isclose(got[2], 4 / math.sqrt(6 * 4)) and np.isnan(got[3])


def test_logistic_optimum():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 3))
    y = (rng.random(300) < 1 / (1 + np.exp(-(x[:, 0] - 0.5)))).astype(float)
    w = k.logistic(x, y, 0.5)
    p = 1 / (1 + np.exp(-(w[0] + x @ w[1:])))
    assert np.allclose(0.5 * x.T @ (p - y) + w[1:], 0, atol=1e-6) and abs((p - y).sum()) < 1e-6
    sparse = k.logistic(x, y, 0.02, "l1")
    p = 1 / (1 + np.exp(-(sparse[0] + x @ sparse[1:])))
    g = 0.02 * x.T @ (p - y)
    assert (np.abs(g[sparse[1:] == 0]) <= 1 + 1e-4).all() and np.allclose(g[sparse[1:] != 0], -np.sign(sparse[1:][sparse[1:] != 0]), atol=1e-3)


def test_average_precision():
    assert k.average_precision(np.array([0, 1.0, 1]), np.array([0.1, 0.9, 0.8])) == 1
    assert math.isclose(k.average_precision(np.array([0, 1.0]), np.array([0.5, 0.5])), 0.5)
    assert k.average_precision(np.zeros(3), np.zeros(3)) is None


def test_loop_of_more_than_600_points():
    n = 603
    at = 2 * np.pi * np.arange(n) / n
    d = np.abs(2 * np.sin((at[:, None] - at[None, :]) / 2))
    h0, h1 = k.rips_diagrams(d)
    longest = h1[np.argmax(h1[:, 1] - h1[:, 0])]
    assert len(h0) == n - 1 and np.allclose(longest, [2 * np.sin(np.pi / n), np.sqrt(3)])


def test_error_function():
    x = np.r_[np.linspace(-6, 6, 1001), 0.46875, -0.46875, 4, -4, 30, -30, np.nan]
    assert np.allclose(k.erf(x), [math.erf(v) for v in x], rtol=0, atol=1e-15, equal_nan=True)


def test_stacked_windows_as_one_each():
    a = np.random.default_rng(0).normal(size=(7, 60, 5))
    together = k.weighted_correlation(a)
    assert np.allclose(together, [k.weighted_correlation(x) for x in a])


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 4), st.integers(0, 4), st.integers(0, 1000))
def test_wasserstein_is_the_best_of_all_matchings(n, m, seed):
    rng = np.random.default_rng(seed)
    a, b = (np.column_stack([x := rng.random(size), x + rng.random(size)]) for size in (n, m))
    cost = np.zeros((n + m, n + m))
    for i, j in itertools.product(range(n + m), repeat=2):
        if i < n and j < m:
            cost[i, j] = ((a[i] - b[j]) ** 2).sum()
        elif i < n:
            cost[i, j] = (a[i, 1] - a[i, 0]) ** 2 / 2
        elif j < m:
            cost[i, j] = (b[j, 1] - b[j, 0]) ** 2 / 2
    least = min((sum(cost[i, p[i]] for i in range(n + m)) for p in itertools.permutations(range(n + m))), default=0.0) if n + m <= 7 else k.assignment_cost(cost)
    assert math.isclose(k.wasserstein(a, b), math.sqrt(least), abs_tol=1e-9)


def test_open_edges_have_no_triangle():
    d = k.distance(k.weighted_correlation(np.random.default_rng(5).normal(size=(60, 40))))
    i, j = np.triu_indices(40, 1)
    order = np.argsort(d[i, j], kind="stable")
    i, j = i[order], j[order]
    rank = np.full((40, 40), len(i))
    rank[i, j] = rank[j, i] = np.arange(len(i))
    want = [e for e in range(len(i)) if not any(rank[i[e], v] < e and rank[j[e], v] < e for v in range(40))]
    assert k.open_edges(rank, i, j).tolist() == want
