"""Kernels and bridges: shapes, exact sums, invariants, distribution."""

import itertools
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from trailweave.functions import kernels as K
from trailweave.operators import bridge as B
from trailweave.operators import walks


def test_sector_masks():
    m = K.sector_masks(8, 3)
    assert np.allclose(m.sum(0), 1)
    assert m[0, 3, 3:6].round(4).tolist() == [0.1036, 0.7929, 1.0]
    assert m[0, 4, 4:7].round(4).tolist() == [0.0178, 0.3284, 0.7426]


def test_kernels():
    g = K.gaussian(3)
    assert g.shape == (7, 7) and np.isclose(g.sum(), 1) and np.isclose(g[3, 4] / g[3, 3], np.exp(-1 / (2 * 1.5**2)))
    assert np.allclose(K.correlated(8, 3).sum((1, 2)), 1)
    assert np.allclose(K.rotate(g, 90), g, atol=1e-9)
    assert K.correlated_from(g, 4).shape == (4, 7, 7)
    with pytest.raises(ValueError):
        K.from_array(np.ones((5, 5)), 3)
    with pytest.raises(ValueError):
        K.correlated_from(np.ones((4, 4)), 4)


def test_mapping():
    m = K.with_class(K.default_mapping("mixed", "MEDIUM", 5), 30, is_brownian=True, S=8)
    assert m[30].D == 1 and m[30].S == 8 and m[80].forbidden and not K.default_mapping(animal="AIRBORNE")[80].forbidden
    assert K.forbid(m, 10)[10].forbidden


@pytest.mark.parametrize("S", [1, 2, 3])
def test_brownian(S):
    path = B.walk(B.brownian_field(25, 25, S), (12, 12), (18, 18), 15)
    assert len(path) == 15 and path[0] == (12, 12) and path[-1] == (18, 18)
    assert max(max(abs(a - c), abs(b - d)) for (a, b), (c, d) in itertools.pairwise(path)) <= S


def test_bad_arguments():
    with pytest.raises(ValueError):
        B.walk(B.brownian_field(10, 10, 3), (5, 5), (15, 15), 50)
    with pytest.raises(ValueError):
        B.brownian_field(10, 0, 3)
    with pytest.raises(ValueError):
        B.biased_field(10, 10, [(1, 2, 3)])


def test_unreachable():
    assert B.walk(B.brownian_field(50, 50, 1), (0, 0), (40, 40), 5) is None
    closed = np.full((5, 9), 30)
    closed[:, 4] = 80
    field = B.terrain_field(closed, K.default_mapping("brownian", "MEDIUM", 1))
    assert B.walk(field, (0, 0), (8, 4), 40) is None


def test_biased():
    path = B.walk(B.biased_field(100, 100, [(4, 0)] * 10 + [(-4, 0)] * 10), (50, 20), (50, 60), 20)
    assert len(path) == 20 and path[0] == (50, 20) and path[-1] == (50, 60)
    assert len(B.walk(B.biased_field(60, 60, [30.0 * t for t in range(12)], 3, rotation=True), (20, 20), (28, 25), 12)) == 12


def test_correlated_and_mixed():
    path = B.walk(B.correlated_field(41, 41, 6, 3), (5, 5), (30, 30), 25, end_direction=1)
    assert len(path) == 25 and path[-1] == (30, 30)
    rng = np.random.default_rng(1)
    grid = rng.choice([10, 30, 40, 80], size=(30, 40))
    grid[2, 2] = grid[25, 30] = 30
    path = B.walk(B.terrain_field(grid, K.default_mapping("mixed", "MEDIUM", 3)), (2, 2), (30, 25), 51)
    assert len(path) == 51 and all(grid[y, x] != 80 for x, y in path)


def brute(width, height, kernel, start, end, T):
    """Occupancy of each cell at each time, over all paths with moves renormalised at the border."""
    S = kernel.shape[0] // 2
    n = width * height
    P = np.zeros((n, n))
    for y, x in itertools.product(range(height), range(width)):
        for dy, dx in K.offsets(S):
            if 0 <= x + dx < width and 0 <= y + dy < height:
                P[y * width + x, (y + dy) * width + x + dx] = kernel[dy + S, dx + S]
    P /= P.sum(1, keepdims=True)
    a, b = [np.eye(n)[start[1] * width + start[0]]], [np.eye(n)[end[1] * width + end[0]]]
    for _ in range(T - 1):
        a.append(a[-1] @ P)
        b.append(P @ b[-1])
    return [x * y / (x * y).sum() for x, y in zip(a, b[::-1], strict=True)]


def test_distribution():
    T, start, end = 7, (0, 2), (5, 4)
    want = brute(8, 6, K.gaussian(1), start, end, T)[3]
    field = B.brownian_field(8, 6, 1)
    got = Counter(B.walk(field, start, end, T, (k,))[3] for k in range(2000))
    share = np.array([got[(x, y)] / 2000 for y in range(6) for x in range(8)])
    assert np.abs(share - want).max() < 0.05


def test_kept_layers_do_not_matter(monkeypatch):
    field = B.correlated_field(31, 31, 4, 2)
    whole = B.walk(field, (3, 3), (20, 22), 30)
    monkeypatch.setattr(B, "MEMORY", 1)
    assert B.walk(field, (3, 3), (20, 22), 30) == whole


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 14), st.integers(0, 14), st.integers(0, 14), st.integers(0, 14), st.integers(1, 3))
def test_invariants(x0, y0, x1, y1, S):
    T = max(5, abs(x1 - x0) + abs(y1 - y0) + 1)
    path = B.walk(B.brownian_field(15, 15, S), (x0, y0), (x1, y1), T)
    assert len(path) == T and path[0] == (x0, y0) and path[-1] == (x1, y1)
    assert all(0 <= x < 15 and 0 <= y < 15 for x, y in path)


def test_multistep(spark):
    field = B.brownian_field(30, 30, 3)
    steps = walks.points(spark, [(10, 10), (20, 20), (5, 25), (25, 5)])
    both = walks.multistep(steps, 20, field).orderBy("seg", "t").collect()
    assert len(both) == 60 and (both[20].x, both[20].y) == (20, 20) and (both[40].x, both[40].y) == (5, 25)
    assert walks.multistep(steps, 20, field, keep_both=False).count() == 57
    assert walks.multistep(steps, 20, field, keep_both=False, append_final=True).count() == 58
    with pytest.raises(ValueError):
        walks.multistep(walks.points(spark, [(1, 1)]), 20, field)


def test_status_and_partitions(spark):
    rows = [("a", 0, 0, 0, 40, 40, 5), ("a", 1, 3, 3, 3, 3, 1), ("b", 0, 1, 1, 9, 9, 20)]
    frame = spark.createDataFrame(rows, "animal_id string, seg int, x0 int, y0 int, x1 int, y1 int, T int")
    field = B.brownian_field(50, 50, 1)
    got = B.bridge(frame, lambda row: field).collect()
    assert [r.status for r in got if r.seg == 0 and r.animal_id == "a"] == ["UNREACHABLE"]
    assert sum(r.animal_id == "a" and r.seg == 1 for r in got) == 1
    again = B.bridge(frame.repartition(1), lambda row: field).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert B.bridge(frame, lambda row: field, fallback=True).where("status = 'FALLBACK'").count() == 2
