"""Cells that Gaussians' extents meet, against every cell and a numerical search for the nearest point."""

import itertools
import math
import random

import numpy as np
import pytest

from voxelith.operators import extents as E
from voxelith.operators.voxels import Grid

SPLAT = ", ".join(f"{c} double" for c in ["x", "y", "z", "sx", "sy", "sz", "qx", "qy", "qz", "qw", "a"])
GRID = Grid((0.3, -0.2, 0.1), (0.5, 0.4, 0.6))


def matrix(q):
    x, y, z, w = (v / math.sqrt(sum(u * u for u in q)) for v in q) if any(q) else (0, 0, 0, 1)
    return np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]])


def nearest(precision, low, high):
    """The least d' P d for low <= d <= high, by going along one coordinate after another."""
    d = np.clip(np.zeros(3), low, high)
    for _ in range(3000):
        was = d.copy()
        for k in range(3):
            rest = precision[k] @ d - precision[k, k] * d[k]
            d[k] = min(max(-rest / precision[k, k], low[k]), high[k])
        if np.abs(d - was).max() < 1e-13:
            break
    return d @ precision @ d


def brute(rows, sigmas, cutoff, low, high):
    first = [math.floor((v - o) / s) for v, o, s in zip(low, GRID.origin, GRID.cell)]
    last = [math.floor((v - o) / s) for v, o, s in zip(high, GRID.origin, GRID.cell)]
    out = {}
    for r in rows:
        if r[10] is None or r[10] < cutoff or any(v is None or not math.isfinite(v) for v in r):
            continue
        m = matrix(r[6:10])
        s = [max(abs(v), E.FLAT * min(GRID.cell)) for v in r[3:6]]
        precision = m @ np.diag([v**-2 for v in s]) @ m.T
        for c in itertools.product(*(range(a, b + 1) for a, b in zip(first, last))):
            lo = np.array([o + i * g for o, i, g in zip(GRID.origin, c, GRID.cell)]) - r[:3]
            if nearest(precision, lo, lo + GRID.cell) <= sigmas**2:
                n, a = out.get(c, (0, 0))
                out[c] = n + 1, max(a, r[10])
    return out


def test_cells_equal_a_search_over_all(spark):
    rnd = random.Random(5)
    g = lambda: rnd.gauss(0, 1)
    rows = [(g(), g(), g(), *(abs(g()) * rnd.choice([0.05, 0.4]) + 0.02 for _ in range(3)), g(), g(), g(), g(), rnd.random()) for _ in range(25)]
    rows += [(0.2, 0.1, 0.0, 3.0, 0.3, 1.5, 0.3, -0.2, 0.6, 0.7, 0.95)] * 2  # larger than the box in one direction, and twice
    rows += [(1.0, 1.0, 1.0, -0.4, 0.1, 0.2, 0.0, 0.0, 0.0, 0.0, 0.5), (-1.5, 0.2, 0.3, 0.3, 0.3, 0.3, 0.0, 0.0, 0.0, 2.0, 0.05)]
    rows += [(math.inf, 0.0, 0.0, 1.0, 1.0, 1.0, 0.0, 0.0, 0.0, 1.0, 0.9), (0.0, 0.0, 0.0, math.nan, 1.0, 1.0, 0.0, 0.0, 0.0, 1.0, 0.9), (0.0, 0.0, 0.0, 1.0, None, 1.0, 0.0, 0.0, 0.0, 1.0, 0.9), (0.0, 0.0, 0.0, 1.0, 1.0, 1.0, 0.0, 0.0, 0.0, 1.0, None)]
    box = (-2.0, -1.7, -2.2), (1.9, 2.3, 2.1)
    got = {(r.ix, r.iy, r.iz): (r.n, r.opacity) for r in E.extent_occupancy(spark.createDataFrame(rows, SPLAT), GRID, 2.0, 0.1, *box).collect()}
    assert got == brute(rows, 2.0, 0.1, *box) and max(n for n, _ in got.values()) > 2


def test_a_ball_and_a_flat_disc(spark):
    unit = Grid()
    ball = spark.createDataFrame([(0.5, 0.5, 0.5, 1.0, 1.0, 1.0, 0.0, 0.0, 0.0, 1.0, 0.9)], SPLAT)
    got = {(r.ix, r.iy, r.iz) for r in E.extent_occupancy(ball, unit, 40.0).collect()}
    gap = lambda i: max(0.0, abs(i) - 0.5)
    assert got == {c for c in itertools.product(range(-42, 43), repeat=3) if sum(gap(i) ** 2 for i in c) <= 1600}
    disc = spark.createDataFrame([(0.5, 0.5, 0.5, 10.0, 10.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.9)], SPLAT)
    assert {r.iz for r in E.extent_occupancy(disc, unit, 1.0).select("iz").distinct().collect()} == {0}


@pytest.mark.parametrize("rows", [[], [(500.0, 0.0, 0.0, 1.0, 1.0, 1.0, 0.0, 0.0, 0.0, 1.0, 0.9)], [(1e300, 0.0, 0.0, 1.0, 1.0, 1.0, 0.0, 0.0, 0.0, 1.0, 0.9)]])
def test_nothing_in_the_box(spark, rows):
    got = E.extent_occupancy(spark.createDataFrame(rows, SPLAT), Grid())
    assert got.count() == 0 and got.columns == ["ix", "iy", "iz", "n", "opacity"]


def test_a_huge_gaussian_is_cut_to_the_box_and_counted_by_cells(spark):
    rows = [(0.0, 0.0, 0.0, 1e6, 1e6, 1e6, 0.1, 0.2, 0.3, 0.9, 0.9)] * 50
    got = E.extent_occupancy(spark.createDataFrame(rows, SPLAT), Grid(), 3.0, 0.1, (-9.0,) * 3, (9.5,) * 3)
    assert got.groupBy("n", "opacity").count().collect() == [(50, 0.9, 19**3)]
