"""Connected empty space and where a walker fits, against a flood from cell to cell."""

import itertools
import random

import pytest

from voxelith import graphs
from voxelith.operators import voxels as V

CELLS = "ix bigint, iy bigint, iz bigint"


def flood(solid, seed, low, high):
    inside = lambda c: all(a <= v < b for v, a, b in zip(c, low, high))
    if not inside(seed) or seed in solid:
        return set()
    seen, todo = {seed}, [seed]
    while todo:
        c = todo.pop()
        for step in V.NEIGHBOURS:
            n = tuple(a + b for a, b in zip(c, step))
            if n not in seen and n not in solid and inside(n):
                seen.add(n)
                todo.append(n)
    return seen


@pytest.mark.parametrize(("side", "share"), [(32, 0.4), (3, 0.35), (4, 0.0), (5, 0.55)])
def test_connected_equals_a_flood(spark, monkeypatch, side, share):
    monkeypatch.setattr(V, "SIDE_CELLS", side)
    rnd = random.Random(side)
    low, high = (-4, 2, -9), (9, 11, 3)
    solid = {c for c in itertools.product(*(range(a - 2, b + 2) for a, b in zip(low, high))) if rnd.random() < share}
    df = spark.createDataFrame(sorted(solid), CELLS) if solid else spark.createDataFrame([], CELLS)
    for seed in [(-4, 2, -9), (8, 10, 2), (0, 5, -3), (50, 0, 0)]:
        got = [tuple(r) for r in V.connected(df, seed, low, high).collect()]
        assert len(got) == len(set(got)) and set(got) == flood(solid, seed, low, high)


def test_a_long_way_takes_few_jobs(spark, monkeypatch):
    """A corridor that winds through many blocks: rounds grow with the logarithm of their number."""
    monkeypatch.setattr(V, "SIDE_CELLS", 2)
    rounds = []
    real = graphs.materialise
    monkeypatch.setattr(graphs, "materialise", lambda *a, **k: rounds.append(1) or real(*a, **k))
    n = 24
    solid = {(x, 0, z) for x in range(n) for z in range(1, n, 2) if x != (n - 1 if z // 2 % 2 == 0 else 0)}
    got = {tuple(r) for r in V.connected(spark.createDataFrame(sorted(solid), CELLS), (0, 0, 0), (0, 0, 0), (n, 1, n)).collect()}
    assert got == flood(solid, (0, 0, 0), (0, 0, 0), (n, 1, n)) and len(got) > 250
    assert len(rounds) <= 14


@pytest.mark.parametrize(("radius", "height"), [(0, 1), (1, 3), (2, 2)])
def test_blocked_cells_equal_all_pairs(spark, radius, height):
    rnd = random.Random(radius)
    solid = {tuple(rnd.randrange(-6, 7) for _ in range(3)) for _ in range(25)}
    got = [tuple(r) for r in V.blocked(spark.createDataFrame(sorted(solid), CELLS), radius, height).select(V.CELL).collect()]
    want = {c for c in itertools.product(range(-10, 11), repeat=3) if any((x - c[0]) ** 2 + (z - c[2]) ** 2 <= radius**2 and 0 <= y - c[1] < height for x, y, z in solid)}
    assert len(got) == len(set(got)) and set(got) == want
