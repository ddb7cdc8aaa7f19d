"""Paths of rays and first voxels against a walk from cell to cell, one ray at a time."""

import random

import pytest
from pyspark.sql import functions as F

from voxelith.operators import octree
from voxelith.operators import ray_paths as P
from voxelith.operators import voxels as V

KINDS = "ray_id bigint, " + ", ".join(f"{c} double" for c in P.RAY)
LOW, HIGH = (-7, -3, 0), (9, 14, 17)


def walk(ray, grid, low, high):
    """(t, cell) of each cell that a ray passes."""
    rid, *v = ray
    o, d, max_t = v[:3], v[3:6], v[6]
    near, far = 0.0, max_t
    for a in range(3):
        lo, hi = (grid.origin[a] + e[a] * grid.cell[a] for e in (low, high))
        if abs(d[a]) <= 1e-12:
            if not lo <= o[a] < hi:
                return []
            continue
        t0, t1 = sorted(((lo - o[a]) / d[a], (hi - o[a]) / d[a]))
        near, far = max(near, t0), min(far, t1)
    if not near <= far:
        return []
    cell = [min(max(int((o[a] + d[a] * near - grid.origin[a]) // grid.cell[a]), low[a]), high[a] - 1) for a in range(3)]
    out, t = [], near
    while True:
        out.append((t, tuple(cell)))
        ahead = [(grid.origin[a] + (cell[a] + (d[a] > 0)) * grid.cell[a] - o[a]) / d[a] if abs(d[a]) > 1e-12 else float("inf") for a in range(3)]
        t = min(ahead)
        a = max(k for k in range(3) if ahead[k] == t)
        if t > max_t or t == float("inf"):
            return out
        cell[a] += 1 if d[a] > 0 else -1
        if not low[a] <= cell[a] < high[a]:
            return out


@pytest.fixture(scope="module")
def rays():
    rnd = random.Random(4)
    half = lambda a, b: rnd.randrange(2 * a, 2 * b) / 2  # noqa: E731  many of these cross several planes at once
    slope = lambda: rnd.choice([0.0, 0.25, -0.25, 0.5, -0.5, 1.0, -1.0, 2.0])
    out = [(i, half(-9, 12), half(-5, 16), half(-2, 19), slope(), slope(), slope(), rnd.choice([1.0, 3.5, 100.0])) for i in range(300)]
    out += [(i, *(rnd.uniform(-9, 19) for _ in range(3)), *(rnd.gauss(0, 1) for _ in range(3)), rnd.uniform(0, 40)) for i in range(300, 600)]
    return out


@pytest.mark.parametrize("grid", [V.Grid(), V.Grid((0.5, -1.0, 0.0), (0.5, 1.0, 2.0))])
def test_paths_equal_a_walk(spark, rays, grid):
    odd = [(900, float("nan"), 0.0, 0.0, 1.0, 0.0, 0.0, 5.0), (901, 0.5, 0.5, 0.5, float("inf"), 0.0, 0.0, 5.0), (902, 0.5, 0.5, 0.5, 0.0, 0.0, 0.0, 5.0)]
    got = {}
    for r in sorted(P.ray_cells(spark.createDataFrame(rays + odd, KINDS), grid, LOW, HIGH).collect(), key=lambda r: r.step):
        got.setdefault(r.ray_id, []).append((round(r.t, 9), (r.ix, r.iy, r.iz)))
    inside = got.pop(902, None)
    assert inside is None or len(inside) == 1
    assert got == {r[0]: [(round(t, 9), c) for t, c in p] for r in rays if (p := walk(r, grid, LOW, HIGH))}


@pytest.mark.parametrize(("share", "wave"), [(0.02, 1), (0.2, 8), (0.002, 2)])
def test_first_voxels_equal_a_walk(spark, rays, share, wave):
    rnd = random.Random(share)
    cells = {(x, y, z) for x in range(-9, 11) for y in range(-5, 16) for z in range(-2, 19) if rnd.random() < share}
    grid = V.Grid((0.5, -1.0, 0.0), (0.5, 1.0, 2.0))
    voxels = spark.createDataFrame(sorted(cells), "ix bigint, iy bigint, iz bigint")
    got = {r.ray_id: (round(r.t, 9), (r.ix, r.iy, r.iz)) for r in P.first_hit(spark.createDataFrame(rays, KINDS), voxels, grid, LOW, HIGH, wave).collect()}
    want = {r[0]: next(((round(t, 9), c) for t, c in walk(r, grid, LOW, HIGH) if c in cells), None) for r in rays}
    assert got == {k: v for k, v in want.items() if v}


def test_voxels_of_an_octree(spark, rays):
    """The same hits with voxels that went through the octree's words."""
    rnd = random.Random(1)
    cells = sorted({(rnd.randrange(16), rnd.randrange(16), rnd.randrange(16)) for _ in range(200)} | {(x, y, z) for x in range(4) for y in range(4) for z in range(4)})
    voxels = spark.createDataFrame(cells, "ix bigint, iy bigint, iz bigint")
    down = V.unpack_leaves(octree.flatten(*octree.build(V.leaf_masks(voxels), 2), 2))
    df = spark.createDataFrame(rays, KINDS)
    both = [sorted(map(tuple, P.first_hit(df, v, V.Grid(), (0, 0, 0), (16, 16, 16)).collect())) for v in (voxels, down)]
    assert both[0] == both[1] and both[0]


def test_rays_are_dealt_to_few_blocks(spark, monkeypatch):
    """A wall near the start of long rays: what is joined is bounded by the first wave's blocks."""
    wall = spark.range(400).select(F.lit(9).cast("bigint").alias("ix"), (F.col("id") % 20).alias("iy"), F.expr("id div 20").alias("iz"))
    rays = spark.range(50).select(F.col("id").alias("ray_id"), F.lit(0.5).alias("ox"), *(F.lit(7.3).alias(c) for c in ("oy", "oz")), F.lit(1.0).alias("dx"), *(F.lit(0.001).alias(c) for c in ("dy", "dz")), F.lit(1e6).alias("max_t"))
    steps = []
    path = P.Rays.path
    monkeypatch.setattr(P.Rays, "path", lambda self, stride, start, stop: steps.append((start, stop)) or path(self, stride, start, stop))
    got = P.first_hit(rays, wall, V.Grid(), (0, 0, 0), (100_000, 20, 20))
    assert {(r.t, r.ix) for r in got.collect()} == {(8.5, 9)}


def test_no_rays_and_no_voxels(spark):
    voxels = spark.createDataFrame([(0, 0, 0)], "ix bigint, iy bigint, iz bigint")
    rays = spark.createDataFrame([(1, 0.5, 5.0, 0.5, 0.0, -1.0, 0.0, 9.0)], KINDS)
    assert P.first_hit(rays.where("false"), voxels, V.Grid(), (0, 0, 0), (4, 4, 4)).count() == 0
    assert P.first_hit(rays, voxels.where("false"), V.Grid(), (0, 0, 0), (4, 8, 4)).count() == 0
