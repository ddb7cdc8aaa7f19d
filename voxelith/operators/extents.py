"""Cells that the extents of Gaussians meet, by cells of several sizes from the largest down."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from voxelith.operators.voxels import CELL, Grid
from voxelith.storage import materialise

#: Cells that a Gaussian's box is wide at most at the level it is dealt to.
ACROSS = 4
#: Extents below this share of a cell count as this, so that flat Gaussians have a volume.
FLAT = 1e-3
#: What a cell is to an ellipsoid.
APART, TOUCHED, WITHIN = 0, 1, 2
CENTRE = ["px", "py", "pz"]


def cell_kinds(low: np.ndarray, side: np.ndarray, centre: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """APART, TOUCHED or WITHIN for n cubes (`low` n x 3, `side` n) and ellipsoids {centre + axes w: |w| <= 1} (n x 3 x 3).

    The point of a cube that is nearest to the centre, as the ellipsoid measures it, is the least one with some coordinates
    on the cube's border and the others free, for one of 27 choices of them; each is found in closed form, and counts if its
    free coordinates are in the cube. A cube is within if its corners are. Borders belong to both.
    """
    ends = np.stack([low - centre, low - centre + side[:, None]], 1)
    row = [axes[:, k] for k in range(3)]
    dot = lambda a, b: np.einsum("ij,ij->i", a, b)
    inside = lambda d, k: (ends[:, 0, k] <= d) & (d <= ends[:, 1, k])
    touched = inside(0.0, 0) & inside(0.0, 1) & inside(0.0, 2)
    within = np.ones(len(low), bool)
    for a in range(3):
        b, c = (a + 1) % 3, (a + 2) % 3
        square = dot(row[a], row[a])
        normal = np.cross(row[b], row[c])
        area = dot(normal, normal)
        for e in range(2):
            w = (ends[:, e, a] / square)[:, None] * row[a]
            touched |= (dot(w, w) <= 1) & inside(dot(row[b], w), b) & inside(dot(row[c], w), c)
        for e, f in itertools.product(range(2), repeat=2):
            u = ends[:, e, b, None] * row[c] - ends[:, f, c, None] * row[b]
            w = np.cross(u, normal) / area[:, None]
            touched |= (dot(w, w) <= 1) & inside(dot(row[a], w), a)
    faces = [np.cross(row[(a + 1) % 3], row[(a + 2) % 3]) for a in range(3)]
    volume = dot(row[0], faces[0])
    for corner in itertools.product(range(2), repeat=3):
        w = sum(ends[:, e, a, None] * faces[a] for a, e in enumerate(corner)) / volume[:, None]
        near = dot(w, w) <= 1
        touched |= near
        within &= near
    return np.where(within, WITHIN, np.where(touched, TOUCHED, APART))


@F.pandas_udf(IntegerType())
def _kind(side: pd.Series, jx: pd.Series, jy: pd.Series, jz: pd.Series, px: pd.Series, py: pd.Series, pz: pd.Series, m: pd.Series) -> pd.Series:
    size = side.to_numpy(np.float64)
    low = np.stack([jx, jy, jz], 1) * size[:, None]
    axes = np.stack(m.to_numpy()).reshape(-1, 3, 3) if len(m) else np.zeros((0, 3, 3))
    return pd.Series(cell_kinds(low, size, np.stack([px, py, pz], 1), axes).astype(np.int32))


def _axes(extents: np.ndarray, q: np.ndarray) -> np.ndarray:
    """n x 3 x 3: the columns are the axes, each as long as its extent, turned by quaternions (x, y, z, w) of any length."""
    size = np.linalg.norm(q, axis=1)
    x, y, z, w = np.where(size[:, None] > 0, q / np.where(size > 0, size, 1.0)[:, None], [0.0, 0.0, 0.0, 1.0]).T
    turn = np.array([
        [1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)],
        [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)],
        [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)],
    ])
    return np.moveaxis(turn, 2, 0) * extents[:, None, :]


def ellipsoids(splats: DataFrame, grid: Grid, sigmas: float, cutoff: float, first: list[int], last: list[int]) -> DataFrame:
    """`a, px, py, pz, m, x0..z1, level`: ellipsoids of `sigmas` standard deviations, in cells, whose boxes meet the cells `first` to `last`.

    `m` is the 3 x 3 matrix of the axes row by row, `x0..z1` are the cells that the box meets. Gaussians under the cutoff,
    and those whose opacity, centre, extents or rotation are null or not finite, are left out. A rotation of length 0 is
    none; extents count without their sign.
    """
    names = ["x", "y", "z", "sx", "sy", "sz", "qx", "qy", "qz", "qw"]
    rows = splats.where(F.col("a") >= cutoff).select(*(F.col(n).cast("double").alias(n) for n in ["a", *names]))
    cell, origin, (lo, hi) = np.array(grid.cell), np.array(grid.origin), (np.array(v, float) for v in (first, last))

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b[np.isfinite(b.to_numpy(np.float64, na_value=np.nan)).all(1)]
            v = b[names].to_numpy(np.float64)
            at = (v[:, :3] - origin) / cell
            m = _axes(np.maximum(np.abs(v[:, 3:6]), FLAT * cell.min()) * sigmas, v[:, 6:]) / cell[None, :, None]
            reach = np.sqrt((m * m).sum(2))
            met = ((at + reach >= lo) & (at - reach < hi + 1)).all(1)
            if not met.any():
                continue
            at, m, reach = at[met], m[met], reach[met]
            ends = [np.floor(np.clip(at + side * reach, lo, hi + 0.5)).astype(np.int64) for side in (-1, 1)]
            wide = (ends[1] - ends[0] + 1).max(1)
            out = pd.DataFrame({"a": b["a"].to_numpy()[met], **dict(zip(CENTRE, at.T)), "m": list(m.reshape(-1, 9))})
            for k, c in enumerate("xyz"):
                out[f"{c}0"], out[f"{c}1"] = ends[0][:, k], ends[1][:, k]
            yield out.assign(level=np.maximum(0, np.ceil(np.log2(wide / ACROSS))).astype(np.int32))

    spans = ", ".join(f"{c}0 bigint, {c}1 bigint" for c in "xyz")
    return rows.mapInPandas(placed, f"a double, px double, py double, pz double, m array<double>, {spans}, level int")


def extent_occupancy(
    splats: DataFrame, grid: Grid, sigmas: float = 3.0, cutoff: float = 0.1, low: tuple[float, float, float] = (-100.0,) * 3, high: tuple[float, float, float] = (100.0,) * 3
) -> DataFrame:
    """`ix, iy, iz, n, opacity`: cells of the box that ellipsoids of `sigmas` standard deviations meet, how many and the largest opacity.

    `splats` has `x..z, sx..sz, qx..qw, a`. A Gaussian is dealt to cells of a level at which its box is at most ACROSS cells
    wide (cells of a level are twice as large as those below). From the largest level down, cells that it doesn't meet are
    left, cells that it only touches go to their eight parts, cells that lie within it are counted and go no further as
    pairs: they are summed by cell first and then cut, so many large Gaussians over the same cells cost as much as one. Rows
    are dealt anew at each level, so a huge Gaussian isn't one task's work. Levels are as many as the box has doublings.
    """
    first = [int(np.floor((a - o) / s)) for a, o, s in zip(low, grid.origin, grid.cell)]
    last = [int(np.floor((b - o) / s)) for b, o, s in zip(high, grid.origin, grid.cell)]
    base = materialise(ellipsoids(splats, grid, sigmas, cutoff, first, last), "extents")
    top = base.agg(F.max("level")).first()[0] or 0

    def kept(rows: DataFrame, at: int) -> DataFrame:
        """Cells of level `at` that the box meets."""
        held = [(F.shiftleft(F.col(c), at) <= b) & (F.shiftleft(F.col(c) + 1, at) > a) for c, a, b in zip(CELL, first, last)]
        return rows.where(held[0] & held[1] & held[2])

    def parts(rows: DataFrame, at: int) -> DataFrame:
        """The eight parts, in level `at`, of cells of the level above."""
        for c in CELL:
            rows = rows.withColumn(c, F.explode(F.array(F.col(c) * 2, F.col(c) * 2 + 1)))
        return kept(rows, at)

    pair = ["a", *CENTRE, "m", *CELL]
    todo = counted = None
    for at in range(top, -1, -1):
        mine = base.where(F.col("level") == at)
        for c, axis in zip(CELL, "xyz"):
            mine = mine.withColumn(c, F.explode(F.sequence(F.shiftright(F.col(f"{axis}0"), at), F.shiftright(F.col(f"{axis}1"), at))))
        mine = mine.select(pair)
        todo = (mine if todo is None else todo.unionByName(mine)).hint("rebalance")
        kind = _kind(F.lit(float(1 << at)), *CELL, *CENTRE, "m")
        met = materialise(todo.withColumn("kind", kind).where(F.col("kind") > APART), f"extents-{at}")
        whole = met.where(F.col("kind") == WITHIN) if at else met
        here = whole.groupBy(CELL).agg(F.count(F.lit(1)).alias("n"), F.max("a").alias("opacity"))
        counted = here if counted is None else parts(counted, at).unionByName(here).groupBy(CELL).agg(F.sum("n").alias("n"), F.max("opacity").alias("opacity"))
        if at:
            todo = parts(met.where(F.col("kind") == TOUCHED).select(pair), at - 1)
    return counted
