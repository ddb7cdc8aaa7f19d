"""The cells that rays pass, for many rays at once, and the first solid voxel of each in two levels of cells.

A ray crosses planes of cell borders; each crossing is one step along one axis. The crossings of all axes in order are the
ray's path. Crossings at the same place go z before y before x. Planes are numbered in cells at every level, so that the
crossings of blocks are some of those of their cells, with the same numbers, and the two levels agree on the path.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelith.operators.voxels import BLOCK, CELL, LEAF, Grid, leaf_masks
from voxelith.storage import discard, materialise

RAY = ["ox", "oy", "oz", "dx", "dy", "dz", "max_t"]
#: Directions this short along an axis don't move along it.
FLAT = 1e-12
#: Blocks of each ray that are looked at first; each wave after that takes twice as many.
FIRST_WAVE = 8
#: The order of crossings at the same place, by axis.
TIES = np.array([2, 1, 0])


class Rays:
    """A batch of rays in a box of cells from `low` up to but without `high`: where they enter it, and in which cell."""

    def __init__(self, b: pd.DataFrame, grid: Grid, low: tuple[int, ...], high: tuple[int, ...]):
        self.o, self.d, self.max_t = b[RAY[:3]].to_numpy(float), b[RAY[3:6]].to_numpy(float), b["max_t"].to_numpy(float)
        self.origin, self.size, self.low, self.high = np.array(grid.origin), np.array(grid.cell), np.array(low), np.array(high)
        self.flat = np.abs(self.d) <= FLAT
        self.up = self.d > 0
        lo, hi = self.origin + self.low * self.size, self.origin + self.high * self.size
        with np.errstate(divide="ignore", invalid="ignore"):
            a, z = (lo - self.o) / self.d, (hi - self.o) / self.d
        outside = (self.flat & ((self.o < lo) | (self.o >= hi))).any(1)
        self.near = np.maximum(0.0, np.where(self.flat, -np.inf, np.minimum(a, z)).max(1))
        far = np.minimum(self.max_t, np.where(self.flat, np.inf, np.maximum(a, z)).min(1))
        finite = np.isfinite(self.o).all(1) & np.isfinite(self.d).all(1) & np.isfinite(self.near)
        self.ok = ~outside & (self.near <= far) & finite
        with np.errstate(invalid="ignore"):
            at = np.floor((self.o + self.d * self.near[:, None] - self.origin) / self.size)
        self.first = np.clip(np.where(self.ok[:, None], at, 0), self.low, self.high - 1).astype(np.int64)

    def crossed(self, plane: np.ndarray, ray: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Where rays cross planes (n x 3, numbered in cells); never along an axis that they don't move along."""
        flat = self.flat[ray]
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(flat, np.inf, (self.origin + plane * self.size - self.o[ray]) / np.where(flat, 1.0, self.d[ray]))

    def path(self, stride: int, start: int, stop: int) -> tuple[np.ndarray, ...]:
        """(ray, step, t, axis, cell n x 3) of the steps from `start` to before `stop` through cells of `stride` cells.

        `axis` is the one that the ray crosses into the cell, -1 at its start.
        """
        here = self.first // stride
        last = np.where(self.up, (self.high - 1) // stride, self.low // stride)
        count = np.where(self.flat | ~self.ok[:, None], 0, np.abs(last - here))
        count = np.minimum(count, stop)  # later crossings belong to later steps
        n = len(count)
        # The crossing that leaves the box ends the path.
        gone = self.crossed(np.where(self.up, self.high, self.low))
        end_t = gone.min(1)
        end_tie = np.where(gone == end_t[:, None], TIES, 9).min(1)
        flat_count = count.ravel()
        owner = np.repeat(np.arange(3 * n), flat_count)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(flat_count) - flat_count, flat_count)
        ray, axis = owner // 3, owner % 3
        up = self.up[ray, axis]
        plane = np.where(up, (here[ray, axis] + 1 + nth) * stride, (here[ray, axis] - nth) * stride)
        with np.errstate(divide="ignore", invalid="ignore"):
            t = (self.origin[axis] + plane * self.size[axis] - self.o[ray, axis]) / self.d[ray, axis]
        tie = TIES[axis]
        inside = (t <= self.max_t[ray]) & ((t < end_t[ray]) | ((t == end_t[ray]) & (tie < end_tie[ray])))
        ray, axis, t, tie, up = ray[inside], axis[inside], t[inside], tie[inside], up[inside]
        order = np.lexsort((tie, t, ray))
        ray, axis, t, up = ray[order], axis[order], t[order], up[order]
        # The steps before the first crossing, then one for each.
        begins = np.flatnonzero(self.ok)
        ray = np.concatenate([begins, ray])
        axis = np.concatenate([np.full(len(begins), -1), axis])
        t = np.concatenate([self.near[begins], t])
        move = np.zeros((len(ray), 3), np.int64)
        late = np.arange(len(begins), len(ray))
        move[late, axis[late]] = np.where(up, 1, -1)
        order = np.argsort(ray, kind="stable")
        ray, axis, t, move = ray[order], axis[order], t[order], move[order]
        first = np.flatnonzero(np.r_[True, ray[1:] != ray[:-1]]) if len(ray) else np.empty(0, int)
        size = np.diff(np.r_[first, len(ray)])
        total = np.cumsum(move, 0)
        before = np.repeat(total[first] - move[first], size, 0) if len(ray) else total
        cell = here[ray] + total - before
        step = np.arange(len(ray)) - np.repeat(first, size)
        keep = (step >= start) & (step < stop)
        return ray[keep], step[keep], t[keep], axis[keep], cell[keep]


def ray_cells(rays: DataFrame, grid: Grid, low: tuple[int, int, int], high: tuple[int, int, int]) -> DataFrame:
    """`ray_id, step, t, ix, iy, iz`: the cells that each ray (`ray_id, ox, oy, oz, dx, dy, dz, max_t`) passes, in order.

    Cells are those of the box from `low` up to but without `high`. `t` is where the ray enters the cell, in lengths of its
    direction, which need not be a unit vector. On a tie of axes z goes before y before x. A ray along an axis is inside
    the box from its lower border up to but without its upper one. Rays that aren't finite pass no cell.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ray, step, t, _, cell = Rays(b, grid, low, high).path(1, 0, 1 << 62)
            yield pd.DataFrame({"ray_id": b["ray_id"].to_numpy()[ray], "step": step, "t": t} | {c: cell[:, k] for k, c in enumerate(CELL)})

    return rays.select("ray_id", *RAY).mapInPandas(run, "ray_id bigint, step int, t double, ix bigint, iy bigint, iz bigint")


def _entered(rays: Rays, t: np.ndarray, axis: np.ndarray, block: np.ndarray) -> np.ndarray:
    """The cell in which a ray is when it has crossed `axis` at `t` into `block` (or starts there, for -1)."""
    with np.errstate(invalid="ignore"):
        cell = np.floor((rays.o + rays.d * t[:, None] - rays.origin) / rays.size)
    low, high = np.maximum(block * LEAF, rays.low), np.minimum(block * LEAF + LEAF, rays.high) - 1
    cell = np.clip(cell, low, high).astype(np.int64)
    # A crossing counts if it's before the entry; the estimate is off by one at most.
    done = lambda plane: (rays.crossed(plane) < t[:, None]) | ((rays.crossed(plane) == t[:, None]) & (TIES <= TIES[axis][:, None]))
    ahead = np.where(rays.up, cell + 1, cell)  # the plane that the ray crosses next
    forward = ~rays.flat & done(ahead)
    cell = cell + np.where(forward, np.where(rays.up, 1, -1), 0)
    behind = np.where(rays.up, cell, cell + 1)
    back = ~rays.flat & ~forward & ~done(behind) & (cell != rays.first)
    cell = cell - np.where(back, np.where(rays.up, 1, -1), 0)
    cell = np.clip(cell, low, high)
    return np.where((axis < 0)[:, None], rays.first, cell)


def walk_block(rays: Rays, t: np.ndarray, axis: np.ndarray, block: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(whether it hits, t, cell n x 3): the first voxel set in the masks `lo, hi` of a block that each ray passes."""
    n = len(t)
    cell = _entered(rays, t, axis, block)
    # Up to three planes of each axis inside the block, and the one that leaves it.
    nth = np.arange(1, LEAF)
    plane = np.where(rays.up[:, :, None], cell[:, :, None] + nth, cell[:, :, None] + 1 - nth)
    inside = np.where(rays.up[:, :, None], plane < (block[:, :, None] + 1) * LEAF, plane > block[:, :, None] * LEAF)
    at = np.stack([rays.crossed(plane[:, :, k]) for k in range(LEAF - 1)], 2)
    at = np.where(inside, at, np.inf)
    leave = rays.crossed(np.where(rays.up, np.minimum((block + 1) * LEAF, rays.high), np.maximum(block * LEAF, rays.low)))
    ties = np.broadcast_to(TIES[:, None], (3, LEAF - 1))
    flat_t, flat_tie = at.reshape(n, -1), np.broadcast_to(ties.ravel(), (n, 3 * (LEAF - 1)))
    order = np.lexsort((flat_tie, flat_t), axis=1)
    when = np.take_along_axis(flat_t, order, 1)
    tie = np.take_along_axis(flat_tie, order, 1)
    end = leave.min(1)[:, None]
    end_tie = np.where(leave == end, TIES, 9).min(1)[:, None]
    goes_on = (when < end) | ((when == end) & (tie < end_tie))
    goes_on &= when <= rays.max_t[:, None]
    moves = np.zeros((n, 1 + when.shape[1], 3), np.int64)
    for k in range(3):
        moves[:, 1:, k] = np.where(goes_on & (2 - tie == k), np.where(rays.up[:, k], 1, -1)[:, None], 0)
    cells = cell[:, None, :] + np.cumsum(moves, 1)
    bit = (cells % LEAF * np.array([1, LEAF, LEAF * LEAF])).sum(2)
    word = np.where(bit < 32, lo[:, None], hi[:, None])
    passed = np.concatenate([np.ones((n, 1), bool), goes_on], 1)
    lit = passed & ((word >> (bit % 32)) & 1 == 1)
    first = lit.argmax(1)
    rows = np.arange(n)
    return lit[rows, first], np.concatenate([t[:, None], when], 1)[rows, first], cells[rows, first]


def first_hit(rays: DataFrame, voxels: DataFrame, grid: Grid, low: tuple[int, int, int], high: tuple[int, int, int], wave: int = FIRST_WAVE) -> DataFrame:
    """`ray_id, t, ix, iy, iz` of the first solid voxel on each ray; rays that hit none give no row. See ray_cells().

    Rays are cut at leaf blocks and joined to the blocks that have voxels; only in those they go from voxel to voxel, with
    the block's mask beside them. Blocks are taken in waves of growing length, and rays that have hit take no part in the
    next, so a ray is dealt to no more blocks than about twice those before its hit. `ray_id` is unique.
    """
    masks = materialise(leaf_masks(voxels).select(*BLOCK, "lo", "hi"), "ray-masks")
    left = materialise(rays.select("ray_id", *RAY), "rays")
    longest = sum(h // LEAF - w // LEAF + 1 for w, h in zip(low, high))  # blocks that any ray can pass

    def cut(start: int, stop: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                ray, step, t, axis, block = Rays(b, grid, low, high).path(LEAF, start, stop)
                out = b.iloc[ray].reset_index(drop=True)
                yield out.assign(step=step, t=t, axis=axis, **{k: block[:, i] for i, k in enumerate(BLOCK)})

        return run

    def walked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            hit, t, cell = walk_block(Rays(b, grid, low, high), b["t"].to_numpy(), b["axis"].to_numpy(), b[BLOCK].to_numpy(), b["lo"].to_numpy(), b["hi"].to_numpy())
            told = pd.DataFrame({"ray_id": b["ray_id"], "step": b["step"], "t": t} | {c: cell[:, i] for i, c in enumerate(CELL)})
            yield told[hit]

    kinds = ", ".join(f"{c} double" for c in RAY)
    found, start, stop = None, 0, wave
    while start < longest and not left.isEmpty():
        dealt = left.mapInPandas(cut(start, stop), f"ray_id bigint, {kinds}, step int, t double, axis int, " + ", ".join(f"{k} bigint" for k in BLOCK))
        hits = dealt.join(masks, BLOCK).mapInPandas(walked, "ray_id bigint, step int, t double, ix bigint, iy bigint, iz bigint")
        first = hits.groupBy("ray_id").agg(F.min("step").alias("step"), *(F.min_by(c, "step").alias(c) for c in ("t", *CELL)))
        first = materialise(first.drop("step"), "ray-hits")
        rest = materialise(left.join(first, "ray_id", "left_anti"), "rays")
        discard(left)
        left = rest
        found = first if found is None else found.unionByName(first)
        start, stop = stop, stop + (stop - start) * 2
    return found if found is not None else left.select("ray_id", F.lit(0.0).alias("t"), *(F.lit(0).cast("bigint").alias(c) for c in CELL)).limit(0)
