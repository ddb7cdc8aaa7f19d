"""Sparse voxels: occupancy of a cloud, packed leaves, lookups, rays and capsules, all by equi-joins on cell keys."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxelith.functions.vectors import Vec, clamp
from voxelith.graphs import contract, forest
from voxelith.ordering import group_quantiles
from voxelith.storage import materialise

CELL = ["ix", "iy", "iz"]
BLOCK = ["kx", "ky", "kz"]
#: Voxels along an edge of a leaf block.
LEAF = 4
#: Cells along an edge of the blocks that empty space is labelled in.
SIDE_CELLS = 32
#: Pushes of this length or less don't count.
PENETRATION = 1e-4
#: Cell numbers are under this, either way, where three of them are put into one number.
SIDE = 1 << 20
#: A capsule of less than this many cells from its middle to an end of its box meets three cells in a row at most.
NARROW = 0.99
#: Windows of voxels that are broadcast at most; more are joined by a shuffle.
FEW_WINDOWS = 1 << 18
#: Rounds of pushes in one stage: each has a Python worker of its own while the stage runs.
CHAINED = 4
CAPSULE = ["capsule_id", "x", "y", "z", "half_height", "radius"]
NEIGHBOURS = [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]


@dataclass(frozen=True)
class Grid:
    """Where cell (0, 0, 0) begins, and the cells' size along each axis."""

    origin: tuple[float, float, float] = (0.0, 0.0, 0.0)
    cell: tuple[float, float, float] = (1.0, 1.0, 1.0)

    def index(self, p: Vec) -> list[Column]:
        return [F.floor((c - o) / s).cast("bigint") for c, o, s in zip(p, self.origin, self.cell)]

    def low(self, index: list[Column]) -> Vec:
        return Vec(*(F.lit(o) + i * F.lit(s) for i, o, s in zip(index, self.origin, self.cell)))

    def size(self) -> Vec:
        return Vec(*(F.lit(s) for s in self.cell))


def in_box(p: Vec, low: tuple[float, float, float] = (-100.0,) * 3, high: tuple[float, float, float] = (100.0,) * 3) -> Column:
    """Whether a point lies in the box, borders included. Compares columns with constants, so it reaches the scan."""
    out = F.lit(True)
    for c, a, b in zip(p, low, high):
        out = out & (c >= a) & (c <= b)
    return out


def occupancy(points: DataFrame, grid: Grid, cutoff: float = 0.1) -> DataFrame:
    """`ix, iy, iz, n, opacity`: cells that hold points of at least this opacity, their number and largest opacity."""
    rows = points.where(F.col("a") >= cutoff).select(*(c.alias(n) for c, n in zip(grid.index(Vec(F.col("x"), F.col("y"), F.col("z"))), CELL)), "a")
    return rows.groupBy(CELL).agg(F.count(F.lit(1)).alias("n"), F.max("a").alias("opacity"))


def _floor_div(c: Column, n: int) -> Column:
    return F.floor(c / n).cast("bigint")


def leaf_bit(ix: Column, iy: Column, iz: Column) -> Column:
    """The bit of a voxel in its leaf: z, then y, then x, two bits each."""
    at = lambda c: F.pmod(c, F.lit(LEAF))
    return (at(iz) * LEAF * LEAF + at(iy) * LEAF + at(ix)).cast("int")


def leaf_masks(voxels: DataFrame) -> DataFrame:
    """`kx, ky, kz, lo, hi, solid`: occupied leaf blocks as two words of 32 bits; `solid` if all 64 voxels are set.

    Words are bigint, so that no bit is a sign. Masks are combined before the shuffle.
    """
    bit = leaf_bit(*(F.col(c) for c in CELL))
    one = F.lit(1).cast("bigint")
    rows = voxels.select(
        *(_floor_div(F.col(c), LEAF).alias(b) for c, b in zip(CELL, BLOCK)),
        F.when(bit < 32, F.call_function("shiftleft", one, bit)).otherwise(F.lit(0)).alias("l"),
        F.when(bit >= 32, F.call_function("shiftleft", one, bit - 32)).otherwise(F.lit(0)).alias("h"),
    )
    out = rows.groupBy(BLOCK).agg(F.bit_or("l").alias("lo"), F.bit_or("h").alias("hi"))
    full = F.lit(2**32 - 1).cast("bigint")
    return out.withColumn("solid", (F.col("lo") == full) & (F.col("hi") == full))


def unpack_leaves(masks: DataFrame) -> DataFrame:
    """`ix, iy, iz` of all voxels set in `masks`."""
    rows = masks.select(*BLOCK, "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("bit"))
    word = F.when(F.col("bit") < 32, F.col("lo")).otherwise(F.col("hi"))
    rows = rows.where(F.call_function("shiftrightunsigned", word, F.col("bit") % 32).bitwiseAND(F.lit(1)) == 1)
    part = lambda k: F.expr(f"bit div {LEAF**k} % {LEAF}").cast("bigint")
    return rows.select(*((F.col(b) * LEAF + part(k)).alias(c) for k, (b, c) in enumerate(zip(BLOCK, CELL))))


def block_kind(blocks: DataFrame, masks: DataFrame) -> DataFrame:
    """`blocks` (`kx, ky, kz`) with `kind`: 0 empty, 1 solid, 2 mixed."""
    kind = F.when(F.col("solid").isNull(), 0).when(F.col("solid"), 1).otherwise(2)
    return blocks.join(masks.select(*BLOCK, "solid"), BLOCK, "left").withColumn("kind", kind).drop("solid")


def is_solid(cells: DataFrame, masks: DataFrame) -> DataFrame:
    """`cells` (`ix, iy, iz`) with `is_solid`, looked up in packed leaves."""
    keyed = cells.select("*", *(_floor_div(F.col(c), LEAF).alias(b) for c, b in zip(CELL, BLOCK)), leaf_bit(*(F.col(c) for c in CELL)).alias("bit"))
    got = keyed.join(masks.select(*BLOCK, "lo", "hi"), BLOCK, "left")
    word = F.when(F.col("bit") < 32, F.col("lo")).otherwise(F.col("hi"))
    lit = F.call_function("shiftrightunsigned", word, F.col("bit") % 32).bitwiseAND(F.lit(1)) == 1
    return got.withColumn("is_solid", F.coalesce(lit, F.lit(False))).drop(*BLOCK, "bit", "lo", "hi")


def centres(voxels: DataFrame, grid: Grid) -> DataFrame:
    """`ix, iy, iz` with the cells' middle `x, y, z`."""
    mid = grid.low([F.col(c) for c in CELL]) + grid.size() * 0.5
    return voxels.select(*CELL, *mid.named(""))


def surface(voxels: DataFrame) -> DataFrame:
    """The voxels that have an empty one behind one of their six faces.

    Each voxel tells its neighbours that it's there: a voxel that hears from all six is inside. One aggregation by cell
    does what six anti-joins would.
    """
    told = F.array(F.struct(*(F.col(c) for c in CELL), F.lit(1).alias("own")), *(F.struct(*((F.col(c) + d).alias(c) for c, d in zip(CELL, step)), F.lit(0).alias("own")) for step in NEIGHBOURS))
    heard = voxels.select(F.explode(told).alias("v")).select("v.*").groupBy(CELL).agg(F.max("own").alias("own"), F.count(F.lit(1)).alias("n"))
    return heard.where("own = 1 AND n < 7").select(CELL)


def first_hit_down(rays: DataFrame, voxels: DataFrame, grid: Grid) -> DataFrame:
    """`ray_id, hit_y, t, iy` for rays (`ray_id, ox, oy, oz`) that go straight down: the first solid voxel below.

    A ray meets the voxels of its own column only, so this is an equi-join on the column and a minimum. A ray that starts
    inside a voxel hits at its start. Rays without a voxel below give no row.
    """
    ox, oy, oz = (F.col(c) for c in ("ox", "oy", "oz"))
    at = grid.index(Vec(ox, oy, oz))
    keyed = rays.select("ray_id", "oy", at[0].alias("ix"), at[2].alias("iz"))
    low = F.lit(grid.origin[1]) + F.col("iy") * F.lit(grid.cell[1])
    # The highest of a column's voxels is hit first; numbers keep the aggregation in hash tables.
    got = keyed.join(voxels.select(CELL), ["ix", "iz"]).where(low <= F.col("oy")).groupBy("ray_id").agg(F.max("iy").alias("iy"), F.max("oy").alias("oy"))
    top = F.lit(grid.origin[1]) + (F.col("iy") + 1) * F.lit(grid.cell[1])
    got = got.withColumn("t", F.greatest(F.col("oy") - top, F.lit(0.0)))
    return got.select("ray_id", (F.col("oy") - F.col("t")).alias("hit_y"), "t", "iy")


def _by_reach(capsules: DataFrame, grid: Grid) -> tuple[DataFrame, DataFrame]:
    """Capsules that reach less than a cell from their middle along each axis, and the rest. Without a size they meet nothing."""
    rows = capsules.select("capsule_id", *(F.col(c).cast("double") for c in CAPSULE[1:])).where("half_height IS NOT NULL AND radius IS NOT NULL")
    r, h = F.col("radius"), F.col("half_height")
    narrow = (r >= 0) & (h >= 0) & (r < NARROW * grid.cell[0]) & (r + h < NARROW * grid.cell[1]) & (r < NARROW * grid.cell[2])
    return rows.where(narrow), rows.where(~narrow)


def windows(voxels: DataFrame) -> DataFrame:
    """`kx, ky, kz, mask`: which voxels there are in each window that has some, as bits: z, then y, then x, two bits each.

    Windows are LEAF cells wide and begin with every second cell, so that three cells in a row always lie in one of them.
    """
    rows, bit = voxels.select(CELL), F.lit(0)
    for c, k in zip(CELL, BLOCK):
        half, odd = F.shiftright(c, 1), F.col(c).bitwiseAND(F.lit(1).cast("bigint"))
        rows = rows.withColumn(f"{k}w", F.explode(F.array(F.struct(half.alias("k"), odd.alias("at")), F.struct((half - 1).alias("k"), (odd + 2).alias("at")))))
    for k in reversed(BLOCK):
        bit = bit * LEAF + F.col(f"{k}w.at")
    lit = F.call_function("shiftleft", F.lit(1).cast("bigint"), bit.cast("int"))
    return rows.select(*(F.col(f"{k}w.k").alias(k) for k in BLOCK), lit.alias("mask")).groupBy(BLOCK).agg(F.bit_or("mask").alias("mask"))


def _lookup(voxels: DataFrame) -> DataFrame:
    """The voxels' windows, written; broadcast if they are few."""
    out = materialise(windows(voxels), "voxel-windows")
    return F.broadcast(out) if out.count() <= FEW_WINDOWS else out.hint("shuffle_hash")


def _with_window(capsules: DataFrame, lookup: DataFrame, grid: Grid) -> DataFrame:
    """Narrow capsules with `mask`, the window that begins at or just before the least cell that their boxes meet; 0 if it's empty."""
    r = F.col("radius")
    low = grid.index(Vec(F.col("x"), F.col("y"), F.col("z")) - Vec(r, r + F.col("half_height"), r))
    keyed = capsules.select("*", *(F.shiftright(v, 1).alias(k) for v, k in zip(low, BLOCK)))
    return keyed.join(lookup, BLOCK, "left").withColumn("mask", F.coalesce("mask", F.lit(0).cast("bigint"))).drop(*BLOCK)


def _window_pushes(b: pa.RecordBatch, grid: Grid) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Which capsules of a batch are pushed out of their windows' voxels, the deepest pushes' depths, vectors and cells.

    The steps are those of _cell_pushes() in the same order, so that pushes are the same to the last bit.
    """
    mask, *p, h, r = (b.column(c).to_numpy(zero_copy_only=False) for c in ("mask", *CAPSULE[1:]))
    live = np.flatnonzero((mask != 0) & np.isfinite(p).all(0))
    mask, h, r, p = mask[live], h[live], r[live], [v[live] for v in p]
    at = lambda sign: [np.floor((v + sign * e - o) / s).astype(np.int64) for v, e, o, s in zip(p, (r, r + h, r), grid.origin, grid.cell)]
    first, last = at(-1), at(1)
    depth, push, cell = np.full(len(live), PENETRATION), np.zeros((3, len(live))), np.zeros((3, len(live)), np.int64)
    for step in itertools.product(range(3), repeat=3):  # z, y, x: of equal depths the first stays
        step = step[::-1]
        bit = sum(((f & 1) + n) * LEAF**k for k, (f, n) in enumerate(zip(first, step)))
        own = np.flatnonzero((mask >> bit & 1 == 1) & np.all([f + n <= e for f, n, e in zip(first, step, last)], 0))
        if not len(own):
            continue
        q, high, rad, idx = [v[own] for v in p], h[own], r[own], [f[own] + n for f, n in zip(first, step)]
        lo = [o + i * s for i, o, s in zip(idx, grid.origin, grid.cell)]
        hi = [v + s for v, s in zip(lo, grid.cell)]
        bottom, top = q[1] - high, q[1] + high
        middle = np.maximum(bottom, np.minimum(top, (lo[1] + hi[1]) * 0.5))
        q[1] = np.where(top < lo[1], top, np.where(bottom > hi[1], bottom, middle))
        off = [v - np.maximum(a, np.minimum(c, v)) for v, a, c in zip(q, lo, hi)]
        d2 = off[0] * off[0] + off[1] * off[1] + off[2] * off[2]
        dist = np.sqrt(d2)
        way = [np.minimum(v - a, c - v) + rad for v, a, c in zip(q, lo, hi)]
        inside = d2 <= 1e-12
        deep = np.where(inside, np.minimum(np.minimum(way[0], way[1]), way[2]), rad - dist)
        better = (d2 < rad * rad) & (deep > depth[own])
        scale = (rad - dist) / np.where(inside, 1.0, dist)
        take_x = (way[0] <= way[1]) & (way[0] <= way[2])
        take_y = ~take_x & (way[1] <= way[2])
        for axis, taken in enumerate((take_x, take_y, ~take_x & ~take_y)):
            signed = np.where(q[axis] - lo[axis] < hi[axis] - q[axis], -way[axis], way[axis])
            push[axis, own[better]] = np.where(inside, np.where(taken, signed, 0.0), off[axis] * scale)[better]
            cell[axis, own[better]] = idx[axis][better]
        depth[own[better]] = deep[better]
    hit = depth > PENETRATION
    return live[hit], depth[hit], push[:, hit], cell[:, hit]


def _cell_pushes(capsules: DataFrame, voxels: DataFrame, grid: Grid) -> DataFrame:
    """`capsule_id, depth, px, py, pz, place`: pushes of capsules of any size, which are dealt to the cells that their boxes meet."""
    c = Vec(F.col("x"), F.col("y"), F.col("z"))
    r, h = F.col("radius"), F.col("half_height")
    reach = Vec(r, r + h, r)
    cells = [F.explode(F.sequence(a, b)) for a, b in zip(grid.index(c - reach), grid.index(c + reach))]
    rows = capsules
    for name, cell in zip(CELL, cells):
        rows = rows.withColumn(name, cell)
    # Spark takes the dealt capsules for as small as the capsules and would broadcast them; a shuffle by cell has no such bound.
    rows = rows.join(voxels.select(CELL).hint("shuffle_hash"), CELL)
    low = grid.low([F.col(n) for n in CELL])
    high = low + grid.size()
    bottom, top = c.y - h, c.y + h
    seg = F.when(top < low.y, top).when(bottom > high.y, bottom).otherwise(clamp((low.y + high.y) * 0.5, bottom, top))
    # Each step is a column of its own, so that the ones after it don't repeat its expression.
    rows = rows.select("capsule_id", "x", "z", "radius", *CELL, seg.alias("sy"), *low.named("a"), *high.named("b"))
    p, low, high = Vec(c.x, F.col("sy"), c.z), *(Vec(*(F.col(f"{k}{n}") for n in "xyz")) for k in "ab")
    off = p - Vec(*(clamp(v, a, b) for v, a, b in zip(p, low, high)))
    rows = rows.select("*", *off.named("o"))
    off = Vec(*(F.col(f"o{n}") for n in "xyz"))
    way = Vec(*(F.least(v - a, b - v) + r for v, a, b in zip(p, low, high)))
    rows = rows.select("*", off.dot(off).alias("d2"), *way.named("w"))
    d2, way = F.col("d2"), Vec(*(F.col(f"w{n}") for n in "xyz"))
    rows = rows.where(d2 < r * r).select("*", F.sqrt("d2").alias("dist"))
    out = off * ((r - F.col("dist")) / F.when(d2 > 1e-12, F.col("dist")))
    # A centre line inside a voxel leaves along the axis of the least way; x before y before z.
    signed = Vec(*(F.when(v - a < b - v, -w).otherwise(w) for v, a, b, w in zip(p, low, high, way)))
    zero = F.lit(0.0)
    take_x = (way.x <= way.y) & (way.x <= way.z)
    take_y = ~take_x & (way.y <= way.z)
    inside = d2 <= 1e-12
    push = Vec(
        F.when(~inside, out.x).when(take_x, signed.x).otherwise(zero),
        F.when(~inside, out.y).when(take_y, signed.y).otherwise(zero),
        F.when(~inside, out.z).when(~take_x & ~take_y, signed.z).otherwise(zero),
    )
    depth = F.when(~inside, r - F.col("dist")).otherwise(F.least(*way))
    place = F.shiftleft(F.col("iz") + SIDE, 42) + F.shiftleft(F.col("iy") + SIDE, 21) + F.col("ix") + SIDE
    return rows.select("capsule_id", depth.alias("depth"), *push.named("p"), place.alias("place")).where(F.col("depth") > PENETRATION)


def capsule_push(capsules: DataFrame, voxels: DataFrame, grid: Grid) -> DataFrame:
    """`capsule_id, px, py, pz, depth`: the deepest push that takes an upright capsule out of a voxel.

    `capsules`: `capsule_id, x, y, z, half_height, radius`. One that reaches less than a cell from its middle looks up one
    window of voxels and stays one row; each of the others is dealt to the cells that its box meets and joined to the voxels
    by cell. So nothing is compared that doesn't touch. Of equal depths the voxel first in order of z, y, x counts (cell
    numbers under 2^20). Pushes of PENETRATION or less don't; such capsules give no row.
    """
    narrow, wide = _by_reach(capsules, grid)
    out = T.StructType([capsules.schema["capsule_id"], *(T.StructField(c, T.DoubleType()) for c in ("depth", "px", "py", "pz")), T.StructField("place", T.LongType())])

    def pushed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hit, depth, push, cell = _window_pushes(b, grid)
            place = (cell[2] + SIDE << 42) + (cell[1] + SIDE << 21) + cell[0] + SIDE
            yield pa.RecordBatch.from_arrays([b.column("capsule_id").take(pa.array(hit)), *map(pa.array, (depth, *push, place))], names=out.names)

    pushes = _with_window(narrow.repartition(*CAPSULE), _lookup(voxels), grid).mapInArrow(pushed, out)
    if not wide.isEmpty():
        pushes = pushes.unionByName(_cell_pushes(wide, voxels, grid))
    return deepest(pushes, "place")


def deepest(pushes: DataFrame, tie: str) -> DataFrame:
    """`capsule_id, px, py, pz, depth`: each capsule's deepest push; of equal depths the one of least `tie`, a number.

    The depth is found first and then the push that has it, so that both are aggregated as plain numbers, in hash tables.
    """
    pushes = materialise(pushes, "pushes")
    most = pushes.groupBy("capsule_id").agg(F.max("depth").alias("depth"))
    return pushes.join(most, ["capsule_id", "depth"]).groupBy("capsule_id", "depth").agg(*(F.min_by(c, tie).alias(c) for c in ("px", "py", "pz"))).select("capsule_id", "px", "py", "pz", "depth")


def depenetrate(capsules: DataFrame, voxels: DataFrame, grid: Grid, rounds: int = 4) -> DataFrame:
    """`capsule_id, px, py, pz`: the total push of up to `rounds` deepest pushes, each after the ones before.

    A push doesn't undo an earlier one: its part against the direction of any of the first three pushes is taken out.
    Totals of PENETRATION or less give no row. Each row is pushed by itself, also where an id repeats or is null.

    Capsules that reach less than a cell from their middle stay one row in each round, as in capsule_push(), and nothing is
    dealt or grouped by capsule; a window's lookup is a broadcast while windows are few. CHAINED rounds go by without a
    written table. The others go through _by_cells().
    """
    narrow, wide = _by_reach(capsules, grid)
    lookup = _lookup(voxels)
    moved = ["x", "y", "z", "tx", "ty", "tz"]
    normals = [f"n{k}{a}" for k in range(3) for a in "xyz"]  # those that aren't there yet are zero and take nothing out
    state = narrow.repartition(*CAPSULE).select("*", *(F.lit(0.0).alias(c) for c in (*moved[3:], *normals)), F.lit(0).alias("known"))
    out = state.schema

    def pushed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hit, _, raw, _ = _window_pushes(b, grid)
            at = {c: b.column(c).to_numpy(zero_copy_only=False).copy() for c in (*moved, *normals, "known")}
            push = raw
            for k in range(3):
                n = np.array([at[f"n{k}{a}"][hit] for a in "xyz"])
                dot = np.minimum(push[0] * n[0] + push[1] * n[1] + push[2] * n[2], 0.0)
                push = push - dot * n
            size = np.sqrt(raw[0] * raw[0] + raw[1] * raw[1] + raw[2] * raw[2])
            more = (size > PENETRATION) & (at["known"][hit] < 3)
            for k in range(3):
                new = more & (at["known"][hit] == k)
                for j, a in enumerate("xyz"):
                    at[f"n{k}{a}"][hit[new]] = raw[j][new] / size[new]
            at["known"][hit[more]] += 1
            for j, a in enumerate("xyz"):
                at[a][hit] += push[j]
                at[f"t{a}"][hit] += push[j]
            yield pa.RecordBatch.from_arrays([pa.array(at[c]) if c in at else b.column(c) for c in out.names], names=out.names)

    for n in range(rounds):
        if n and n % CHAINED == 0:
            state = materialise(state, "capsule-state")
        state = _with_window(state, lookup, grid).mapInArrow(pushed, out)
    got = _totals(state)
    return got if wide.isEmpty() else got.unionByName(_by_cells(wide, voxels, grid, rounds))


def _totals(state: DataFrame) -> DataFrame:
    total = Vec(F.col("tx"), F.col("ty"), F.col("tz"))
    return state.where(total.dot(total) > PENETRATION**2).select("capsule_id", *(F.col(f"t{a}").alias(f"p{a}") for a in "xyz"))


def _by_cells(capsules: DataFrame, voxels: DataFrame, grid: Grid, rounds: int) -> DataFrame:
    """The rounds of depenetrate() for capsules of any size. Each round's state is written, so that plans don't grow."""
    voxels = materialise(voxels.select(CELL), "capsule-voxels")
    zero = F.lit(0.0)
    numbered = capsules.withColumnRenamed("capsule_id", "own_id").withColumn("capsule_id", F.monotonically_increasing_id())
    state = numbered.select("*", *(zero.alias(f"t{a}") for a in "xyz"), F.array().cast("array<struct<x:double,y:double,z:double>>").alias("normals"))
    state = materialise(state, "capsule-state")
    keep = state.columns
    for _ in range(rounds):
        hit = deepest(_cell_pushes(state.select(CAPSULE), voxels, grid), "place")
        state = state.join(hit, "capsule_id", "left")
        raw = F.struct(*(F.coalesce(F.col(f"p{a}"), zero).alias(a) for a in "xyz"))

        def against(acc: Column, n: Column) -> Column:
            dot = F.least(acc.x * n.x + acc.y * n.y + acc.z * n.z, zero)
            return F.struct(*((acc[a] - dot * n[a]).alias(a) for a in "xyz"))

        state = state.withColumn("raw", raw).withColumn("push", F.aggregate("normals", raw, against))
        size = F.sqrt(F.col("raw.x") * F.col("raw.x") + F.col("raw.y") * F.col("raw.y") + F.col("raw.z") * F.col("raw.z"))
        normal = F.struct(*((F.col(f"raw.{a}") / F.when(size > 0, size)).alias(a) for a in "xyz"))
        more = (size > PENETRATION) & (F.size("normals") < 3)
        state = state.withColumn("normals", F.when(more, F.array_append("normals", normal)).otherwise(F.col("normals")))
        for a in "xyz":
            state = state.withColumn(a, F.col(a) + F.col(f"push.{a}")).withColumn(f"t{a}", F.col(f"t{a}") + F.col(f"push.{a}"))
        state = materialise(state.select(keep), "capsule-state")
    return _totals(state.drop("capsule_id").withColumnRenamed("own_id", "capsule_id"))


def reachable(voxels: DataFrame, seed: tuple[int, int, int], low: tuple[int, int, int], high: tuple[int, int, int], max_rounds: int | None = None) -> DataFrame:
    """`ix, iy, iz, steps`: empty cells of the box that are reached from `seed` over faces, and in how many steps.

    A breadth-first search by joins; each front is written to the shared folder and the search ends with an empty one.
    """
    spark = voxels.sparkSession
    inside = lambda df: df.where(" AND ".join(f"{c} >= {a} AND {c} < {b}" for c, a, b in zip(CELL, low, high)))
    start = spark.range(1).select(*(F.lit(s).cast("bigint").alias(c) for c, s in zip(CELL, seed)), F.lit(0).alias("steps"))
    front = materialise(inside(start).join(voxels, CELL, "left_anti"), "front")
    seen = front
    n = 0
    while (max_rounds is None or n < max_rounds) and not front.isEmpty():
        n += 1
        step = F.explode(F.array(*(F.struct(*((F.col(c) + d).alias(c) for c, d in zip(CELL, s))) for s in NEIGHBOURS)))
        nxt = inside(front.select(step.alias("v")).select("v.*").distinct())
        front = materialise(nxt.join(voxels, CELL, "left_anti").join(seen, CELL, "left_anti").withColumn("steps", F.lit(n)), "front")
        seen = seen.unionByName(front)
        if n % 16 == 0:
            seen = materialise(seen, "seen")
    return seen


def blocked(voxels: DataFrame, radius: int, height: int) -> DataFrame:
    """`ix, iy, iz`: cells where an upright cylinder can't stand: `height` cells from there up, those within `radius` cells.

    A solid voxel blocks the cells below it that the cylinder would reach up from, and then the disc around each of them;
    what many voxels block is one row after each of the two steps. A radius of 0 and a height of 1 give the voxels.
    """
    disc = [(x, z) for x in range(-radius, radius + 1) for z in range(-radius, radius + 1) if x * x + z * z <= radius * radius]
    tall = voxels.select("ix", F.explode(F.sequence(F.col("iy") - (height - 1), F.col("iy"))).alias("iy"), "iz").distinct()
    around = F.explode(F.array(*(F.struct((F.col("ix") + x).alias("ix"), (F.col("iz") + z).alias("iz")) for x, z in disc))).alias("at")
    return tall.select("iy", around).select("at.ix", "iy", "at.iz").distinct()


def connected(solid: DataFrame, seed: tuple[int, int, int], low: tuple[int, int, int], high: tuple[int, int, int]) -> DataFrame:
    """`ix, iy, iz`: cells of the box without a row in `solid` that are connected with `seed` over faces.

    Empty cells are labelled within blocks of SIDE_CELLS cells a side, each block by itself; labels that touch over the
    blocks' faces are linked, and the links' components found in rounds as few as the logarithm of the way. A solid seed,
    or one outside the box, is connected with nothing. The box has 2^62 cells at most.
    """
    spark = solid.sparkSession
    size = [h - w for w, h in zip(low, high)]
    across = [-(-n // SIDE_CELLS) for n in size]
    if min(size) <= 0:
        return solid.select(CELL).limit(0)
    inside = solid.where(" AND ".join(f"{c} >= {a} AND {c} < {b}" for c, a, b in zip(CELL, low, high)))
    off = [F.col(c) - a for c, a in zip(CELL, low)]
    block = (F.floor(off[2] / SIDE_CELLS) * across[1] + F.floor(off[1] / SIDE_CELLS)) * across[0] + F.floor(off[0] / SIDE_CELLS)
    within = (off[2] % SIDE_CELLS * SIDE_CELLS + off[1] % SIDE_CELLS) * SIDE_CELLS + off[0] % SIDE_CELLS
    walls = inside.groupBy(block.cast("bigint").alias("block")).agg(F.collect_set(within.cast("int")).alias("walls"))  # a block's cells at most
    blocks = spark.range(math.prod(across)).withColumnRenamed("id", "block").join(walls, "block", "left")

    def labelled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place = np.arange(SIDE_CELLS**3).reshape((SIDE_CELLS,) * 3)  # z, y, x
        for b in batches:
            for k, w in zip(b["block"].tolist(), b["walls"]):
                at = [k % across[0], k // across[0] % across[1], k // across[0] // across[1]]
                free = np.ones(SIDE_CELLS**3, bool)
                if w is not None:
                    free[np.asarray(w, np.int64)] = False
                free = free.reshape(place.shape)
                for axis, a in ((2, 0), (1, 1), (0, 2)):  # beyond the box nothing is free
                    rest = size[a] - at[a] * SIDE_CELLS
                    free[(slice(None),) * axis + (slice(max(0, rest), None),)] = False
                pairs = []
                for axis in range(3):
                    one, two = ((slice(None),) * axis + (s,) for s in (slice(None, -1), slice(1, None)))
                    both = free[one] & free[two]
                    pairs.append((place[one][both], place[two][both]))
                node, root = contract(*(np.concatenate([p[i] for p in pairs]) for i in (0, 1)))
                label = place.ravel().copy()
                label[node] = root
                cells = np.flatnonzero(free.ravel())
                x, y, z = (at[i] * SIDE_CELLS + cells // SIDE_CELLS**i % SIDE_CELLS for i in range(3))
                lx, ly, lz = (at[i] * SIDE_CELLS + label[cells] // SIDE_CELLS**i % SIDE_CELLS for i in range(3))
                yield pd.DataFrame({"cell": (z * size[1] + y) * size[0] + x, "label": (lz * size[1] + ly) * size[0] + lx})

    cells = materialise(blocks.mapInPandas(labelled, "cell bigint, label bigint"), "free-cells")
    x, y, z = F.col("cell") % size[0], F.expr(f"cell div {size[0]}") % size[1], F.expr(f"cell div {size[0] * size[1]}")
    links = None
    for c, n, step in ((x, size[0], 1), (y, size[1], size[0]), (z, size[2], size[0] * size[1])):
        face = cells.where((c % SIDE_CELLS == SIDE_CELLS - 1) & (c < n - 1)).select((F.col("cell") + step).alias("cell"), F.col("label").alias("a"))
        links = face if links is None else links.unionByName(face)
    links = materialise(links.join(cells, "cell").select("a", F.col("label").alias("b")).distinct(), "face-links")
    below = forest(links, "free-forest")
    start = sum((s - a) * k for s, a, k in zip(seed, low, (1, size[0], size[0] * size[1]))) if all(a <= s < b for s, a, b in zip(seed, low, high)) else -1
    named = lambda df: df.join(below.select(F.col("node").alias("label"), F.col("label").alias("root")), "label", "left").withColumn("root", F.coalesce("root", "label"))
    home = named(cells.where(F.col("cell") == start)).first()
    found = named(cells).where(F.col("root") == (home.root if home else -1))
    return found.select(*((v + a).cast("bigint").alias(c) for v, a, c in zip((x, y, z), low, CELL)))


def median_height(hits: DataFrame, key: str, value: str = "hit_y") -> DataFrame:
    """`key, ground`: the exact median of each group's hits, the mean of the middle two for an even number."""
    return group_quantiles(hits, [key], value, {"ground": 0.5})

