"""Triangles: world transforms, precomputed edges and normals, bounds, ray hits and nearest points."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelith.functions.vectors import Vec, vec
from voxelith.operators.ray_paths import FLAT, Rays
from voxelith.operators.voxels import Grid, deepest
from voxelith.storage import discard, materialise

#: Cells of the finest level, the cells that a triangle's box is wide at most, and the waves in which rays go through them.
CELL_SIZE, ACROSS, WAVES = 1.0, 4, 4
#: Share of a cell by which cells overlap, so that rounding loses nothing.
NEAR = 1e-9
CORNERS = ["ka", "kb", "kc"]


def f32(v: Vec) -> Vec:
    """Rounded to 32-bit floats and back."""
    return Vec(*(c.cast("float").cast("double") for c in v))


def soup(meshes: DataFrame) -> DataFrame:
    """`mesh_id, tri_id, kax..kcz` from `mesh_id, positions array<double>, idx array<int>, world array<double>(16, by columns)`.

    Without an index the corners come in order. `tri_id` counts within the mesh. Meshes without positions give no rows.
    """
    n = F.expr("size(positions) div 3")
    idx = F.coalesce(F.when(F.size("idx") > 0, F.col("idx").cast("array<bigint>")), F.sequence(F.lit(0).cast("bigint"), F.greatest(n - 1, F.lit(0)).cast("bigint")))
    rows = meshes.where("size(positions) >= 9").select("mesh_id", "positions", "world", idx.alias("i"))
    rows = rows.select("mesh_id", "positions", "world", "i", F.explode(F.sequence(F.lit(0), F.expr("size(i) div 3 - 1").cast("int"))).alias("tri_id"))

    def corner(k: int) -> list[Column]:
        at = F.get("i", F.col("tri_id") * 3 + k).cast("int")
        p = [F.get("positions", at * 3 + j) for j in range(3)]
        w = F.col("world")
        return [(w[j] * p[0] + w[4 + j] * p[1] + w[8 + j] * p[2] + w[12 + j]).cast("float").cast("double") for j in range(3)]

    return rows.select("mesh_id", "tri_id", *(c.alias(f"{n}{a}") for k, n in enumerate(CORNERS) for c, a in zip(corner(k), "xyz")))


def prepared(tris: DataFrame) -> DataFrame:
    """`tris` with edges `e1*, e2*` and unit normals `n*`, rounded to 32 bits; a flat triangle's normal is zero."""
    a, b, c = (vec(n) for n in CORNERS)
    e1, e2 = f32(b - a), f32(c - a)
    n = e1.cross(e2)
    size = F.when(n.length() == 0, F.lit(1.0)).otherwise(n.length())
    return tris.select("*", *e1.named("e1"), *e2.named("e2"), *f32(Vec(*(v / size for v in n))).named("n"))


def boxes(tris: DataFrame) -> DataFrame:
    """`tris` with the bounds `x0..z1` of each triangle."""
    low = [F.least(*(F.col(f"{n}{a}") for n in CORNERS)).alias(f"{a}0") for a in "xyz"]
    high = [F.greatest(*(F.col(f"{n}{a}") for n in CORNERS)).alias(f"{a}1") for a in "xyz"]
    return tris.select("*", *low, *high)


def ray_t(o: Vec, d: Vec, a: Vec, b: Vec, c: Vec) -> Column:
    """Where the ray meets the triangle, from either side, in lengths of `d`; null if it doesn't."""
    e1, e2 = b - a, c - a
    p = d.cross(e2)
    det = e1.dot(p)
    safe = F.when(F.abs(det) >= 1e-10, det)
    t0 = o - a
    u = t0.dot(p) / safe
    q = t0.cross(e1)
    v = d.dot(q) / safe
    t = e2.dot(q) / safe
    return F.when((u >= 0) & (u <= 1) & (v >= 0) & (u + v <= 1) & (t >= 0), t)


def dealt(tris: DataFrame, cell: float = CELL_SIZE, across: int = ACROSS) -> DataFrame:
    """`level, kx, ky, kz` and `tris` with bounds: each triangle in the cells that it meets, at the level that fits it.

    Cells of a level are twice as large as those of the one below; level 0 has cells of `cell`. A triangle belongs to the
    first level in which its box is at most `across` cells wide, so it's in a bounded number of cells however large it is.
    Cells of its box that its plane doesn't touch are left out. Triangles with a corner that isn't finite are in none.
    """
    t = boxes(tris).where(" AND ".join(f"abs({n}{a}) < double('infinity')" for n in CORNERS for a in "xyz"))
    wide = F.greatest(*(F.col(f"{a}1") - F.col(f"{a}0") for a in "xyz"))
    level = F.greatest(F.lit(0), F.ceil(F.log2(F.when(wide > 0, wide) / (cell * across)))).cast("int")
    t = t.withColumn("level", F.coalesce(level, F.lit(0))).withColumn("size_", F.lit(cell) * F.pow(F.lit(2.0), F.col("level")))
    for a in "xyz":
        low, high = (F.floor((F.col(f"{a}{e}") + side * NEAR * F.col("size_")) / F.col("size_")).cast("bigint") for e, side in ((0, -1), (1, 1)))
        t = t.withColumn(f"k{a}", F.explode(F.sequence(low, high)))
    # The plane passes a cell if its distance from the middle is within the cell's half diagonal along the normal.
    a, b, c = (vec(n) for n in CORNERS)
    t = t.select("*", *(b - a).cross(c - a).named("m"))
    m, half = vec("m"), F.col("size_") * (0.5 + NEAR)
    middle = Vec(*((F.col(f"k{k}") + 0.5) * F.col("size_") for k in "xyz"))
    reach = (F.abs(m.x) + F.abs(m.y) + F.abs(m.z)) * half
    return t.where(F.abs(m.dot(middle - a)) <= reach * (1 + NEAR)).drop("mx", "my", "mz", "size_")


def _levels(t: DataFrame) -> list[int]:
    """The levels in use: not more than a number has exponents."""
    return sorted(r.level for r in t.select("level").distinct().collect())


KEY = ["level", "kx", "ky", "kz"]
#: Rows of a cell, on either side, that meet in one piece at most (about), and rows and pairs of a group of pieces.
PIECE, GROUP_ROWS, GROUP_PAIRS = 2048, 20_000, 20_000_000
#: Pairs that numpy looks at in one step.
PAIRS = 1 << 17


def in_pieces(left: DataFrame, right: DataFrame, left_id: str, right_id: str, meet: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame | None], kinds: str) -> DataFrame:
    """What `meet` says of each pair of pieces of `left` and `right`, written tables with the columns KEY, in the same cell.

    A cell's rows are cut by their ids into pieces of about PIECE rows, and each piece of one side meets each of the other:
    every pair of rows of a cell is in one call of `meet`, and no call grows with a cell. Pairs are never rows. `meet` may get
    a pair of pieces of different cells, if their hashes are equal.
    """
    count = lambda df, n: df.groupBy(KEY).agg(F.count(F.lit(1)).alias(n))
    cells = count(left, "n_").join(count(right, "m_"), KEY)
    cells = materialise(cells.select(*KEY, "n_", "m_", F.ceil(F.col("n_") / PIECE).alias("a_n"), F.ceil(F.col("m_") / PIECE).alias("b_n")), "mesh-pieces")
    told = cells.agg(F.sum(F.col("n_") * F.col("b_n") + F.col("m_") * F.col("a_n")).alias("rows"), F.sum(F.col("n_").cast("double") * F.col("m_")).alias("pairs")).first()
    n = max(1, (told.rows or 0) // GROUP_ROWS, int(told.pairs or 0) // GROUP_PAIRS)

    def cut(df: DataFrame, key: str, own: str, other: str) -> DataFrame:
        rows = df.join(cells.select(*KEY, "a_n", "b_n"), KEY)
        rows = rows.withColumn(own, F.pmod(F.xxhash64(key), F.col(f"{own}n"))).withColumn(other, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(f"{other}n") - 1)))
        rows = rows.withColumn("piece", F.xxhash64(*KEY, "a_", "b_")).drop("a_", "b_", "a_n", "b_n")
        return rows.withColumn("group_", F.pmod("piece", F.lit(n)))

    def run(some: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        parts = {k: v for k, v in other.groupby("piece", sort=False)}
        out = [meet(v, parts[k]) for k, v in some.groupby("piece", sort=False) if k in parts]
        out = [o for o in out if o is not None and len(o)]
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame(columns=names)

    names = [k.split()[0] for k in kinds.split(", ")]
    return cut(left, left_id, "a_", "b_").groupBy("group_").cogroup(cut(right, right_id, "b_", "a_").groupBy("group_")).applyInPandas(run, kinds)


def _corners(b: pd.DataFrame) -> list[list[np.ndarray]]:
    return [[b[f"{n}{a}"].to_numpy(float) for a in "xyz"] for n in CORNERS]


def _cross(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def _dot(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def _minus(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    return [p - q for p, q in zip(a, b)]


def _rays_meet(rays: pd.DataFrame, tris: pd.DataFrame) -> pd.DataFrame:
    """`ray_id, near, t, tri_id`: the nearest of `tris` on each of `rays`; the same arithmetic as ray_t()."""
    tris = tris.sort_values("tri_id")
    a, b, c = _corners(tris)
    e1, e2 = _minus(b, a), _minus(c, a)
    o, d = ([rays[f"{n}{x}"].to_numpy(float)[:, None] for x in "xyz"] for n in "od")
    most = rays["max_t"].to_numpy(float)
    ray, tri, at = [], [], []
    step = max(1, PAIRS // max(1, len(tris)))
    with np.errstate(all="ignore"):
        for k in range(0, len(rays), step):
            o_, d_ = [v[k : k + step] for v in o], [v[k : k + step] for v in d]
            p = _cross(d_, e2)
            det = _dot(e1, p)
            u = _dot(_minus(o_, a), p) / det
            i, j = np.nonzero((np.abs(det) >= 1e-10) & (u >= 0) & (u <= 1))
            u, det, t0 = u[i, j], det[i, j], [q[i, 0] - w[j] for q, w in zip(o_, a)]
            q = _cross(t0, [w[j] for w in e1])
            v = _dot([w[i, 0] for w in d_], q) / det
            t = _dot([w[j] for w in e2], q) / det + 0.0
            keep = (v >= 0) & (u + v <= 1) & (t >= 0) & (t <= most[k + i])
            ray.append(k + i[keep])
            tri.append(j[keep])
            at.append(t[keep])
    ray, tri, at = np.concatenate(ray), np.concatenate(tri), np.concatenate(at)
    order = np.lexsort((tri, at, ray))
    order = order[np.r_[True, ray[order][1:] != ray[order][:-1]]] if len(order) else order
    return pd.DataFrame({c: rays[c].to_numpy()[ray[order]] for c in ("ray_id", "near")} | {"t": at[order], "tri_id": tris["tri_id"].to_numpy()[tri[order]]})


def first_hit(rays: DataFrame, tris: DataFrame, cell: float = CELL_SIZE, waves: int = WAVES) -> DataFrame:
    """`ray_id, t, tri_id`: the nearest triangle on each ray (`ray_id, ox.., dx.., max_t`) and the distance to it.

    Directions are made unit vectors; rays shorter than 1e-8 or not finite hit nothing. Of equal distances the least tri_id
    counts. `ray_id` is unique.

    Triangles lie in cells of several sizes, see dealt(). Rays go through the cells of each size in waves, each twice as
    long as the one before, from where they enter the box of all triangles, and meet the triangles of their cells. A ray
    whose nearest hit is within its waves so far is done; one with a farther hit goes no further than that.
    """
    size = vec("d").length()
    finite = F.lit(True)
    for c in ("ox", "oy", "oz", "dx", "dy", "dz"):
        finite = finite & (F.abs(c) < float("inf"))
    r = rays.where((size >= 1e-8) & finite & (F.col("max_t") >= 0))
    left = r.select("ray_id", *(F.col(f"o{a}").cast("double") for a in "xyz"), *((F.col(f"d{a}") / size).alias(f"d{a}") for a in "xyz"), F.col("max_t").cast("double"))
    corners = [f"{n}{a}" for n in CORNERS for a in "xyz"]
    t = materialise(dealt(tris, cell), "mesh-cells")
    box = t.agg(*(f(f"{a}{e}").alias(f"{a}{e}") for a in "xyz" for e, f in ((0, F.min), (1, F.max)))).first()
    none = left.select("ray_id", F.lit(0.0).alias("t"), F.lit(None).cast(t.schema["tri_id"].dataType).alias("tri_id")).where("false")
    if box.x0 is None:
        return none
    t = t.select(*KEY, "tri_id", *corners)
    # Where a ray enters the box and leaves it, with a margin for rounding.
    pad = NEAR * max(cell, *(abs(v) for v in box))
    sides = [((F.lit(box[f"{a}0"] - pad) - F.col(f"o{a}")) / F.col(f"d{a}"), (F.lit(box[f"{a}1"] + pad) - F.col(f"o{a}")) / F.col(f"d{a}"), F.abs(f"d{a}") > FLAT) for a in "xyz"]
    near = F.greatest(F.lit(0.0), *(F.when(on, F.least(p, q)).otherwise(0.0) for p, q, on in sides))
    far = F.least("max_t", *(F.when(on, F.greatest(p, q)).otherwise(float("inf")) for p, q, on in sides))
    left = left.withColumns({"near": near * (1 - NEAR), "far": far * (1 + NEAR)})
    left = materialise(left.where("near <= far"), "mesh-rays")
    longest = left.agg(F.max(F.col("far") - F.col("near"))).first()[0]
    if longest is None:
        return none
    levels = _levels(t)
    grids = [(lv, Grid((0.0,) * 3, (cell * 2.0**lv,) * 3)) for lv in levels]
    edge = [tuple(math.floor((box[f"{a}{e}"] + s * NEAR * g.cell[0]) / g.cell[0]) + e for a in "xyz") for _, g in grids for e, s in ((0, -1), (1, 1))]

    def cut(start: float, stop: float):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                begin = b["near"] + start
                some = b.assign(**{f"o{a}": b[f"o{a}"] + b[f"d{a}"] * begin for a in "xyz"}, max_t=np.minimum(b["far"], (b["near"] + stop) * (1 + NEAR)) - begin)
                for k, (level, grid) in enumerate(grids):
                    ray, _, _, _, at = Rays(some, grid, edge[2 * k], edge[2 * k + 1]).path(1, 0, 1 << 62)
                    out = b.iloc[ray].reset_index(drop=True)
                    yield out.assign(level=level, **{f"k{a}": at[:, i] for i, a in enumerate("xyz")})

        return run

    key, tri = (df.schema[n].dataType.simpleString() for df, n in ((left, "ray_id"), (t, "tri_id")))
    kinds = f"ray_id {key}, " + ", ".join(f"{c} double" for c in ("ox", "oy", "oz", "dx", "dy", "dz", "max_t", "near", "far")) + ", level int, kx bigint, ky bigint, kz bigint"
    found = best = None
    for w in range(waves):
        start, stop = (longest * ((1 << k) - 1) / ((1 << waves) - 1) for k in (w, w + 1))
        passed = materialise(left.mapInPandas(cut(start, stop), kinds).drop("far"), "mesh-passed")
        hits = in_pieces(passed, t, "ray_id", "tri_id", _rays_meet, f"ray_id {key}, near double, t double, tri_id {tri}")
        if best is not None:
            hits = hits.unionByName(best)
        got = materialise(hits.groupBy("ray_id", "near").agg(F.min(F.struct("t", "tri_id")).alias("m")).select("ray_id", "near", "m.t", "m.tri_id"), "mesh-nearest")
        last, reached = w == waves - 1, F.col("near") + stop
        done = got if last else got.where(F.col("t") <= reached)
        found = done if found is None else found.unionByName(done)
        if last:
            break
        best = got.where(F.col("t") > reached)
        on = left.join(got.select("ray_id", F.col("t").alias("t_")), "ray_id", "left").where(F.col("t_").isNull() | (F.col("t_") > reached))
        on = on.where(F.col("far") > reached).withColumns({"max_t": F.least("max_t", "t_"), "far": F.least("far", F.col("t_") * (1 + NEAR))}).drop("t_")
        rest = materialise(on, "mesh-rays")
        discard(left, passed)
        left = rest
        if left.isEmpty():
            found = found.unionByName(best)
            break
    return found.select("ray_id", "t", "tri_id")


def nearest(rows: DataFrame, point: str, out: str) -> DataFrame:
    """`rows`, which have a triangle and a point, with the triangle's point nearest to it in `<out>x, <out>y, <out>z`.

    The same as closest_on_triangle(), with the products that decide the region as columns of their own.
    """
    p, (a, b, c) = vec(point), [vec(n) for n in CORNERS]
    keep = [n for n in rows.columns if n not in {f"{out}{k}" for k in "xyz"}]
    rows = rows.withColumns({f"d{i + 1}_": e.dot(p - k) for i, (e, k) in enumerate((e, k) for k in (a, b, c) for e in (b - a, c - a))})
    d1, d2, d3, d4, d5, d6 = (F.col(f"d{i}_") for i in range(1, 7))
    rows = rows.withColumns({"va_": d3 * d6 - d5 * d4, "vb_": d5 * d2 - d1 * d6, "vc_": d1 * d4 - d3 * d2})
    va, vb, vc = (F.col(n) for n in ("va_", "vb_", "vc_"))
    region = (
        F.when((d1 <= 0) & (d2 <= 0), 0).when((d3 >= 0) & (d4 <= d3), 1).when((vc <= 0) & (d1 >= 0) & (d3 <= 0), 2).when((d6 >= 0) & (d5 <= d6), 3)
        .when((vb <= 0) & (d2 >= 0) & (d6 <= 0), 4).when((va <= 0) & (d4 - d3 >= 0) & (d5 - d6 >= 0), 5).otherwise(6)
    )
    rows = rows.withColumn("region_", region)
    # The point as a + s (b - a) + t (c - a).
    over = lambda n, d: n / F.when(d != 0, d)
    at = lambda v: F.when(F.col("region_").isin(0), v[0]).when(F.col("region_") == 1, v[1]).when(F.col("region_") == 2, v[2]).when(F.col("region_") == 3, v[3]).when(F.col("region_") == 4, v[4]).when(F.col("region_") == 5, v[5]).otherwise(v[6])
    far = over(d4 - d3, d4 - d3 + d5 - d6)
    zero, one, total = F.lit(0.0), F.lit(1.0), va + vb + vc
    rows = rows.withColumns({"s_": at([zero, one, over(d1, d1 - d3), zero, zero, 1 - far, over(vb, total)]), "t_": at([zero, zero, zero, one, over(d2, d2 - d6), far, over(vc, total)])})
    q = a + (b - a) * F.col("s_") + (c - a) * F.col("t_")
    return rows.select(*keep, *q.named(out))


def _nearest_points(p: list[np.ndarray], a: list[np.ndarray], b: list[np.ndarray], c: list[np.ndarray]) -> list[np.ndarray]:
    """nearest() for arrays of points and triangles."""
    ab, ac = _minus(b, a), _minus(c, a)
    d1, d2, d3, d4, d5, d6 = (_dot(e, q) for q in (_minus(p, k) for k in (a, b, c)) for e in (ab, ac))
    va, vb, vc = d3 * d6 - d5 * d4, d5 * d2 - d1 * d6, d1 * d4 - d3 * d2
    zero, one, total, far = np.zeros(len(d1)), np.ones(len(d1)), va + vb + vc, (d4 - d3) / (d4 - d3 + d5 - d6)
    region = [(d1 <= 0) & (d2 <= 0), (d3 >= 0) & (d4 <= d3), (vc <= 0) & (d1 >= 0) & (d3 <= 0), (d6 >= 0) & (d5 <= d6), (vb <= 0) & (d2 >= 0) & (d6 <= 0), (va <= 0) & (d4 - d3 >= 0) & (d5 - d6 >= 0)]
    s = np.select(region, [zero, one, d1 / (d1 - d3), zero, zero, 1 - far], vb / total)
    t = np.select(region, [zero, zero, zero, one, d2 / (d2 - d6), far], vc / total)
    return [k + e * s + f * t for k, e, f in zip(a, ab, ac)]


def _capsules_meet(reach: float, samples: int):
    """Gives the function that finds, for a piece of capsules and one of triangles, each capsule's deepest push."""

    def rejects(tris: pd.DataFrame) -> tuple[np.ndarray, list[np.ndarray]]:
        """Unit normals with the plane's offset (4 x m), and for each edge, seen along Y, how far inside of it (3 x m) a point is."""
        a, b, c = _corners(tris)
        n = _cross(_minus(b, a), _minus(c, a))
        size = np.sqrt(_dot(n, n))
        scale = np.max([np.abs(v) for k in (a, b, c) for v in k], 0)
        n = [np.where(size > 1e-6 * scale**2, v / size, 0.0) for v in n]  # planes and edges that rounding may turn reject nothing
        area = (b[0] - a[0]) * (c[2] - a[2]) - (b[2] - a[2]) * (c[0] - a[0])
        sign = np.where(np.abs(area) > 1e-9 * scale**2, np.sign(area), 0.0)
        edges = []
        for p, q in ((a, b), (b, c), (c, a)):
            ex, ez = q[0] - p[0], q[2] - p[2]
            long = np.hypot(ex, ez)
            w = np.where(long > 1e-9 * scale, sign / long, 0.0)
            edges.append(np.stack([-ez * w, ex * w, (ez * p[0] - ex * p[2]) * w]))
        return np.stack([*n, -_dot(n, a)]), edges

    def meet(caps: pd.DataFrame, tris: pd.DataFrame) -> pd.DataFrame | None:
        tris = tris.sort_values("tri_id")
        a, b, c = _corners(tris)
        unit = [tris[f"n{k}"].to_numpy(float) for k in "xyz"]
        x, y, z, half, radius = (caps[k].to_numpy(float) for k in ("x", "y", "z", "half_height", "radius"))
        most = radius * reach
        slack = 1e-9 * (1 + np.abs(np.stack([x, y, z])).max(0) + half + radius)
        # The part of the middle line that is near the cell: what touches a triangle elsewhere does so in another cell.
        low, high = np.maximum(y - half, caps["low"] - most - slack), np.minimum(y + half, caps["high"] + most + slack)
        low, high = np.minimum(low, y + half).to_numpy(float), np.maximum(high, y - half).to_numpy(float)
        least = most.copy()
        own, tri, dist, push = [], [], [], []
        with np.errstate(all="ignore"):
            plane, edges = rejects(tris)
            flat = np.stack([x, z, np.ones(len(x))], 1)
            line = np.stack([x, low, z, np.ones(len(x))], 1)
            step = max(1, PAIRS // max(1, len(caps)))
            for k in range(0, len(tris), step):
                part = slice(k, k + step)
                bound = (least + slack)[:, None]
                h0 = line @ plane[:, part]
                h1 = h0 + plane[1, part] * (high - low)[:, None]
                off = (np.minimum(h0, h1) > bound) | (np.maximum(h0, h1) < -bound)
                for e in edges:
                    off |= flat @ e[:, part] < -bound
                i, j = np.nonzero(~off)
                if not len(i):
                    continue
                j = j + k
                at = [[v[j] for v in w] for w in (a, b, c)]
                d2 = np.full(len(i), np.inf)
                best = [np.zeros(len(i)) for _ in range(6)]
                for nth in range(samples + 1):
                    p = [x[i], y[i] + half[i] * (nth * (2.0 / samples) - 1.0), z[i]]
                    q = _nearest_points(p, *at)
                    o = _minus(p, q)
                    now = _dot(o, o)
                    nearer = now < d2
                    d2 = np.where(nearer, now, d2)
                    best = [np.where(nearer, v, w) for v, w in zip([*p, *q], best)]
                # The line's point nearest to the sample's point on the triangle.
                up = (y + half - (y - half))[i]
                part_y = np.where(up * up < 1e-20, 0.0, np.clip((best[4] - (y - half)[i]) * up / (up * up), 0.0, 1.0))
                g = [x[i], (y - half)[i] + up * part_y, z[i]]
                h = _nearest_points(g, *at)
                o = _minus(g, h)
                better = _dot(o, o) < d2
                o = [np.where(better, v, p - q) for v, p, q in zip(o, best[:3], best[3:])]
                d = np.sqrt(_dot(o, o))
                keep = (d < radius[i]) & (radius[i] - d > 1e-4)
                i, j, d, o = i[keep], j[keep], d[keep], [v[keep] for v in o]
                np.minimum.at(least, i, d)
                keep = radius[i] - d >= radius[i] - least[i]
                i, j, d, o = i[keep], j[keep], d[keep], [v[keep] for v in o]
                depth = radius[i] - d
                own.append(i)
                tri.append(j)
                dist.append(depth)
                push.append(np.stack([np.where(d > 1e-10, v / d, n[j]) * depth for v, n in zip(o, unit)]))
        if not own:
            return None
        own, tri, depth, push = np.concatenate(own), np.concatenate(tri), np.concatenate(dist), np.concatenate(push, 1)
        order = np.lexsort((tri, -depth, own))
        order = order[np.r_[True, own[order][1:] != own[order][:-1]]] if len(order) else order
        told = {"capsule_id": caps["capsule_id"].to_numpy()[own[order]], "tri_id": tris["tri_id"].to_numpy()[tri[order]], "depth": depth[order]}
        return pd.DataFrame(told | {f"p{k}": push[n][order] for n, k in enumerate("xyz")})

    return meet


#: The share of a capsule's radius that its middle line looks around itself first; see capsule_push().
CLOSE = 1 / 16


def capsule_push(capsules: DataFrame, tris: DataFrame, cell: float = CELL_SIZE, samples: int = 5) -> DataFrame:
    """`capsule_id, px, py, pz, depth`: the deepest push that takes an upright capsule out of a triangle.

    Near points of the capsule's middle line and the triangle are the best of evenly spaced samples, refined once by the
    line's point nearest to the sample's point on the triangle. The push is along their difference, or the triangle's
    normal where they coincide. Pushes of 1e-4 or less give no row; of equal depths the least tri_id counts. `capsule_id` is
    unique.

    Capsules look up the cells that the boxes around their middle lines meet at each level of dealt(): first at a small
    share of the radius, and those that have no push by a triangle so close again at the whole radius. No triangle farther
    from the line than that gives a deeper push.
    """
    t = materialise(dealt(prepared(tris), cell), "mesh-cells")
    levels = _levels(t)
    t = t.select(*KEY, "tri_id", "nx", "ny", "nz", *(f"{n}{a}" for n in CORNERS for a in "xyz"))
    left = materialise(capsules.select("capsule_id", *(F.col(c).cast("double") for c in ("x", "y", "z", "half_height", "radius"))), "capsules")
    key, tri = (df.schema[n].dataType.simpleString() for df, n in ((left, "capsule_id"), (t, "tri_id")))
    found = None
    for share in (CLOSE, 1.0):
        c = left.select("*", F.explode(F.array(*map(F.lit, levels)).cast("array<int>")).alias("level"))
        c = c.withColumn("size_", F.lit(cell) * F.pow(F.lit(2.0), F.col("level")))
        reach = F.col("radius") * share * (1 + NEAR)
        for a, r in (("x", reach), ("y", F.col("half_height") + reach), ("z", reach)):
            c = c.withColumn(f"k{a}", F.explode(F.sequence(*(F.floor((F.col(a) + side * r) / F.col("size_")).cast("bigint") for side in (-1, 1)))))
        c = c.withColumns({"low": F.col("ky") * F.col("size_"), "high": (F.col("ky") + 1) * F.col("size_")}).drop("size_")
        looked = materialise(c, "capsule-cells")
        got = in_pieces(looked, t, "capsule_id", "tri_id", _capsules_meet(share, samples), f"capsule_id {key}, tri_id {tri}, depth double, px double, py double, pz double")
        if share < 1:
            got = got.join(left.select("capsule_id", "radius"), "capsule_id").where(F.col("depth") > F.col("radius") * (1 - share)).drop("radius")
        got = materialise(deepest(got, "tri_id"), "capsule-pushes")
        found = got if found is None else found.unionByName(got)
        rest = materialise(left.join(got, "capsule_id", "left_anti"), "capsules") if share < 1 else left
        discard(left, looked)
        left = rest
    discard(t)
    return found
