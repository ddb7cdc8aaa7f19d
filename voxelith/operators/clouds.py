"""Transforms, filters, quantisation, ordering, merging and level-of-detail of Gaussian clouds."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelith.functions.vectors import Vec, quaternion_matrix
from voxelith.ordering import group_quantiles, in_groups, in_order
from voxelith.storage import materialise

XYZ = ["x", "y", "z"]
#: Rows of a chunk whose positions share a minimum and maximum.
CHUNK = 256


def sh_size(degree: int | Column) -> int | Column:
    """Number of higher-order coefficients of three colours up to this degree: 0, 9, 24, 45."""
    return ((degree + 1) * (degree + 1) - 1) * 3


def truncate_sh(splats: DataFrame, degree: int) -> DataFrame:
    """Keeps spherical harmonics up to `degree` (0 to 3)."""
    return splats.withColumn("sh", F.slice("sh", 1, F.lit(sh_size(degree)))).withColumn("sh_degree", F.least("sh_degree", F.lit(degree)))


def precalculate(sh_degree: Column, wanted: Column) -> Column:
    """Whether colours are precalculated: never without harmonics."""
    return F.when(sh_degree == 0, F.lit(False)).otherwise(wanted)


def transform(splats: DataFrame, matrix: list[float], row_major: bool = True, when: Column | None = None) -> DataFrame:
    """Moves centres by a 4 x 4 matrix, given by rows or columns, and scales extents by its uniform scale.

    Rotations (`qx..qw`) are turned by the matrix's own, if the cloud has them. With `when`, only those rows are moved.
    """
    m = matrix if row_major else [matrix[4 * c + r] for r in range(4) for c in range(4)]
    p = Vec(*(F.col(c) for c in XYZ))
    moved = {c: m[4 * i] * p.x + m[4 * i + 1] * p.y + m[4 * i + 2] * p.z + m[4 * i + 3] for i, c in enumerate(XYZ)}
    scale = abs(m[0] * (m[5] * m[10] - m[6] * m[9]) - m[1] * (m[4] * m[10] - m[6] * m[8]) + m[2] * (m[4] * m[9] - m[5] * m[8])) ** (1 / 3)
    if "sx" in splats.columns:
        moved |= {f"s{c}": F.col(f"s{c}") * scale for c in XYZ}
    if "qw" in splats.columns and scale:
        moved |= dict(zip(("qx", "qy", "qz", "qw"), _turn([v / scale for v in (m[0], m[1], m[2], m[4], m[5], m[6], m[8], m[9], m[10])])))
    if when is not None:
        moved = {c: F.when(when, v).otherwise(F.col(c)) for c, v in moved.items()}
    return splats.withColumns(moved)


def _turn(r: list[float]) -> list[Column]:
    """The rows' quaternions after the rotation matrix `r`."""
    # The quaternion of r: the eigenvector of the greatest eigenvalue of Bar-Itzhack's matrix.
    a = np.array(r).reshape(3, 3)
    k = np.array(
        [
            [a[0, 0] - a[1, 1] - a[2, 2], a[1, 0] + a[0, 1], a[2, 0] + a[0, 2], a[2, 1] - a[1, 2]],
            [a[1, 0] + a[0, 1], a[1, 1] - a[0, 0] - a[2, 2], a[2, 1] + a[1, 2], a[0, 2] - a[2, 0]],
            [a[2, 0] + a[0, 2], a[2, 1] + a[1, 2], a[2, 2] - a[0, 0] - a[1, 1], a[1, 0] - a[0, 1]],
            [a[2, 1] - a[1, 2], a[0, 2] - a[2, 0], a[1, 0] - a[0, 1], a[0, 0] + a[1, 1] + a[2, 2]],
        ]
    )
    q = np.linalg.eigh(k)[1][:, -1]
    x, y, z, w = (float(v) for v in q * (1 if q[3] >= 0 else -1))
    a_, b, c, d = (F.col(n) for n in ("qx", "qy", "qz", "qw"))
    return [w * a_ + x * d + y * c - z * b, w * b - x * c + y * d + z * a_, w * c + x * b - y * a_ + z * d, w * d - x * a_ - y * b - z * c]


def bitmap_indices(words: DataFrame, width: int = 32) -> DataFrame:
    """`idx`: the positions of the bits set in a bitmap, `pos, word` per word of `width` bits."""
    bits = words.select("pos", "word", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("bit"))
    return bits.where(F.call_function("shiftrightunsigned", "word", "bit").bitwiseAND(F.lit(1)) == 1).select((F.col("pos") * width + F.col("bit")).alias("idx"))


def delete_indices(splats: DataFrame, words: DataFrame, id_col: str = "splat_id", width: int = 32) -> DataFrame:
    """The splats whose ids aren't set in the bitmap."""
    return splats.join(bitmap_indices(words, width), F.col(id_col) == F.col("idx"), "left_anti")


def local_transforms(splats: DataFrame, moves: DataFrame, id_col: str = "splat_id") -> DataFrame:
    """Applies `moves` (`idx, ordinal, m` with 16 numbers by rows) to the centres of single splats, in order of `ordinal`."""
    per = moves.groupBy("idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "m"))), lambda s: s.m).alias("ms"))
    p0 = F.struct(*(F.col(c).alias(c) for c in XYZ))

    def step(p: Column, m: Column) -> Column:
        return F.struct(*((m[4 * i] * p.x + m[4 * i + 1] * p.y + m[4 * i + 2] * p.z + m[4 * i + 3]).alias(c) for i, c in enumerate(XYZ)))

    out = splats.join(per, splats[id_col] == per.idx, "left").withColumn("p", F.aggregate(F.coalesce("ms", F.array().cast("array<array<double>>")), p0, step))
    return out.withColumns({c: F.col(f"p.{c}") for c in XYZ}).drop("p", "ms", "idx")


def half(c: Column) -> Column:
    """The value rounded to a 16-bit float (normal and subnormal range, ties to even), as a double."""
    a = F.abs(c)
    e = F.greatest(F.floor(F.log2(F.when(a > 0, a))), F.lit(-14))
    ulp = F.pow(F.lit(2.0), e - 10)
    return F.when(a == 0, F.lit(0.0)).when(a > 65519.99, F.signum(c) * F.lit(float("inf"))).otherwise(F.signum(c) * F.bround(a / ulp, 0) * ulp)


def byte(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """The value as 0 to 255 of a range, halves upwards."""
    return F.greatest(F.lit(0), F.least(F.lit(255), F.floor((c - low) / (high - low) * 255 + 0.5).cast("int")))


def pack(splats: DataFrame, kind: str) -> DataFrame:
    """Rows at the precision of a pack type: `compressed` has positions in 32, scales, rotations and colours in 16 bits;
    `supercompressed` has positions in 16 bits and the others in 8 (rotations from -1 to 1, colours and opacity 0 to 1)."""
    q, rgb = ["qx", "qy", "qz", "qw"], ["r", "g", "b", "a"]
    if kind == "compressed":
        return splats.withColumns({c: F.col(c).cast("float").cast("double") for c in XYZ} | {c: half(F.col(c)) for c in [*(f"s{c}" for c in XYZ), *q, *rgb]})
    if kind == "supercompressed":
        return splats.withColumns({c: half(F.col(c)) for c in XYZ} | {f"s{c}": half(F.col(f"s{c}")) for c in XYZ} | {c: byte(F.col(c), -1, 1) for c in q} | {c: byte(F.col(c)) for c in rgb})
    raise ValueError(f"no such pack type: {kind}")


def quantise(splats: DataFrame, order: str = "splat_id", bits: int = 11, chunk: int = CHUNK) -> DataFrame:
    """`order, chunk` and `x, y, z` as integers of `bits` bits between the chunk's minimum and maximum.

    Chunks are runs of `chunk` ids. The chunks' bounds are aggregated and joined, so no chunk is sorted.
    """
    keyed = splats.select(order, F.expr(f"{order} div {chunk}").alias("chunk"), *XYZ)
    box = keyed.groupBy("chunk").agg(*(F.min(c).alias(f"{c}0") for c in XYZ), *(F.max(c).alias(f"{c}1") for c in XYZ))
    top = 2**bits - 1
    scaled = lambda c: F.when(F.col(f"{c}1") > F.col(f"{c}0"), F.floor((F.col(c) - F.col(f"{c}0")) / (F.col(f"{c}1") - F.col(f"{c}0")) * top + 0.5)).otherwise(F.lit(0)).cast("bigint")
    return keyed.join(box, "chunk").select(order, "chunk", *(scaled(c).alias(c) for c in XYZ))


def spread(c: Column, bits: int = 21) -> Column:
    """The low bits of an integer with two zeros after each."""
    out = c.bitwiseAND(F.lit(2**bits - 1).cast("bigint"))
    #: Masks of 64-bit Morton codes for three axes.
    for shift, mask in ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249)):
        out = out.bitwiseOR(F.shiftleft(out, shift)).bitwiseAND(F.lit(mask).cast("bigint"))
    return out


def morton(ix: Column, iy: Column, iz: Column) -> Column:
    """The Morton code of a cell with indices from 0: bits of x, y and z in turn, x lowest."""
    return spread(ix).bitwiseOR(F.shiftleft(spread(iy), 1)).bitwiseOR(F.shiftleft(spread(iz), 2))


def morton_sorted(splats: DataFrame, key: Column, partitions: int) -> DataFrame:
    """Rows in Morton order over all partitions: a range partitioning and a sort in each."""
    return splats.withColumn("morton", key).repartitionByRange(partitions, "morton").sortWithinPartitions("morton")


def quantile_box(points: DataFrame, low: float, high: float, by: list[str] | None = None) -> DataFrame:
    """Exact quantiles of each axis, per group: bounds that leave outliers out. An axis without values has null bounds."""
    by = by or []
    out = points.groupBy(*by).agg(F.count(F.lit(1)).alias("rows_"))
    keys = {k: f"{k}_of" for k in by}
    for c in XYZ:
        box = group_quantiles(points, by, c, {f"{c}0": low, f"{c}1": high}).withColumnsRenamed(keys)
        same = F.lit(True)
        for k, other in keys.items():
            same = same & F.col(k).eqNullSafe(F.col(other))
        out = out.join(box, same, "left").drop(*keys.values())
    return out.drop("rows_")


def exact_quantiles(df: DataFrame, column: str, shares: list[float]) -> list[float]:
    """Interpolated quantiles of a column, by its global order: only the rows at the wanted ranks come to the driver."""
    ordered, n, _ = in_order(df.select(column).where(F.col(column).isNotNull()), [F.col(column)], name="quantiles")
    if not n:
        return [math.nan] * len(shares)
    at = [(n - 1) * q for q in shares]
    ranks = sorted({r for p in at for r in (math.floor(p), min(math.floor(p) + 1, n - 1))})
    value = {r.pos: r[column] for r in ordered.where(F.col("pos").isin(ranks)).select("pos", column).collect()}
    return [value[math.floor(p)] + (value[min(math.floor(p) + 1, n - 1)] - value[math.floor(p)]) * (p - math.floor(p)) for p in at]


def forward_box(points: DataFrame, share: float = 0.8, steps: int = 64) -> DataFrame:
    """The smallest box of equal tails on each axis, of `steps` tails, that holds `share` of the points, with its `coverage`.

    The tail is found by bisection; each try counts the points inside. Points without a place leave an empty box.
    """
    tails = [i / (2 * steps) for i in range(steps)]
    edges = {c: exact_quantiles(points, c, [*tails, *(1 - t for t in tails)]) for c in XYZ}
    n = points.count()

    def held(i: int) -> int:
        inside = F.lit(True)
        for c, e in edges.items():
            inside = inside & F.col(c).between(e[i], e[steps + i])
        return points.where(inside).count()

    low, high, best = 0, steps - 1, n
    while low < high:
        mid = (low + high + 1) // 2
        k = held(mid)
        if k >= share * n:
            low, best = mid, k
        else:
            high = mid - 1
    cols = [F.lit(e[low + k * steps]).alias(f"{c}{k}") for c, e in edges.items() for k in (0, 1)]
    return points.sparkSession.range(1).select(*cols, F.lit(best / n if n else None).cast("double").alias("coverage"))


#: The entries of a covariance, by their axes.
COVARIANCE = [(0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2)]


def merged_moments(splats: DataFrame, by: list[str]) -> DataFrame:
    """`by, n, x, y, z, cxx, cxy, cxz, cyy, cyz, czz, r, g, b, a` of each group as one Gaussian: weights are opacities times volumes.

    Mean and covariance are those of the mixture: sum(w * (C + (p - m)(p - m)^T)) / sum(w), so the spread of the centres
    goes into the covariance. Opacity is 1 - prod(1 - a); colours are means. All are sums, taken in tasks first.
    """
    r = quaternion_matrix(tuple(F.col(c) for c in ("qx", "qy", "qz", "qw")))  # type: ignore[arg-type]
    own = {f"v{XYZ[i]}{XYZ[j]}": sum((r[3 * i + k] * r[3 * j + k] * F.col(f"s{XYZ[k]}") * F.col(f"s{XYZ[k]}") for k in range(3)), F.lit(0.0)) for i, j in COVARIANCE}
    w = F.greatest(F.col("a") * F.col("sx") * F.col("sy") * F.col("sz"), F.lit(1e-300))  # flat ones have no volume
    rows = splats.withColumn("w", w).withColumns(own)
    mean = lambda c: F.sum(F.col("w") * c) / F.sum("w")
    pairs = [(XYZ[i], XYZ[j]) for i, j in COVARIANCE]
    got = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        *(mean(F.col(c)).alias(c) for c in XYZ),
        *(mean(F.col(f"v{x}{y}") + F.col(x) * F.col(y)).alias(f"c{x}{y}") for x, y in pairs),
        *(mean(F.col(c)).alias(c) for c in "rgb"),
        (1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("a"), F.lit(1e-12)))))).alias("a"),
    )
    centred = {f"c{x}{y}": F.col(f"c{x}{y}") - F.col(x) * F.col(y) for x, y in pairs}
    return got.withColumns({k: F.greatest(v, F.lit(0.0)) if k[1] == k[2] else v for k, v in centred.items()})


def principal_axes(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(extents n x 3, quaternions n x 4 as x, y, z, w) of n covariances; the axes' order is the one nearest to x, y, z."""
    values, turns = np.linalg.eigh(c)
    orders = np.array([(0, 1, 2), (0, 2, 1), (1, 0, 2), (1, 2, 0), (2, 0, 1), (2, 1, 0)])
    kept = np.abs(turns[:, np.arange(3), :][:, np.arange(3)[None, :], orders]).sum(-1)  # how much stays of each axis
    order = orders[kept.argmax(1)]
    values = np.take_along_axis(values, order, 1)
    turns = np.take_along_axis(turns, order[:, None, :], 2)
    turns = turns * np.where(np.einsum("nii->ni", turns) < 0, -1.0, 1.0)[:, None, :]
    turns[np.linalg.det(turns) < 0, :, 2] *= -1
    # The largest of the quaternion's entries is a root, the others follow from it.
    d = np.einsum("nii->ni", turns)
    four = np.stack([1 + d[:, 0] - d[:, 1] - d[:, 2], 1 - d[:, 0] + d[:, 1] - d[:, 2], 1 - d[:, 0] - d[:, 1] + d[:, 2], 1 + d.sum(1)], 1)
    add = lambda i, j: turns[:, i, j] + turns[:, j, i]
    sub = lambda i, j: turns[:, i, j] - turns[:, j, i]
    table = np.stack([
        np.stack([four[:, 0], add(0, 1), add(0, 2), sub(2, 1)], 1),
        np.stack([add(0, 1), four[:, 1], add(1, 2), sub(0, 2)], 1),
        np.stack([add(0, 2), add(1, 2), four[:, 2], sub(1, 0)], 1),
        np.stack([sub(2, 1), sub(0, 2), sub(1, 0), four[:, 3]], 1),
    ], 1)
    q = table[np.arange(len(c)), four.argmax(1)]
    q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
    return np.sqrt(np.maximum(values, 0)), q * np.where(q[:, 3:] < 0, -1.0, 1.0)


def with_axes(moments: DataFrame) -> DataFrame:
    """`moments` with extents `sx, sy, sz` and a rotation `qx, qy, qz, qw` in place of the covariance, in batches.

    A covariance with an entry that is null or not finite has null extents and rotation.
    """
    new = ["sx", "sy", "sz", "qx", "qy", "qz", "qw"]
    names = [f"c{XYZ[i]}{XYZ[j]}" for i, j in COVARIANCE]

    @F.pandas_udf(", ".join(f"{n} double" for n in new))
    def axes(*columns: pd.Series) -> pd.DataFrame:
        flat = np.stack([c.to_numpy(np.float64, na_value=np.nan) for c in columns], 1)
        good = np.isfinite(flat).all(1)
        c = np.zeros((int(good.sum()), 3, 3))
        for k, (i, j) in enumerate(COVARIANCE):
            c[:, i, j] = c[:, j, i] = flat[good, k]
        out = np.full((len(flat), 7), np.nan)
        if len(c):
            out[good] = np.concatenate(principal_axes(c), 1)
        return pd.DataFrame(out, columns=new)  # NaN becomes null

    kept = [c for c in moments.columns if c not in names]
    return moments.withColumn("axes_", axes(*names)).select(*kept, "axes_.*")


def merge_gaussians(splats: DataFrame, by: list[str]) -> DataFrame:
    """One Gaussian per group with the mixture's mean and whole covariance, rotation included; see merged_moments()."""
    got = with_axes(merged_moments(splats, by))
    return got.select(*by, "n", *XYZ, *(f"s{c}" for c in XYZ), "qx", "qy", "qz", "qw", "r", "g", "b", "a")


def octree_chunks(codes: DataFrame, limit: int, depth: int, code: str = "morton") -> DataFrame:
    """`level, prefix, n`: octree chunks of at most `limit` rows, from Morton codes of `depth` levels.

    Counts are taken once, at the deepest level, and summed upwards; a chunk is a node within the limit whose parent isn't.
    Nodes at the deepest level stay as they are.
    """
    deep = materialise(codes.groupBy(F.col(code).alias("prefix")).agg(F.count(F.lit(1)).alias("n")), "octree-cells")
    out = None
    for level in range(depth + 1):
        up = 3 * (depth - level)
        node = deep.groupBy(F.shiftright("prefix", up).alias("prefix")).agg(F.sum("n").alias("n"))
        fits = node if level == depth else node.where(F.col("n") <= limit)
        if level:
            parent = deep.groupBy(F.shiftright("prefix", up + 3).alias("parent")).agg(F.sum("n").alias("pn")).where(F.col("pn") > limit)
            fits = fits.join(parent, F.shiftright("prefix", 3) == F.col("parent")).drop("parent", "pn")
        rows = fits.select(F.lit(level).alias("level"), "prefix", "n")
        out = rows if out is None else out.unionByName(rows)
    return out


#: Default precision and scale boost of the levels.
LEVELS = [(1.0, 1.0), (0.5, 1.0), (0.25, 1.0), (0.05, 1.01), (0.01, 1.02)]


def lod_target(n: Column, ratio: float | Column = 0.3, counts: Column | None = None) -> Column:
    """How many Gaussians a cloud is reduced to: both the share and the count are upper limits."""
    share = F.floor(n * ratio).cast("bigint")
    return F.least(share, counts) if counts is not None else share


def lod_reduce(splats: DataFrame, ratio: float, cell: float, counts: int | None = None, boost: float = 1.0) -> DataFrame:
    """Fewer Gaussians: those of a cell are merged, and cells doubled until there are as many as wanted at most (one is kept).

    Cells are counted from the cloud's least coordinates, so in the end one holds all. Larger cells are found from the
    cells of half their size, not from the cloud. Gaussians without a finite place are left out.
    """
    placed = splats.where(" AND ".join(f"abs({c}) < double('infinity')" for c in XYZ))
    n = placed.count()
    target = max(1, min(int(n * ratio), counts if counts is not None else n))
    low = placed.agg(*(F.min(c).alias(c) for c in XYZ)).first()
    at = {f"k{c}": F.floor((F.col(c) - F.lit(low[c])) / cell).cast("bigint") for c in XYZ}
    cells = materialise(placed.select(*(v.alias(k) for k, v in at.items())).distinct(), "lod-cells")
    halvings = 0
    while cells.count() > target:
        halvings += 1
        cells = materialise(cells.select(*(F.shiftright(k, 1).alias(k) for k in at)).distinct(), "lod-cells")
    keyed = placed.withColumns({k: F.shiftright(v, halvings) for k, v in at.items()})
    return merge_gaussians(keyed, list(at)).drop(*at).withColumns({f"s{c}": F.col(f"s{c}") * boost for c in XYZ})


def depth_order(splats: DataFrame, camera: tuple[float, float, float], forward: tuple[float, float, float], radial: bool = False) -> Column:
    """The sort key of a camera: distance from it, or depth along its direction."""
    d = Vec(*(F.col(c) - o for c, o in zip(XYZ, camera)))
    return d.length() if radial else d.dot(Vec(*(F.lit(f) for f in forward)))


def uniform_fit(points: DataFrame, height: float = 1.75, by: str | None = None) -> DataFrame:
    """`scale, tx, ty, tz`: a uniform scale to `height` and the move of the scaled bottom centre to the origin."""
    g = points.groupBy(*([by] if by else [])).agg(*(F.min(c).alias(f"{c}0") for c in XYZ), *(F.max(c).alias(f"{c}1") for c in XYZ))
    tall = F.col("y1") - F.col("y0")
    s = F.when(tall > 1e-9, height / tall)
    return g.select(*([by] if by else []), s.alias("scale"), (-(F.col("x0") + F.col("x1")) / 2 * s).alias("tx"), (-F.col("y0") * s).alias("ty"), (-(F.col("z0") + F.col("z1")) / 2 * s).alias("tz"))


def first_use(rows: DataFrame, obj: str, order: list[str]) -> DataFrame:
    """`rows` with `cloned`: whether a shared object was used before, in the order given."""
    return in_groups(rows, [obj], [F.col(c) for c in order], name="uses").withColumn("cloned", F.col("place") > 0).drop("place")
