"""Queries on the voxelised carrier cloud."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelith.functions.vectors import vec
from voxelith.operators import extents as E
from voxelith.operators import ray_paths as P
from voxelith.operators import voxels as V
from voxelith.plans.carriers import GRID, POINTS, SPLATS, VOXELS, points, splats, table, voxels
from voxelith.plans.registry import query

V_CTE = f"WITH v AS ({VOXELS})"
MASKS = f"""{V_CTE}, m AS (
  SELECT ix // 4 AS kx, iy // 4 AS ky, iz // 4 AS kz,
    bit_or(CASE WHEN bit < 32 THEN 1::BIGINT << bit ELSE 0 END) AS lo, bit_or(CASE WHEN bit >= 32 THEN 1::BIGINT << (bit - 32) ELSE 0 END) AS hi
  FROM (SELECT *, ((iz % 4) * 16 + (iy % 4) * 4 + ix % 4)::INT AS bit FROM v) GROUP BY ALL
)"""


@query(f"SELECT l_orderkey, l_linenumber, x, y, z, a FROM ({POINTS}) WHERE x BETWEEN 10 AND 30 AND y BETWEEN 5 AND 60 AND z BETWEEN 2 AND 8")
def voxel_box_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).where(V.in_box(vec(), (10, 5, 2), (30, 60, 8)))


@query(f"SELECT l_orderkey, l_linenumber, x, y, z, a FROM ({POINTS}) WHERE a >= 0.5")
def opacity_cull(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).where("a >= 0.5")


@query(VOXELS)
def voxel_occupancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voxels(spark, sf_dir)


@query(f"{MASKS} SELECT kx, ky, kz, lo, hi, lo = 4294967295 AND hi = 4294967295 AS solid FROM m")
def leaf_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.leaf_masks(voxels(spark, sf_dir))


@query(f"{V_CTE} SELECT ix, iy, iz FROM v")
def leaf_unpack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed and unpacked again: the voxels themselves."""
    return V.unpack_leaves(V.leaf_masks(voxels(spark, sf_dir)))


@query(
    f"""{MASKS}, q AS (SELECT a.range AS kx, b.range AS ky, c.range AS kz FROM range(4) a, range(6) b, range(3) c)
SELECT q.kx, q.ky, q.kz, CASE WHEN lo IS NULL THEN 0 WHEN lo = 4294967295 AND hi = 4294967295 THEN 1 ELSE 2 END AS kind FROM q LEFT JOIN m USING (kx, ky, kz)"""
)
def block_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    span = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
    blocks = spark.range(1).select(span(4).alias("kx")).select("kx", span(6).alias("ky")).select("kx", "ky", span(3).alias("kz"))
    return V.block_kind(blocks, V.leaf_masks(voxels(spark, sf_dir)))


@query(
    f"""{V_CTE}, q AS (SELECT o_orderkey, (o_custkey % 55)::DOUBLE AS x, o_totalprice / 4000 AS y, (o_orderkey % 12)::DOUBLE AS z FROM orders)
SELECT o_orderkey, floor(x / 5)::BIGINT AS ix, floor(y / 5)::BIGINT AS iy, floor(z / 2)::BIGINT AS iz, v.n IS NOT NULL AS is_solid
FROM q LEFT JOIN v ON floor(x / 5)::BIGINT = v.ix AND floor(y / 5)::BIGINT = v.iy AND floor(z / 2)::BIGINT = v.iz"""
)
def point_in_voxel(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 55).cast("double").alias("x"), (F.col("o_totalprice") / 4000).alias("y"), (F.col("o_orderkey") % 12).cast("double").alias("z"))
    cells = q.select("o_orderkey", *(c.alias(n) for c, n in zip(GRID.index(vec()), V.CELL)))
    return V.is_solid(cells, V.leaf_masks(voxels(spark, sf_dir)))


@query(f"{V_CTE} SELECT ix, iy, iz, ix * 5.0::DOUBLE + 2.5 AS x, iy * 5.0::DOUBLE + 2.5 AS y, iz * 2.0::DOUBLE + 1.0 AS z FROM v")
def solid_centers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.centres(voxels(spark, sf_dir), GRID)


@query(
    f"""{V_CTE}, c AS (SELECT v.ix, v.iy, v.iz, count(w.ix) AS faces FROM v
  LEFT JOIN v w ON abs(v.ix - w.ix) + abs(v.iy - w.iy) + abs(v.iz - w.iz) = 1 GROUP BY ALL)
SELECT ix, iy, iz FROM c WHERE faces < 6"""
)
def surface_voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.surface(voxels(spark, sf_dir))


DOWN = f"""{V_CTE}, r AS (SELECT DISTINCT ix * 100 + iz AS ray_id, ix * 5.0 + 2.5 AS ox, 200.0 AS oy, iz * 2.0 + 1.0 AS oz FROM v),
h AS (SELECT ray_id, iy, greatest(oy - (iy + 1) * 5.0, 0.0) AS t, oy FROM r JOIN v ON floor(ox / 5.0) = ix AND floor(oz / 2.0) = iz WHERE iy * 5.0 <= oy)"""


def _down_rays(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = voxels(spark, sf_dir).select("ix", "iz").distinct()
    return v.select((F.col("ix") * 100 + F.col("iz")).alias("ray_id"), (F.col("ix") * 5.0 + 2.5).alias("ox"), F.lit(200.0).alias("oy"), (F.col("iz") * 2.0 + 1.0).alias("oz"))


@query(f"{DOWN} SELECT ray_id, (min(oy) - min(t))::DOUBLE AS hit_y, min(t)::DOUBLE AS t, arg_min(iy, t) AS iy FROM h GROUP BY ray_id")
def ray_first_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.first_hit_down(_down_rays(spark, sf_dir), voxels(spark, sf_dir), GRID)


@query(
    f"""{DOWN}, g AS (SELECT ray_id, min(oy) - min(t) AS hit_y FROM h GROUP BY ray_id)
SELECT ray_id // 100 AS row_id, quantile_cont(hit_y::DOUBLE, 0.5) AS ground FROM g GROUP BY 1"""
)
def ground_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = V.first_hit_down(_down_rays(spark, sf_dir), voxels(spark, sf_dir), GRID)
    return V.median_height(hits.withColumn("row_id", F.expr("ray_id div 100")), "row_id")


#: Slanted rays whose starts and slopes keep them off cell borders, one for each order.
RAYS = """SELECT o_orderkey AS ray_id, 1.37 + o_custkey % 25 * 1.913 + o_orderkey % 1000 * 0.0031 AS ox, 119.3 AS oy, 0.71 + o_custkey % 25 * 0.317 AS oz,
  0.0913 + o_orderkey % 100 * 0.0017 AS dx, -1.0 AS dy, 0.0371 - o_orderkey % 77 * 0.0007 AS dz, 150.0 AS max_t FROM orders"""


@query(
    f"""{V_CTE}, r AS (SELECT ray_id, ox::DOUBLE AS ox, oy::DOUBLE AS oy, oz::DOUBLE AS oz, dx::DOUBLE AS dx, dy::DOUBLE AS dy, dz::DOUBLE AS dz, max_t::DOUBLE AS max_t FROM ({RAYS})
), s AS (
  SELECT ray_id, ix, iy, iz, max_t,
    greatest(least((ix * 5 - ox) / dx, (ix * 5 + 5 - ox) / dx), least((iy * 5 - oy) / dy, (iy * 5 + 5 - oy) / dy), least((iz * 2 - oz) / dz, (iz * 2 + 2 - oz) / dz), 0) AS near,
    least(greatest((ix * 5 - ox) / dx, (ix * 5 + 5 - ox) / dx), greatest((iy * 5 - oy) / dy, (iy * 5 + 5 - oy) / dy), greatest((iz * 2 - oz) / dz, (iz * 2 + 2 - oz) / dz)) AS far
  FROM r, v
), h AS (SELECT *, row_number() OVER (PARTITION BY ray_id ORDER BY near) AS k FROM s WHERE near < far AND near <= max_t)
SELECT ray_id, round(near, 6) AS t, ix, iy, iz FROM h WHERE k = 1"""
)
def ray_march(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first voxel that a ray of each order meets, in the box of all voxels."""
    k, c = F.col("o_orderkey"), F.col("o_custkey") % 25
    slanted = {"ox": 1.37 + c * 1.913 + k % 1000 * 0.0031, "oy": F.lit(119.3), "oz": 0.71 + c * 0.317, "dx": 0.0913 + k % 100 * 0.0017, "dy": F.lit(-1.0), "dz": 0.0371 - k % 77 * 0.0007, "max_t": F.lit(150.0)}
    rays = table(spark, sf_dir, "orders").select(k.alias("ray_id"), *(v.alias(n) for n, v in slanted.items()))
    v = voxels(spark, sf_dir).select(V.CELL)
    box = v.agg(*(F.min(n).alias(f"{n}0") for n in V.CELL), *((F.max(n) + 1).alias(f"{n}1") for n in V.CELL)).first()
    low, high = (tuple(box[f"{n}{e}"] for n in V.CELL) for e in (0, 1))
    if None in low:
        return P.first_hit(rays, v, GRID, (0, 0, 0), (0, 0, 0))
    return P.first_hit(rays, v, GRID, low, high).withColumn("t", F.round("t", 6))


CAPSULES = """SELECT o_orderkey AS capsule_id, (o_custkey % 55)::DOUBLE + 0.37 AS x, o_totalprice / 4000 AS y, (o_orderkey % 12)::DOUBLE + 0.21 AS z, 1.5::DOUBLE AS half_height, 0.8::DOUBLE AS radius
FROM orders"""


def _capsules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("capsule_id"),
        ((F.col("o_custkey") % 55).cast("double") + 0.37).alias("x"),
        (F.col("o_totalprice") / 4000).alias("y"),
        ((F.col("o_orderkey") % 12).cast("double") + 0.21).alias("z"),
        F.lit(1.5).alias("half_height"),
        F.lit(0.8).alias("radius"),
    )


@query(
    f"""{V_CTE}, c AS ({CAPSULES}), e AS (
  SELECT capsule_id, x, z, y - half_height AS bot, y + half_height AS top, radius AS r, ix, iy, iz, ix * 5.0::DOUBLE AS x0, iy * 5.0::DOUBLE AS y0, iz * 2.0::DOUBLE AS z0
  FROM c JOIN v ON ix BETWEEN floor((x - radius) / 5) AND floor((x + radius) / 5) AND iy BETWEEN floor((y - (radius + half_height)) / 5) AND floor((y + (radius + half_height)) / 5)
    AND iz BETWEEN floor((z - radius) / 2) AND floor((z + radius) / 2)
), s AS (SELECT *, CASE WHEN top < y0 THEN top WHEN bot > y0 + 5 THEN bot ELSE greatest(bot, least(top, (y0 + y0 + 5) * 0.5)) END AS sy FROM e
), n AS (SELECT *, x - greatest(x0, least(x0 + 5, x)) AS dx, sy - greatest(y0, least(y0 + 5, sy)) AS dy, z - greatest(z0, least(z0 + 2, z)) AS dz FROM s
), d AS (SELECT *, dx * dx + dy * dy + dz * dz AS d2, least(x - x0, x0 + 5 - x) + r AS wx, least(sy - y0, y0 + 5 - sy) + r AS wy, least(z - z0, z0 + 2 - z) + r AS wz FROM n
), p AS (
  SELECT capsule_id, ix, iy, iz, CASE WHEN d2 > 1e-12 THEN r - sqrt(d2) ELSE least(wx, wy, wz) END AS depth,
    CASE WHEN d2 > 1e-12 THEN dx * ((r - sqrt(d2)) / sqrt(d2)) WHEN wx <= wy AND wx <= wz THEN CASE WHEN x - x0 < x0 + 5 - x THEN -wx ELSE wx END ELSE 0 END AS px,
    CASE WHEN d2 > 1e-12 THEN dy * ((r - sqrt(d2)) / sqrt(d2)) WHEN wx <= wy AND wx <= wz THEN 0 WHEN wy <= wz THEN CASE WHEN sy - y0 < y0 + 5 - sy THEN -wy ELSE wy END ELSE 0 END AS py,
    CASE WHEN d2 > 1e-12 THEN dz * ((r - sqrt(d2)) / sqrt(d2)) WHEN (wx <= wy AND wx <= wz) OR wy <= wz THEN 0 ELSE CASE WHEN z - z0 < z0 + 2 - z THEN -wz ELSE wz END END AS pz
  FROM d WHERE d2 < r * r
), k AS (SELECT *, row_number() OVER (PARTITION BY capsule_id ORDER BY depth DESC, iz, iy, ix) AS nth FROM p WHERE depth > 1e-4)
SELECT capsule_id, round(px, 6) AS px, round(py, 6) AS py, round(pz, 6) AS pz, round(depth, 6) AS depth FROM k WHERE nth = 1"""
)
def capsule_pushout(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = V.capsule_push(_capsules(spark, sf_dir), voxels(spark, sf_dir), GRID)
    return got.select("capsule_id", *((F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("px", "py", "pz", "depth")))


@query()
def capsule_depenetration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.depenetrate(_capsules(spark, sf_dir), voxels(spark, sf_dir), GRID)


def _reached(solid: str) -> str:
    """SQL: cells without a row in `solid` that a flood from outside reaches, in the voxels' box and a cell around it."""
    return f"""{V_CTE.replace("WITH", "WITH RECURSIVE")}, w AS ({solid}), x AS (SELECT min(ix) - 1 AS x0, max(ix) + 1 AS x1, min(iy) - 1 AS y0, max(iy) + 1 AS y1, min(iz) - 1 AS z0, max(iz) + 1 AS z1 FROM v), f(ix, iy, iz) AS (
  SELECT x0, y1, z0 FROM x LEFT JOIN w ON w.ix = x0 AND w.iy = y1 AND w.iz = z0 WHERE w.ix IS NULL
  UNION SELECT n.ix, n.iy, n.iz FROM (
    SELECT f.ix + d.dx AS ix, f.iy + d.dy AS iy, f.iz + d.dz AS iz FROM f, (VALUES (1,0,0),(-1,0,0),(0,1,0),(0,-1,0),(0,0,1),(0,0,-1)) d(dx, dy, dz)
  ) n JOIN x ON n.ix BETWEEN x0 AND x1 AND n.iy BETWEEN y0 AND y1 AND n.iz BETWEEN z0 AND z1 LEFT JOIN w ON n.ix = w.ix AND n.iy = w.iy AND n.iz = w.iz
  WHERE w.ix IS NULL
) SELECT ix, iy, iz FROM f"""


def _flooded(spark: SparkSession, sf_dir: str, radius: int, height: int) -> DataFrame:
    v = voxels(spark, sf_dir).select(V.CELL)
    box = v.agg(*((F.min(n) - 1).alias(f"{n}0") for n in V.CELL), *((F.max(n) + 2).alias(f"{n}1") for n in V.CELL)).first()
    low, high = (tuple(box[f"{n}{e}"] for n in V.CELL) for e in (0, 1))
    if None in low:
        return v.limit(0)
    return V.connected(V.blocked(v, radius, height), (low[0], high[1] - 1, low[2]), low, high)


@query(_reached("SELECT ix, iy, iz FROM v"))
def nav_reachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Empty cells that are reached from above the voxels' box."""
    return _flooded(spark, sf_dir, 0, 1)


@query(_reached("SELECT DISTINCT ix + dx AS ix, iy - h AS iy, iz + dz AS iz FROM v, (VALUES (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) d(dx, dz), range(3) r(h)"))
def nav_capsule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a walker three cells tall and a cell around comes to from above."""
    return _flooded(spark, sf_dir, 1, 3)


EXTENTS = V.Grid(cell=(0.125, 0.125, 0.25))
_TURN = ["1 - 2 * (qy * qy + qz * qz)", "2 * (qx * qy - qz * qw)", "2 * (qx * qz + qy * qw)", "2 * (qx * qy + qz * qw)", "1 - 2 * (qx * qx + qz * qz)", "2 * (qy * qz - qx * qw)", "2 * (qx * qz - qy * qw)", "2 * (qy * qz + qx * qw)", "1 - 2 * (qx * qx + qy * qy)"]
_COV = {f"v{i}{j}": " + ".join(f"({_TURN[3 * i + k]}) * ({_TURN[3 * j + k]}) * s{'xyz'[k]} * s{'xyz'[k]}" for k in range(3)) for i in range(3) for j in range(i, 3)}
_V = lambda i, j: f"v{min(i, j)}{max(i, j)}"


def _nearest_sql() -> str:
    """The least Mahalanobis distance of a cell, squared: coordinates at an end `b` of the cell or free, 27 cases."""
    cases = ["CASE WHEN b00 <= 0 AND b01 >= 0 AND b10 <= 0 AND b11 >= 0 AND b20 <= 0 AND b21 >= 0 THEN 0 END"]
    for i in range(3):
        j, k = (i + 1) % 3, (i + 2) % 3
        cases += [f"CASE WHEN b{i}{e} * {_V(i, j)} / v{i}{i} BETWEEN b{j}0 AND b{j}1 AND b{i}{e} * {_V(i, k)} / v{i}{i} BETWEEN b{k}0 AND b{k}1 THEN b{i}{e} * b{i}{e} / v{i}{i} END" for e in (0, 1)]
        for e, f in ((0, 0), (0, 1), (1, 0), (1, 1)):
            det = f"(v{j}{j} * v{k}{k} - {_V(j, k)} * {_V(j, k)})"
            first, second = (f"(b{j}{e} * {_V(k, k)} - b{k}{f} * {_V(j, k)}) / {det}", f"(b{k}{f} * {_V(j, j)} - b{j}{e} * {_V(j, k)}) / {det}")
            cases.append(f"CASE WHEN {_V(i, j)} * {first} + {_V(i, k)} * {second} BETWEEN b{i}0 AND b{i}1 THEN b{j}{e} * {first} + b{k}{f} * {second} END")
    inverse = {(i, j): f"({_V((i + 1) % 3, (j + 1) % 3)} * {_V((i + 2) % 3, (j + 2) % 3)} - {_V((i + 1) % 3, (j + 2) % 3)} * {_V((i + 2) % 3, (j + 1) % 3)})" for i in range(3) for j in range(3)}
    det = " + ".join(f"v0{j} * {inverse[0, j]}" for j in range(3))
    for e in ((a, b, c) for a in (0, 1) for b in (0, 1) for c in (0, 1)):
        cases.append("(" + " + ".join(f"b{i}{e[i]} * b{j}{e[j]} * {inverse[i, j]}" for i in range(3) for j in range(3)) + f") / ({det})")
    return f"least({', '.join(cases)})"


@query(
    f"""WITH g AS (SELECT splat_id, a, x, y, z, {", ".join(f"{c} AS {n}" for n, c in _COV.items())} FROM ({SPLATS}) WHERE a >= 0.3),
c AS (SELECT g.*, unnest(range(floor((x - 2 * sqrt(v00)) / {EXTENTS.cell[0]})::BIGINT, floor((x + 2 * sqrt(v00)) / {EXTENTS.cell[0]})::BIGINT + 1)) AS ix FROM g),
d AS (SELECT c.*, unnest(range(floor((y - 2 * sqrt(v11)) / {EXTENTS.cell[1]})::BIGINT, floor((y + 2 * sqrt(v11)) / {EXTENTS.cell[1]})::BIGINT + 1)) AS iy FROM c),
e AS (SELECT d.*, unnest(range(floor((z - 2 * sqrt(v22)) / {EXTENTS.cell[2]})::BIGINT, floor((z + 2 * sqrt(v22)) / {EXTENTS.cell[2]})::BIGINT + 1)) AS iz FROM d),
f AS (SELECT *, {", ".join(f"(i{c} + {e}) * {s}::DOUBLE - {c} AS b{i}{e}" for i, (c, s) in enumerate(zip("xyz", EXTENTS.cell)) for e in (0, 1))} FROM e)
SELECT ix, iy, iz, count(*) AS n, round(max(a), 6) AS opacity FROM f WHERE {_nearest_sql()} <= 4 GROUP BY ALL"""
)
def voxel_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that the Gaussians meet within two standard deviations."""
    return E.extent_occupancy(splats(spark, sf_dir), EXTENTS, 2.0, 0.3).withColumn("opacity", F.round("opacity", 6))
