"""Queries on Gaussian clouds, meshes and manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelith.functions import vectors as X
from voxelith.operators import chunk_lod
from voxelith.operators import clouds as C
from voxelith.operators import manifests as L
from voxelith.operators import meshes as M
from voxelith.ordering import in_groups, in_order
from voxelith.plans.carriers import POINTS, SPLATS, points, splats, table
from voxelith.plans.registry import SQL, query

R6 = lambda names: ", ".join(f"round({n}, 6) AS {n}" for n in names)


def r6(df: DataFrame, keep: list[str], names: list[str]) -> DataFrame:
    return df.select(*keep, *((F.round(n, 6) + F.lit(0.0)).alias(n) for n in names))


@query(f"SELECT splat_id, list_slice(sh, 1, 9) AS sh, 1 AS sh_degree FROM ({SPLATS})")
def sh_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.truncate_sh(splats(spark, sf_dir), 1).select("splat_id", "sh", "sh_degree")


@query(f"SELECT splat_id, source_id % 4 AS sh_degree, CASE WHEN source_id % 4 = 0 THEN false ELSE source_id % 2 = 0 END AS precalculate FROM ({SPLATS})")
def sh_zero_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("source_id") % 4
    return splats(spark, sf_dir).select("splat_id", d.alias("sh_degree"), C.precalculate(d, F.col("source_id") % 2 == 0).alias("precalculate"))


#: Half a turn about Y with scale 2, then a move; by rows.
MATRIX = [-2.0, 0, 0, 1.5, 0, 2.0, 0, -3.0, 0, 0, -2.0, 0.25, 0, 0, 0, 1.0]


@query(
    f"""SELECT splat_id, {R6(["x", "y", "z", "sx", "sy", "sz"])} FROM (
  SELECT splat_id, -2 * x + 1.5 AS x, 2 * y - 3 AS y, -2 * z + 0.25 AS z, 2 * sx AS sx, 2 * sy AS sy, 2 * sz AS sz FROM ({SPLATS}))"""
)
def model_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(C.transform(splats(spark, sf_dir), MATRIX), ["splat_id"], ["x", "y", "z", "sx", "sy", "sz"])


BITMAP = "SELECT range AS pos, (range * 2654435761 % 4294967296)::BIGINT AS word FROM range(16)"


@query(
    f"""WITH i AS (SELECT pos * 32 + b.range AS idx FROM ({BITMAP}) w, range(32) b WHERE (word >> b.range) & 1 = 1)
SELECT splat_id, source_id FROM ({SPLATS}) WHERE splat_id NOT IN (SELECT idx FROM i)"""
)
def delete_by_bitmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spark.range(16).select(F.col("id").alias("pos"), (F.col("id") * 2654435761 % 4294967296).alias("word"))
    return C.delete_indices(splats(spark, sf_dir), words).select("splat_id", "source_id")


@query(
    f"""SELECT splat_id, {R6(["x", "y", "z"])} FROM (SELECT splat_id,
  CASE WHEN splat_id % 5 = 0 THEN -(y + 1) WHEN splat_id % 5 = 1 THEN x * 2 ELSE x END AS x,
  CASE WHEN splat_id % 5 = 0 THEN x WHEN splat_id % 5 = 1 THEN y * 2 ELSE y END AS y, CASE WHEN splat_id % 5 = 1 THEN z * 2 ELSE z END AS z FROM ({SPLATS}))"""
)
def local_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth splat is lifted and then turned, the next ones are doubled: two matrices on one index keep their order."""
    s = splats(spark, sf_dir)
    lit = lambda m: F.array(*(F.lit(float(v)) for v in m))
    lift = lit([1, 0, 0, 0, 0, 1, 0, 1, 0, 0, 1, 0, 0, 0, 0, 1])
    turn = lit([0, -1, 0, 0, 1, 0, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1])
    double = lit([2, 0, 0, 0, 0, 2, 0, 0, 0, 0, 2, 0, 0, 0, 0, 1])
    ids = s.select(F.col("splat_id").alias("idx"))
    moves = ids.where("idx % 5 = 0").select("idx", F.lit(0).alias("ordinal"), lift.alias("m")).unionByName(ids.where("idx % 5 = 0").select("idx", F.lit(1).alias("ordinal"), turn.alias("m")))
    moves = moves.unionByName(ids.where("idx % 5 = 1").select("idx", F.lit(2).alias("ordinal"), double.alias("m")))
    return r6(C.local_transforms(s, moves), ["splat_id"], ["x", "y", "z"])


@query(
    f"""SELECT splat_id, {", ".join(f"greatest(0, least(255, floor(({c} - ({lo})) / ({hi} - ({lo})) * 255 + 0.5)))::INT AS {c}" for c, lo, hi in [(q, -1, 1) for q in ("qx", "qy", "qz", "qw")] + [(k, 0, 1) for k in "rgba"])}
FROM ({SPLATS})"""
)
def pack_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.pack(splats(spark, sf_dir), "supercompressed").select("splat_id", "qx", "qy", "qz", "qw", "r", "g", "b", "a")


def _half_sql(c: str) -> str:
    ulp = f"pow(2.0, greatest(floor(log2(abs({c}))), -14) - 10)"
    return f"CASE WHEN {c} = 0 THEN 0.0 ELSE sign({c}) * round_even(abs({c}) / {ulp}, 0) * {ulp} END AS {c}"


@query(f"SELECT splat_id, {', '.join(_half_sql(c) for c in ('sx', 'sy', 'sz', 'qx', 'qy', 'qz', 'qw', 'r', 'g', 'b', 'a'))} FROM ({SPLATS})")
def pack_half(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.pack(splats(spark, sf_dir), "compressed").select("splat_id", "sx", "sy", "sz", "qx", "qy", "qz", "qw", "r", "g", "b", "a")


@query(
    f"""WITH s AS (SELECT splat_id, splat_id // 256 AS chunk, x, y, z FROM ({SPLATS})),
b AS (SELECT chunk, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, min(z) AS z0, max(z) AS z1 FROM s GROUP BY chunk)
SELECT splat_id, chunk, {", ".join(f"CASE WHEN {c}1 > {c}0 THEN floor(({c} - {c}0) / ({c}1 - {c}0) * 2047 + 0.5) ELSE 0 END::BIGINT AS {c}" for c in "xyz")} FROM s JOIN b USING (chunk)"""
)
def minmax_quantise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.quantise(splats(spark, sf_dir))


def _spread_sql(c: str, bits: int = 10) -> str:
    return " | ".join(f"((({c} >> {i}) & 1) << {3 * i})" for i in range(bits))


CELLS = "floor(x)::BIGINT AS ix, floor(y)::BIGINT AS iy, floor(z)::BIGINT AS iz"
MORTON = f"SELECT *, ({_spread_sql('ix')}) | (({_spread_sql('iy')}) << 1) | (({_spread_sql('iz')}) << 2) AS morton FROM (SELECT *, {CELLS} FROM ({POINTS}))"


@query(f"SELECT l_orderkey, l_linenumber, ix, iy, iz, morton FROM ({MORTON})")
def morton_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = points(spark, sf_dir).select("l_orderkey", "l_linenumber", *(F.floor(c).cast("bigint").alias(f"i{c}") for c in "xyz"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return C.morton_sorted(cells, C.morton(F.col("ix"), F.col("iy"), F.col("iz")), n)


@query(
    f"""WITH m AS (SELECT morton FROM ({MORTON})), n AS (SELECT l.range AS level, morton >> (3 * (7 - l.range))::INT AS prefix, count(*) AS n FROM m, range(8) l GROUP BY ALL)
SELECT n.level::INT AS level, n.prefix, n.n::BIGINT AS n FROM n LEFT JOIN n p ON p.level = n.level - 1 AND p.prefix = n.prefix >> 3
WHERE (n.level = 7 OR n.n <= 2000) AND (n.level = 0 OR p.n > 2000)"""
)
def octree_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of at most 2000 points over seven levels."""
    codes = points(spark, sf_dir).select(C.morton(*(F.floor(c).cast("bigint") for c in "xyz")).alias("morton"))
    return C.octree_chunks(codes, 2000, 7)


@query(f"SELECT source_id, {', '.join(f'quantile_cont({c}, {q}) AS {c}{k}' for c in 'xyz' for k, q in ((0, 0.02), (1, 0.98)))} FROM ({SPLATS}) GROUP BY source_id")
def outlier_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.quantile_box(splats(spark, sf_dir), 0.02, 0.98, ["source_id"])


@query(
    f"""WITH s AS (SELECT source_id, x, y, z FROM ({SPLATS})),
b AS (SELECT source_id, {', '.join(f'quantile_cont({c}, {q}) AS {c}{k}' for c in 'xyz' for k, q in ((0, 0.05), (1, 0.95)))} FROM s GROUP BY source_id)
SELECT source_id, count(*) AS n FROM s JOIN b USING (source_id) WHERE x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 AND z BETWEEN z0 AND z1 GROUP BY source_id"""
)
def outliers_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = splats(spark, sf_dir).select("source_id", "x", "y", "z")
    box = C.quantile_box(s, 0.05, 0.95, ["source_id"])
    inside = F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1")) & F.col("z").between(F.col("z0"), F.col("z1"))
    return s.join(box, "source_id").where(inside).groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))


def _tails() -> str:
    return ", ".join(f"quantile_cont({c}, [{', '.join(str(i / 128) for i in range(64))}]) AS {c}l, quantile_cont({c}, [{', '.join(str(1 - i / 128) for i in range(64))}]) AS {c}h" for c in "xyz")


@query(
    f"""WITH s AS (SELECT x, y, z FROM ({SPLATS})), q AS (SELECT {_tails()} FROM s),
t AS (SELECT range AS i, {", ".join(f"{c}l[range + 1] AS {c}0, {c}h[range + 1] AS {c}1" for c in "xyz")} FROM q, range(64)),
n AS (SELECT i, any_value(x0) AS x0, any_value(x1) AS x1, any_value(y0) AS y0, any_value(y1) AS y1, any_value(z0) AS z0, any_value(z1) AS z1,
  count(*) FILTER (x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 AND z BETWEEN z0 AND z1) / count(*) AS coverage FROM t, s GROUP BY i)
SELECT x0, x1, y0, y1, z0, z1, coverage FROM n WHERE coverage >= 0.8 ORDER BY i DESC LIMIT 1"""
)
def forward_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.forward_box(splats(spark, sf_dir))


_ROT = [
    "1 - 2 * (qy * qy + qz * qz)", "2 * (qx * qy - qz * qw)", "2 * (qx * qz + qy * qw)", "2 * (qx * qy + qz * qw)", "1 - 2 * (qx * qx + qz * qz)",
    "2 * (qy * qz - qx * qw)", "2 * (qx * qz - qy * qw)", "2 * (qy * qz + qx * qw)", "1 - 2 * (qx * qx + qy * qy)",
]
_VAR = ", ".join(" + ".join(f"pow(({_ROT[3 * i + k]}) * s{'xyz'[k]}, 2)" for k in range(3)) + f" AS v{c}" for i, c in enumerate("xyz"))
MERGED = f"""SELECT source_id, count(*) AS n, {", ".join(f"sum(w * {c}) / sum(w) AS {c}" for c in "xyzrgb")},
  {", ".join(f"sqrt(greatest(sum(w * (v{c} + {c} * {c})) / sum(w) - pow(sum(w * {c}) / sum(w), 2), 0)) AS s{c}" for c in "xyz")}, 1 - exp(sum(ln(1 - a))) AS a
FROM (SELECT *, a * sx * sy * sz AS w, {_VAR} FROM ({SPLATS})) GROUP BY source_id"""
_MERGE_COLS = ["x", "y", "z", "sx", "sy", "sz", "r", "g", "b", "a"]


@query(f"SELECT source_id, n, {R6(_MERGE_COLS)} FROM ({MERGED})")
def gaussian_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = C.merged_moments(splats(spark, sf_dir), ["source_id"])
    return r6(merged.withColumns({f"s{c}": F.sqrt(f"c{c}{c}") for c in "xyz"}), ["source_id", "n"], _MERGE_COLS)


_OWN = ", ".join(" + ".join(f"({_ROT[3 * i + k]}) * ({_ROT[3 * j + k]}) * pow(s{'xyz'[k]}, 2)" for k in range(3)) + f" AS v{'xyz'[i]}{'xyz'[j]}" for i, j in C.COVARIANCE)
_COV = ", ".join(f"sum(w * (v{x}{y} + {x} * {y})) / sum(w) - sum(w * {x}) / sum(w) * (sum(w * {y}) / sum(w)) AS c{x}{y}" for x, y in (("xyz"[i], "xyz"[j]) for i, j in C.COVARIANCE))
_COV_COLS = [f"c{'xyz'[i]}{'xyz'[j]}" for i, j in C.COVARIANCE]


@query(f"""SELECT source_id, n, {R6(_COV_COLS)} FROM (SELECT source_id, count(*) AS n, {_COV} FROM (SELECT *, a * sx * sy * sz AS w, {_OWN} FROM ({SPLATS})) GROUP BY source_id)""")
def gaussian_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The covariance of each source as one Gaussian, taken back from its extents and rotation."""
    m = C.merge_gaussians(splats(spark, sf_dir), ["source_id"])
    turn = X.quaternion_matrix(tuple(F.col(c) for c in ("qx", "qy", "qz", "qw")))  # type: ignore[arg-type]
    back = {f"c{'xyz'[i]}{'xyz'[j]}": sum((turn[3 * i + k] * turn[3 * j + k] * F.col(f"s{'xyz'[k]}") * F.col(f"s{'xyz'[k]}") for k in range(3)), F.lit(0.0)) for i, j in C.COVARIANCE}
    return r6(m.withColumns(back), ["source_id", "n"], _COV_COLS)


@query(
    f"""WITH n AS (SELECT source_id, count(*) AS n FROM ({SPLATS}) GROUP BY source_id), l(level, ratio, boost) AS (VALUES (0, 1.0, 1.0), (1, 0.5, 1.0), (2, 0.25, 1.0), (3, 0.05, 1.01), (4, 0.01, 1.02))
SELECT source_id, level, n, least(floor(n * ratio::DOUBLE)::BIGINT, 20) AS target, boost::DOUBLE AS boost FROM n, l"""
)
def lod_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = splats(spark, sf_dir).groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))
    levels = F.explode(F.array(*(F.struct(F.lit(i).alias("level"), F.lit(p).alias("ratio"), F.lit(s).alias("boost")) for i, (p, s) in enumerate(C.LEVELS)))).alias("l")
    return n.select("source_id", "n", levels).select("source_id", "l.level", "n", C.lod_target(F.col("n"), F.col("l.ratio"), F.lit(20).cast("bigint")).alias("target"), "l.boost")


@query()
def lod_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each level is made from the one before; its number of Gaussians is the target at most, or one."""
    s, out = splats(spark, sf_dir), None
    n = s.count()
    level = s
    for i, (precision, boost) in enumerate(C.LEVELS[1:], 1):
        have = level.count()
        level = C.materialise(C.lod_reduce(level, n * precision / have, 0.05, boost=boost), "lod-level")
        rows = level.select(F.lit(i).alias("level"), "n", *C.XYZ, "sx", "sy", "sz", "qx", "qy", "qz", "qw", "a")
        out = rows if out is None else out.unionByName(rows)
    return out


@query()
def chunk_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaussians of each octree chunk and level of detail; chunks have at most 100."""
    return chunk_lod.build(splats(spark, sf_dir), 100).groupBy("chunk_id", "level").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""SELECT splat_id, round(sqrt(pow(x - 0.5, 2) + pow(y + 0.25, 2) + pow(z - 2, 2)), 6) AS radial, round((x - 0.5) * 0.6 + (y + 0.25) * 0 + (z - 2) * 0.8, 6) AS depth,
  row_number() OVER (PARTITION BY source_id ORDER BY (x - 0.5) * 0.6 + (y + 0.25) * 0 + (z - 2) * 0.8, splat_id)::INT AS place FROM ({SPLATS})"""
)
def depth_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = splats(spark, sf_dir)
    cam, fwd = (0.5, -0.25, 2.0), (0.6, 0.0, 0.8)
    rows = s.select("source_id", "splat_id", C.depth_order(s, cam, fwd, radial=True).alias("radial"), C.depth_order(s, cam, fwd).alias("depth"))
    placed = in_groups(rows, ["source_id"], [F.col("depth"), F.col("splat_id")], name="depths", unique=True)
    return placed.select("splat_id", F.round("radial", 6).alias("radial"), (F.round("depth", 6) + F.lit(0.0)).alias("depth"), (F.col("place") + 1).cast("int").alias("place"))


@query(
    f"""SELECT source_id, {R6(["scale", "tx", "ty", "tz"])} FROM (SELECT source_id, 1.75 / (max(y) - min(y)) AS scale, -(min(x) + max(x)) / 2 * (1.75 / (max(y) - min(y))) AS tx,
  -min(y) * (1.75 / (max(y) - min(y))) AS ty, -(min(z) + max(z)) / 2 * (1.75 / (max(y) - min(y))) AS tz FROM ({SPLATS}) GROUP BY source_id)"""
)
def model_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(C.uniform_fit(splats(spark, sf_dir), by="source_id"), ["source_id"], ["scale", "tx", "ty", "tz"])


@query("SELECT l_orderkey, l_partkey, l_linenumber, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_extendedprice, l_shipdate) > 1 AS cloned FROM lineitem")
def shared_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = ["l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_shipdate"]
    return C.first_use(table(spark, sf_dir, "lineitem").select("l_partkey", *order), "l_partkey", order).select("l_orderkey", "l_partkey", "l_linenumber", "cloned")


@query(
    f"""SELECT splat_id, source_id, x, a FROM (
  SELECT splat_id, 0::BIGINT AS source_id, x, a FROM ({SPLATS}) WHERE source_id % 2 = 0 UNION ALL SELECT splat_id, 1::BIGINT AS source_id, x, a FROM ({SPLATS}) WHERE source_id % 2 = 1)"""
)
def union_clouds(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = splats(spark, sf_dir).select("splat_id", F.col("source_id").alias("s"), "x", "a")
    part = lambda k: s.where(F.col("s") % 2 == k).select("splat_id", F.lit(k).cast("bigint").alias("source_id"), "x", "a")
    return part(0).unionByName(part(1))


# Meshes: triangles from the corners of three neighbouring vectors.

TRIS = f"""SELECT splat_id // 3 AS tri_id, {", ".join(f"max(CASE WHEN splat_id % 3 = {k} THEN ({c} * 8)::FLOAT::DOUBLE END) AS {n}{c}" for k, n in enumerate(("ka", "kb", "kc")) for c in "xyz")}
FROM ({SPLATS}) GROUP BY 1 HAVING count(*) = 3"""


def tris(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = splats(spark, sf_dir).withColumn("tri_id", F.expr("splat_id div 3"))
    cols = [F.max(F.when(F.col("splat_id") % 3 == k, (F.col(c) * 8).cast("float").cast("double"))).alias(f"{n}{c}") for k, n in enumerate(("ka", "kb", "kc")) for c in "xyz"]
    return s.groupBy("tri_id").agg(F.count(F.lit(1)).alias("k"), *cols).where("k = 3").drop("k")


@query(f"SELECT tri_id, {', '.join(f'least(ka{c}, kb{c}, kc{c}) AS {c}0, greatest(ka{c}, kb{c}, kc{c}) AS {c}1' for c in 'xyz')} FROM ({TRIS})")
def triangle_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.boxes(tris(spark, sf_dir)).select("tri_id", *(f"{c}{k}" for c in "xyz" for k in "01"))


@query(f"SELECT {', '.join(f'min(least(ka{c}, kb{c}, kc{c})) AS {c}0, max(greatest(ka{c}, kb{c}, kc{c})) AS {c}1' for c in 'xyz')} FROM ({TRIS})")
def mesh_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.boxes(tris(spark, sf_dir)).agg(*(f(f"{c}{k}").alias(f"{c}{k}") for c in "xyz" for k, f in (("0", F.min), ("1", F.max))))


_EDGES = ", ".join(f"({n}{c} - ka{c})::FLOAT::DOUBLE AS e{i}{c}" for i, n in ((1, "kb"), (2, "kc")) for c in "xyz")
_CROSS = {"x": "e1y * e2z - e1z * e2y", "y": "e1z * e2x - e1x * e2z", "z": "e1x * e2y - e1y * e2x"}


@query(
    f"""WITH t AS (SELECT tri_id, {_EDGES} FROM ({TRIS})), n AS (SELECT *, {", ".join(f"{v} AS n{k}" for k, v in _CROSS.items())} FROM t)
SELECT tri_id, e1x, e1y, e1z, e2x, e2y, e2z, {", ".join(f"round((n{c} / CASE WHEN nx * nx + ny * ny + nz * nz = 0 THEN 1 ELSE sqrt(nx * nx + ny * ny + nz * nz) END)::FLOAT::DOUBLE, 6) AS n{c}" for c in "xyz")} FROM n"""
)
def triangle_precompute(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = M.prepared(tris(spark, sf_dir))
    return r6(t, ["tri_id", *(f"e{i}{c}" for i in (1, 2) for c in "xyz")], ["nx", "ny", "nz"])


RAYS = f"SELECT splat_id AS ray_id, x * 8 AS ox, 30.0::DOUBLE AS oy, z * 8 AS oz, 0.1::DOUBLE AS dx, -1.0::DOUBLE AS dy, 0.05::DOUBLE AS dz, 60.0::DOUBLE AS max_t FROM ({SPLATS})"


def _cross_sql(a: str, b: str, out: str) -> str:
    return f"{a}y * {b}z - {a}z * {b}y AS {out}x, {a}z * {b}x - {a}x * {b}z AS {out}y, {a}x * {b}y - {a}y * {b}x AS {out}z"


def _dot_sql(a: str, b: str) -> str:
    return f"({a}x * {b}x + {a}y * {b}y + {a}z * {b}z)"


@query(
    f"""WITH r AS (SELECT ray_id, ox, oy, oz, max_t, dx / n AS dx, dy / n AS dy, dz / n AS dz FROM (SELECT *, sqrt(dx * dx + dy * dy + dz * dz) AS n FROM ({RAYS})) WHERE n >= 1e-8),
e AS (SELECT r.*, tri_id, {", ".join(f"kb{c} - ka{c} AS e{c}, kc{c} - ka{c} AS f{c}, o{c} - ka{c} AS t{c}" for c in "xyz")} FROM r, ({TRIS}) t),
p AS (SELECT *, {_cross_sql("d", "f", "p")}, {_cross_sql("t", "e", "q")} FROM e),
d AS (SELECT *, {_dot_sql("e", "p")} AS det FROM p),
h AS (SELECT ray_id, tri_id, max_t, {_dot_sql("t", "p")} / det AS u, {_dot_sql("d", "q")} / det AS v, {_dot_sql("f", "q")} / det AS t FROM d WHERE abs(det) >= 1e-10),
k AS (SELECT *, row_number() OVER (PARTITION BY ray_id ORDER BY t, tri_id) AS nth FROM h WHERE u >= 0 AND u <= 1 AND v >= 0 AND u + v <= 1 AND t >= 0 AND t <= max_t)
SELECT ray_id, round(t, 6) AS t, tri_id FROM k WHERE nth = 1"""
)
def ray_triangle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first triangle that a ray from each splat hits."""
    return _hits(splats(spark, sf_dir), tris(spark, sf_dir))


def _hits(s: DataFrame, triangles: DataFrame) -> DataFrame:
    rays = s.select(F.col("splat_id").alias("ray_id"), (F.col("x") * 8).alias("ox"), F.lit(30.0).alias("oy"), (F.col("z") * 8).alias("oz"), F.lit(0.1).alias("dx"), F.lit(-1.0).alias("dy"), F.lit(0.05).alias("dz"), F.lit(60.0).alias("max_t"))
    return M.first_hit(rays, triangles).withColumn("t", F.round("t", 6))


@query(SQL["ray_triangle"])
def ray_triangle_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as ray_triangle, which had fewer rays once."""
    return ray_triangle(spark, sf_dir)


def _dealt_points(s: DataFrame, triangles: DataFrame) -> DataFrame:
    """Points and triangles in turn: a splat has the triangle whose place, by tri_id, is its id modulo their number."""
    placed, n, _ = in_order(triangles, [F.col("tri_id")], name="triangles", unique=True)
    p = s.select("splat_id", F.pmod("splat_id", F.lit(max(n, 1))).alias("pos"), *((F.col(c) * 6).alias(f"p{c}") for c in "xyz"))
    return p.join(placed, "pos").drop("pos")


PLACED = f"(SELECT *, row_number() OVER (ORDER BY tri_id) - 1 AS pos, count(*) OVER () AS n FROM ({TRIS}))"
_D = {"1": ("ab", "ap"), "2": ("ac", "ap"), "3": ("ab", "bp"), "4": ("ac", "bp"), "5": ("ab", "cp"), "6": ("ac", "cp")}


@query(
    f"""WITH p AS (SELECT t.* EXCLUDE (pos, n), s.splat_id, s.x * 6 AS px, s.y * 6 AS py, s.z * 6 AS pz FROM {PLACED} t JOIN ({SPLATS}) s ON s.splat_id % t.n = t.pos),
v AS (SELECT *, {", ".join(f"kb{c} - ka{c} AS ab{c}, kc{c} - ka{c} AS ac{c}, p{c} - ka{c} AS ap{c}, p{c} - kb{c} AS bp{c}, p{c} - kc{c} AS cp{c}" for c in "xyz")} FROM p),
d AS (SELECT *, {", ".join(f"{_dot_sql(a, b)} AS d{k}" for k, (a, b) in _D.items())} FROM v),
w AS (SELECT *, d3 * d6 - d5 * d4 AS va, d5 * d2 - d1 * d6 AS vb, d1 * d4 - d3 * d2 AS vc FROM d)
SELECT splat_id, tri_id, {", ".join(f'''round(CASE WHEN d1 <= 0 AND d2 <= 0 THEN ka{c} WHEN d3 >= 0 AND d4 <= d3 THEN kb{c} WHEN vc <= 0 AND d1 >= 0 AND d3 <= 0 THEN ka{c} + ab{c} * (d1 / (d1 - d3))
  WHEN d6 >= 0 AND d5 <= d6 THEN kc{c} WHEN vb <= 0 AND d2 >= 0 AND d6 <= 0 THEN ka{c} + ac{c} * (d2 / (d2 - d6))
  WHEN va <= 0 AND d4 - d3 >= 0 AND d5 - d6 >= 0 THEN kb{c} + (kc{c} - kb{c}) * ((d4 - d3) / (d4 - d3 + d5 - d6)) ELSE ka{c} + ab{c} * (vb / (va + vb + vc)) + ac{c} * (vc / (va + vb + vc)) END, 6) AS {c}''' for c in "xyz")} FROM w"""
)
def closest_point_triangle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _dealt_points(splats(spark, sf_dir), tris(spark, sf_dir))
    return r6(M.nearest(rows, "p", ""), ["splat_id", "tri_id"], ["x", "y", "z"])


@query(
    f"""WITH p AS (SELECT t.* EXCLUDE (pos, n), s.splat_id, s.x * 6 AS px, s.y * 6 AS py, s.z * 6 AS pz FROM {PLACED} t JOIN ({SPLATS}) s ON s.splat_id % t.n = t.pos),
v AS (SELECT *, pow(kbx - kax, 2) + pow(kby - kay, 2) + pow(kbz - kaz, 2) AS n FROM p),
t AS (SELECT *, CASE WHEN n < 1e-20 THEN 0 ELSE greatest(0, least(1, ((px - kax) * (kbx - kax) + (py - kay) * (kby - kay) + (pz - kaz) * (kbz - kaz)) / n)) END AS t FROM v)
SELECT splat_id, tri_id, round(kax + (kbx - kax) * t, 6) AS x, round(kay + (kby - kay) * t, 6) AS y, round(kaz + (kbz - kaz) * t, 6) AS z FROM t"""
)
def closest_point_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _dealt_points(splats(spark, sf_dir), tris(spark, sf_dir))
    near = X.closest_on_segment(X.vec("p"), X.vec("ka"), X.vec("kb"))
    return r6(rows.select("splat_id", "tri_id", *near.named("")), ["splat_id", "tri_id"], ["x", "y", "z"])


@query()
def capsule_mesh(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = splats(spark, sf_dir).select(F.col("splat_id").alias("capsule_id"), *((F.col(c) * 8).alias(c) for c in "xyz"), F.lit(0.9).alias("half_height"), F.lit(0.6).alias("radius"))
    return M.capsule_push(s, tris(spark, sf_dir))


@query(
    f"""WITH v AS (SELECT splat_id, x, y, z, qx, qy, qz, qw FROM ({SPLATS})), m AS (SELECT *, {", ".join(f"{e} AS m{i}" for i, e in enumerate(_ROT))} FROM v)
SELECT splat_id, {", ".join(f"round(m{i}, 6) AS m{i}" for i in range(9))},
  round(CASE WHEN abs(m2) < 0.99999 THEN atan2(-m5, m8) ELSE atan2(m7, m4) END, 6) AS ex, round(asin(greatest(-1, least(1, m2))), 6) AS ey,
  round(CASE WHEN abs(m2) < 0.99999 THEN atan2(-m1, m0) ELSE 0 END, 6) AS ez FROM m"""
)
def rotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = X.quaternion_matrix(tuple(F.col(c) for c in ("qx", "qy", "qz", "qw")))  # type: ignore[arg-type]
    rows = splats(spark, sf_dir).select("splat_id", *(c.alias(f"m{i}") for i, c in enumerate(m)))
    e = X.matrix_euler([F.col(f"m{i}") for i in range(9)])
    return r6(rows.withColumns(dict(zip(("ex", "ey", "ez"), e))), ["splat_id"], [*(f"m{i}" for i in range(9)), "ex", "ey", "ez"])


@query(
    f"""WITH v AS (SELECT splat_id, x, y, z, sqrt(x * x + y * y + z * z) AS n FROM ({SPLATS})), u AS (SELECT splat_id, x, y, z, x / n AS ux, y / n AS uy, z / n AS uz FROM v WHERE n >= 1e-6)
SELECT splat_id, round(ux, 6) AS ux, round(uy, 6) AS uy, round(uz, 6) AS uz, round(x * cos(0.7) + z * sin(0.7), 6) AS rx, round(y, 6) AS ry, round(z * cos(0.7) - x * sin(0.7), 6) AS rz,
  round(atan2(-x, z), 6) AS angle FROM u"""
)
def vector_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directions, a turn about Y by Rodrigues' formula, and the signed angle from the vector to Z, seen along Y."""
    v = X.vec()
    u = X.unit(v)
    axis = X.const(0, 1, 0)
    r = X.rotate(v, axis, F.lit(0.7))
    rows = splats(spark, sf_dir).select("splat_id", *u.named("u"), *r.named("r"), X.signed_angle(v, X.const(0, 0, 1), axis).alias("angle")).where("ux IS NOT NULL")
    return r6(rows, ["splat_id"], ["ux", "uy", "uz", "rx", "ry", "rz", "angle"])


# Manifests: files and chunks from orders and their lines.

PIECES = "SELECT o_orderstatus AS scene, o_orderkey AS chunk_id, (o_custkey % 5)::INT AS level, (o_custkey % 997 + 1)::BIGINT AS count FROM orders"


def pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderstatus").alias("scene"), F.col("o_orderkey").alias("chunk_id"), (F.col("o_custkey") % 5).cast("int").alias("level"), (F.col("o_custkey") % 997 + 1).cast("bigint").alias("count")
    )


@query(f"SELECT scene, level, chunk_id, count, coalesce(sum(count) OVER (PARTITION BY scene, level ORDER BY chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS offset FROM ({PIECES})")
def lod_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.with_offsets(pieces(spark, sf_dir), ["scene", "level"], ["chunk_id"]).select("scene", "level", "chunk_id", "count", "offset")


@query(
    f"""WITH p AS (SELECT scene AS manifest_id, chunk_id, level AS file, count FROM ({PIECES})), f AS (SELECT manifest_id, max(file) + 1 AS n FROM p GROUP BY 1),
b AS (SELECT manifest_id, coalesce(sum(n) OVER (ORDER BY manifest_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS base FROM f)
SELECT manifest_id, chunk_id, (file + base)::BIGINT AS file, count FROM p JOIN b USING (manifest_id)"""
)
def lod_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pieces(spark, sf_dir).select(F.col("scene").alias("manifest_id"), "chunk_id", F.col("level").cast("bigint").alias("file"), "count")
    files = p.groupBy("manifest_id").agg((F.max("file") + 1).alias("n_files"))
    return L.merge(p, files)


@query(f"SELECT chunk_id, level, count, CASE WHEN count < 300 THEN 'spz' WHEN scene = 'F' THEN 'sog' ELSE 'ply' END AS format FROM ({PIECES})")
def chunk_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = F.when(F.col("scene") == "F", F.lit("sog")).otherwise(F.lit("ply"))
    return pieces(spark, sf_dir).select("chunk_id", "level", "count", L.chunk_format(F.col("count"), wanted, 300).alias("format"))


@query(
    f"""SELECT file_key, count(*) AS chunks, sum(count)::BIGINT AS rows FROM (
  SELECT *, CASE WHEN level >= 3 THEN 'shared/' || level ELSE level || '/' || chunk_id END AS file_key FROM ({PIECES})) GROUP BY 1"""
)
def low_level_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.pack_low_levels(pieces(spark, sf_dir), 3).groupBy("file_key").agg(F.count(F.lit(1)).alias("chunks"), F.sum("count").alias("rows"))


LODS = """SELECT c_nationkey AS scene, c_custkey AS chunk_id, l.range::INT AS level, ((100 + c_custkey % 50) // (1 + l.range))::BIGINT AS count, c_acctbal AS score FROM customer, range(4) l"""


@query(
    f"""WITH s AS (SELECT *, count - coalesce(lag(count) OVER (PARTITION BY scene, chunk_id ORDER BY level DESC), 0) AS extra FROM ({LODS})),
t AS (SELECT *, sum(extra) OVER (PARTITION BY scene ORDER BY level DESC, score DESC, chunk_id ROWS UNBOUNDED PRECEDING) AS spent FROM s)
SELECT scene, chunk_id, min(level) AS level, arg_min(count, level) AS count FROM t WHERE spent <= 4000 OR level = 3 GROUP BY scene, chunk_id"""
)
def lod_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("scene"), F.col("c_custkey").alias("chunk_id"), F.col("c_acctbal").alias("score"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("level"))
    c = c.withColumn("count", F.expr("(100 + chunk_id % 50) div (1 + level)"))
    return L.within_budget(c, 4000)


@query(
    f"""WITH d AS (SELECT splat_id, x - 0.2 AS dx, y - 0.1 AS dy, z + 1.5 AS dz FROM ({SPLATS})), e AS (SELECT *, sqrt(dx * dx + dy * dy + dz * dz) AS dist FROM d)
SELECT splat_id, round(CASE WHEN dz / dist < -0.2 AND dist > 2.0 THEN 0.1 WHEN dz / dist < 0.5 THEN 0.4 ELSE 1.0 END / (1 + dist), 6) AS score FROM e"""
)
def lod_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = splats(spark, sf_dir)
    return s.select("splat_id", F.round(L.score({c: F.col(c) for c in "xyz"}, (0.2, 0.1, -1.5), (0.0, 0.0, 1.0)), 6).alias("score"))


_JSON = """CASE c_custkey % 6 WHEN 0 THEN '{"magicCode":1,"type":"lod-splat","version":"1","counts":5,"levels":2,"files":["a"],"tree":[]}'
 WHEN 1 THEN '{"magicCode":2500660,"type":"other","version":"1","counts":5,"levels":2,"files":["a"],"tree":[]}'
 WHEN 2 THEN '{"magicCode":2500660,"type":"lod-splat","version":"1","counts":5,"levels":0,"files":["a"],"tree":[]}'
 WHEN 3 THEN '{"magicCode":2500660,"type":"lod-splat","version":"1","counts":5,"levels":2,"files":["a",7],"tree":[]}'
 WHEN 4 THEN 'not json' ELSE '{"magicCode":2500660,"type":"lod-splat","version":2,"counts":5,"levels":2,"files":["a","b"],"tree":[]}' END"""


@query("SELECT c_custkey, c_custkey % 6 IN (2, 3, 5) AS loose, c_custkey % 6 IN (2, 3, 5) AS medium, c_custkey % 6 = 5 AS strict FROM customer")
def manifest_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", F.expr(_JSON).alias("json")).withColumn("m", L.read_manifest(F.col("json")))
    return c.select("c_custkey", L.is_manifest("m", strict=0).alias("loose"), L.is_manifest("m", strict=1).alias("medium"), L.is_manifest("m", F.col("json"), 2).alias("strict"))


@query("SELECT c_custkey, greatest(0, c_custkey % 9 - 1)::INT AS coarse, least(greatest(0, c_custkey % 9 - 1), 4)::INT AS capped FROM customer")
def bootstrap_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = (F.col("c_custkey") % 9).cast("int")
    return table(spark, sf_dir, "customer").select("c_custkey", L.bootstrap_level(n).alias("coarse"), L.bootstrap_level(n, capped=True).alias("capped"))
