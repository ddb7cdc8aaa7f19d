"""Logical tables of the engine, drawn from the carrier tables, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelith.operators.voxels import Grid

#: Cells of the carrier cloud.
GRID = Grid(cell=(5.0, 5.0, 2.0))
CUTOFF = 0.1

POINTS = "SELECT l_orderkey, l_linenumber, l_quantity AS x, l_extendedprice / 1000 AS y, l_discount * 100 AS z, l_tax * 10 AS a FROM lineitem"
VOXELS = (
    f"SELECT floor(x / 5.0)::BIGINT AS ix, floor(y / 5.0)::BIGINT AS iy, floor(z / 2.0)::BIGINT AS iz, count(*) AS n, max(a) AS opacity "
    f"FROM ({POINTS}) WHERE a >= {CUTOFF} GROUP BY ALL"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`l_orderkey, l_linenumber, x, y, z, a`: a cloud with opacities from lineitem."""
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"), (F.col("l_discount") * 100).alias("z"), (F.col("l_tax") * 10).alias("a")
    )


def voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voxelith.operators.voxels import occupancy

    return occupancy(points(spark, sf_dir), GRID, CUTOFF)


_E = [f"embedding[{i + 1}]::DOUBLE" for i in range(64)]
_Q = [f"embedding[{i + 1}]::DOUBLE" for i in range(6, 10)]
_N = "sqrt(" + " + ".join(f"{q} * {q}" for q in _Q) + ")"
SPLATS = (
    f"SELECT vec_id AS splat_id, label AS source_id, {_E[0]} AS x, {_E[1]} AS y, {_E[2]} AS z, "
    + ", ".join(f"abs({_E[3 + i]}) + 0.01 AS s{a}" for i, a in enumerate("xyz"))
    + ", "
    + ", ".join(f"{q} / {_N} AS q{a}" for q, a in zip(_Q, "xyzw"))
    + f", {_E[10]} AS r, {_E[11]} AS g, {_E[12]} AS b, 1 / (1 + exp(-{_E[13]})) AS a, list_slice(embedding, 15, 59) AS sh, 3 AS sh_degree FROM embeddings"
)


def splats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaussians from the vectors of `embeddings`."""
    e = lambda i: F.col("embedding")[i].cast("double")
    q = [e(i) for i in range(6, 10)]
    n = F.sqrt(q[0] * q[0] + q[1] * q[1] + q[2] * q[2] + q[3] * q[3])
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("splat_id"),
        F.col("label").alias("source_id"),
        *(e(i).alias(a) for i, a in enumerate("xyz")),
        *((F.abs(e(3 + i)) + 0.01).alias(f"s{a}") for i, a in enumerate("xyz")),
        *((c / n).alias(f"q{a}") for c, a in zip(q, "xyzw")),
        *(e(10 + i).alias(a) for i, a in enumerate("rgb")),
        (1 / (1 + F.exp(-e(13)))).alias("a"),
        F.slice("embedding", 15, 45).alias("sh"),
        F.lit(3).alias("sh_degree"),
    )
