"""Queries answer for every row of their tables, not for a part of them."""

import pytest
from pyspark.sql import functions as F

from voxelith.operators import clouds as C
from voxelith.operators import meshes as M
from voxelith.plans import cloud_queries as Q
from voxelith.plans.catalog import QUERIES, SQL
from voxelith.plans.carriers import splats

SF = "/root/testdata/sf0.001"


def test_every_splat_casts_a_ray(spark):
    assert "WHERE splat_id" not in SQL["ray_triangle_all"]
    got = {r.ray_id: (r.t, r.tri_id) for r in QUERIES["ray_triangle_all"](spark, SF).collect()}
    assert {k % 5 for k in got} == set(range(5))


def test_every_splat_is_a_capsule(spark):
    got = {r.capsule_id: tuple(r) for r in QUERIES["capsule_mesh"](spark, SF).collect()}
    assert {k % 3 for k in got} == set(range(3))
    # A row needs a triangle whose box meets the capsule's.
    tri = [tuple(r) for r in Q.tris(spark, SF).select(*(f"{n}{a}" for n in M.CORNERS for a in "xyz")).collect()]
    far = lambda x, y, z, t: any(min(t[k::3]) > c + e or max(t[k::3]) < c - e for k, (c, e) in enumerate(((x, 0.6), (y, 1.5), (z, 0.6))))
    for s in splats(spark, SF).select("splat_id", "x", "y", "z").collect():
        c = (s.x * 8, s.y * 8, s.z * 8)
        assert s.splat_id not in got or not all(far(*c, t) for t in tri)


def test_every_event_is_imported(spark):
    got = QUERIES["import_records_all"](spark, SF).collect()
    ids = [r.event_id for r in spark.read.parquet(f"{SF}/events.parquet").select("event_id").collect()]
    assert len(ids) > 200
    assert (sum(r.n for r in got), sum(r.failed for r in got)) == (len(ids), sum(i % 4 == 0 for i in ids))


@pytest.mark.parametrize("name", ["closest_point_triangle", "closest_point_segment"])
def test_every_triangle_has_points(spark, tmp_path, name):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    more = e.unionByName(e.withColumn("vec_id", F.col("vec_id") + 3000))  # 1000 splats, ids with a gap
    few = e.where("vec_id < 30")
    for rows, at in ((more, "more"), (few, "few")):
        rows.write.parquet(f"{tmp_path}/{at}/embeddings.parquet")
        got = QUERIES[name](spark, f"{tmp_path}/{at}").collect()
        assert len(got) == rows.count()
        assert {r.tri_id for r in got} == {r.tri_id for r in Q.tris(spark, f"{tmp_path}/{at}").collect()}


def test_every_documented_level_is_made(spark):
    got, n = QUERIES["lod_chain"](spark, SF).cache(), splats(spark, SF).count()
    counts = {r.level: r["count"] for r in got.groupBy("level").count().collect()}
    assert set(counts) == {1, 2, 3, 4}
    assert all(0 < counts[i] <= int(n * C.LEVELS[i][0]) for i in counts)
    above = got.where("level = 3").drop("level", "n").withColumns({c: F.lit(0.0) for c in "rgb"})  # not in the rows; no part of sizes
    plain = C.lod_reduce(above, n * C.LEVELS[4][0] / above.count(), 0.05).agg(F.sum("sx")).first()[0]
    assert got.where("level = 4").agg(F.sum("sx")).first()[0] == pytest.approx(C.LEVELS[4][1] * plain)
