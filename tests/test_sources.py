import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelith.operators import octree
from voxelith.operators.voxels import leaf_masks, unpack_leaves
from voxelith.sources.ply_format import PlySource
from voxelith.sources.splat_format import ROW, SplatSource


def test_splat_round_trip(spark, tmp_path):
    spark.dataSource.register(SplatSource)
    df = spark.range(500).select(*((F.col("id") / (i + 1)).cast("float").alias(c) for i, c in enumerate(("x", "y", "z", "sx", "sy", "sz"))), *(((F.col("id") * (i + 3)) % 256).cast("smallint").alias(c) for i, c in enumerate(("r", "g", "b", "a", "q0", "q1", "q2", "q3"))))
    df.write.format("splat").mode("append").save(f"{tmp_path}/s")
    got = spark.read.format("splat").load(f"{tmp_path}/s")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, df.collect()))


def test_splat_rows_are_whole(spark, tmp_path):
    spark.dataSource.register(SplatSource)
    rows = np.zeros(3, ROW)
    rows["c"] = 255
    (tmp_path / "a.splat").write_bytes(rows.tobytes() + b"rest")
    (tmp_path / "b.splat").write_bytes(b"")
    got = spark.read.format("splat").load(str(tmp_path)).collect()
    assert [(r.x, r.a) for r in got] == [(0.0, 255)] * 3


def test_ply_round_trip_and_text(spark, tmp_path):
    spark.dataSource.register(PlySource)
    df = spark.range(300).select(F.col("id").cast("float").alias("x"), (F.col("id") * 2).cast("double").alias("f_rest_0"), (F.col("id") % 200).cast("smallint").alias("red"))
    df.write.format("ply").mode("append").save(f"{tmp_path}/p")
    got = spark.read.format("ply").load(f"{tmp_path}/p")
    assert sorted((r.x, r.f_rest_0, r.red) for r in got.collect()) == sorted(map(tuple, df.collect()))
    (tmp_path / "t.ply").write_text("ply\nformat ascii 1.0\nelement vertex 2\nproperty float x\nproperty uchar red\nelement face 0\nproperty list uchar int i\nend_header\n1.5 7\n2 255\n")
    assert [tuple(r) for r in spark.read.format("ply").load(f"{tmp_path}/t.ply").collect()] == [(1.5, 7), (2.0, 255)]


def voxels(spark):
    rnd = np.random.default_rng(4)
    some = {tuple(int(v) for v in p) for p in rnd.integers(0, 30, (300, 3))} | {(x, y, z) for x in range(4) for y in range(4, 8) for z in range(4)}
    return some, spark.createDataFrame(sorted(some), "ix bigint, iy bigint, iz bigint")


def descend(nodes, leaves, depth, ix, iy, iz):
    """One path from the root, as the format's description has it."""
    at = 0
    for level in range(depth - 1, -1, -1):
        w = nodes[at]
        if w == 0xFF000000:
            return True
        mask = w >> 24
        o = (iz // 4 >> level & 1) << 2 | (iy // 4 >> level & 1) << 1 | ix // 4 >> level & 1
        if not mask >> o & 1:
            return False
        at = (w & 0xFFFFFF) + bin(mask & (1 << o) - 1).count("1")
    if nodes[at] == 0xFF000000:
        return True
    lo, hi = leaves[nodes[at]]
    return bool((lo | hi << 32) >> (iz % 4 * 16 + iy % 4 * 4 + ix % 4) & 1)


def test_octree_holds_its_voxels(spark, tmp_path):
    some, df = voxels(spark)
    nodes, leaves = octree.build(leaf_masks(df), 3)
    n = {r.idx: r.word for r in nodes.collect()}
    lv = {r.leaf: (r.lo, r.hi) for r in leaves.collect()}
    assert sorted(n) == list(range(len(n))) and sorted(lv) == list(range(len(lv))) and 0xFF000000 in n.values()
    assert all(descend(n, lv, 3, x, y, z) == ((x, y, z) in some) for x in range(0, 32, 3) for y in range(32) for z in range(0, 32, 5))
    meta = octree.write_pair(nodes, leaves, {"treeDepth": 3, "leafSize": 4}, f"file://{tmp_path}/v")
    back = octree.read_pair(spark, f"file://{tmp_path}/v")
    assert back[2] == meta and meta["leafDataCount"] == 2 * len(lv)
    got = unpack_leaves(octree.flatten(back[0], back[1], 3))
    assert {tuple(r) for r in got.collect()} == some
    (tmp_path / "v" / "voxel-meta.json").write_text(json.dumps(meta | {"nodeCount": 10**6}))
    with pytest.raises(ValueError, match="words"):
        octree.read_pair(spark, f"file://{tmp_path}/v")


def test_lod_directory(spark, tmp_path):
    from voxelith.operators import manifests as L
    from voxelith.sources import lod_directory

    rows = [(c, lv, float(i), 0.0, 1.0) for c in range(4) for lv in range(3) for i in range(12 >> lv)]
    df = spark.createDataFrame(rows, "chunk_id int, level int, x double, y double, z double")
    meta = lod_directory.write(df, f"file://{tmp_path}/lod", first_shared=2)
    assert (meta["levels"], meta["counts"], len(meta["files"]), len(meta["permanentFiles"])) == (3, 48, 9, 1)
    shared = meta["permanentFiles"][0]
    assert [n["lods"][2] for n in meta["tree"]] == [{"file": shared, "offset": 3 * c, "count": 3} for c in range(4)]
    text = (tmp_path / "lod" / "lod-meta.json").read_text()
    m = spark.createDataFrame([(text,)], "t string").withColumn("m", L.read_manifest(F.col("t")))
    assert m.select(L.is_manifest("m", F.col("t"))).first()[0]
    assert L.chunks(m.withColumn("manifest_id", F.lit(1))).agg(F.sum("count")).first()[0] == len(rows)
    assert lod_directory.read_files(spark, f"file://{tmp_path}/lod", [meta["files"][shared]]).count() == 12
