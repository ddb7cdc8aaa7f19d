"""Binary glTF files written byte by byte, and trees of parent links against a loop."""

import json
import random
import struct

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from voxelith.operators.trees import from_root
from voxelith.sources import glb_format as G


def glb(doc, data, magic=0x46546C67, extra=b""):
    text = json.dumps(doc).encode()
    text += b" " * (-len(text) % 4)
    body = struct.pack("<II", len(text), 0x4E4F534A) + text + extra + struct.pack("<II", len(data), 0x004E4942) + data
    return struct.pack("<III", magic, 2, 12 + len(body)) + body


def two_meshes():
    """A strided, indexed triangle pair in mesh 0, an unindexed triangle in mesh 1, lines that are left out."""
    corners = [(0, 0, 0), (1, 0, 0), (0, 2, 0), (0, 0, 3)]
    strided = b"".join(struct.pack("<3f2f", *c, 9.0, 9.0) for c in corners)  # 20 bytes each, with texture coordinates
    index = struct.pack("<6H", 0, 1, 2, 0, 2, 3)
    plain = struct.pack("<9f", 1, 1, 1, 2, 1, 1, 1, 2, 1)
    data = b"\0" * 4 + strided + index + plain
    doc = {
        "asset": {"version": "2.0"}, "buffers": [{"byteLength": len(data)}],
        "bufferViews": [{"buffer": 0, "byteOffset": 4, "byteLength": 80, "byteStride": 20}, {"buffer": 0, "byteOffset": 84, "byteLength": 12}, {"buffer": 0, "byteOffset": 96, "byteLength": 36}],
        "accessors": [{"bufferView": 0, "componentType": 5126, "count": 4, "type": "VEC3"}, {"bufferView": 1, "componentType": 5123, "count": 6, "type": "SCALAR"}, {"bufferView": 2, "componentType": 5126, "count": 3, "type": "VEC3"}],
        "meshes": [{"primitives": [{"attributes": {"POSITION": 0}, "indices": 1}, {"attributes": {"POSITION": 0}, "mode": 1}]}, {"primitives": [{"attributes": {"POSITION": 2}}]}],
        "nodes": [
            {"translation": [10, 0, 0], "children": [1, 2]},
            {"mesh": 0, "scale": [2, 2, 2], "children": [3]},
            {"rotation": [0, 0, 0.7071067811865476, 0.7071067811865476], "mesh": 1},  # a quarter about z
            {"matrix": [1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, 0, 0, 5, 1], "mesh": 1},
        ],
    }
    return doc, data


def test_triangles_equal_those_computed_by_hand(spark, tmp_path):
    doc, data = two_meshes()
    (tmp_path / "a.glb").write_bytes(glb(doc, data, extra=struct.pack("<II", 4, 0x12345678) + b"skip"))
    got = {(r.node, r.primitive, r.tri_id): [[round(r[f"{n}{a}"], 5) for a in "xyz"] for n in ("ka", "kb", "kc")] for r in G.triangles(spark, f"{tmp_path}/a.glb").collect()}
    assert got == {
        (1, 0, 0): [[10, 0, 0], [12, 0, 0], [10, 4, 0]],
        (1, 0, 1): [[10, 0, 0], [10, 4, 0], [10, 0, 6]],
        (2, 0, 0): [[9, 1, 1], [9, 2, 1], [8, 1, 1]],  # (x, y) to (-y, x), then moved
        (3, 0, 0): [[12, 2, 12], [14, 2, 12], [12, 4, 12]],  # moved by 5, doubled by its parent, moved
    }


def test_several_files_and_files_without_meshes(spark, tmp_path):
    doc, data = two_meshes()
    (tmp_path / "a.glb").write_bytes(glb(doc, data))
    (tmp_path / "b.glb").write_bytes(glb(doc, data))
    (tmp_path / "c.glb").write_bytes(glb({"asset": {"version": "2.0"}}, b""))
    got = G.triangles(spark, str(tmp_path)).groupBy("path").count().collect()
    assert sorted(r["count"] for r in got) == [4, 4]


@pytest.mark.parametrize("kind", ["magic", "beyond", "short"])
def test_broken_files_are_errors(spark, tmp_path, kind):
    doc, data = two_meshes()
    if kind == "beyond":
        doc["accessors"][0]["count"] = 40
    whole = glb(doc, data, magic=0 if kind == "magic" else 0x46546C67)
    (tmp_path / "a.glb").write_bytes(whole[:-8] if kind == "short" else whole)
    with pytest.raises(PySparkException, match="not a binary glTF|longer than its"):
        G.triangles(spark, f"{tmp_path}/a.glb").collect()


def test_component_types_and_zeros():
    data = struct.pack("<3B", 1, 2, 255) + b"\0" + struct.pack("<2I", 7, 1 << 31)
    doc = {"buffers": [{}], "bufferViews": [{"byteLength": 3}, {"byteOffset": 4, "byteLength": 8}], "accessors": [{"bufferView": 0, "componentType": 5121, "count": 3, "type": "SCALAR"}, {"bufferView": 1, "componentType": 5125, "count": 2, "type": "SCALAR"}, {"componentType": 5126, "count": 2, "type": "VEC3"}]}
    assert [G.accessor(doc, data, i).ravel().tolist() for i in range(3)] == [[1, 2, 255], [7, 1 << 31], [0.0] * 6]


def test_roots_of_random_trees(spark):
    rnd = random.Random(3)
    rows = [(t, i, rnd.choice([None, i - 1, i - 1, rnd.randrange(i)]) if i else None) for t in ("a", "b", None) for i in range(300)] + [("a", 900, 12345)]
    df = spark.createDataFrame(rows, "t string, id int, up int").withColumn("w", F.col("id").cast("string"))
    got = {(r.t, r.id): (r.root, r.depth, r.way) for r in from_root(df, ["t"], "id", "up", F.col("w"), lambda a, b: F.concat_ws("/", a, b), "way").collect()}
    up = {(t, i): u for t, i, u in rows}
    for t, i, _ in rows:
        way, at = [i], i
        while up[t, at] is not None and (t, up[t, at]) in up:
            at = up[t, at]
            way.append(at)
        assert got[t, i] == (at, len(way) - 1, "/".join(map(str, way[::-1])))


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    from voxelith.operators import trees

    rounds = []
    real = trees.materialise
    monkeypatch.setattr(trees, "materialise", lambda df, name: rounds.append(1) or real(df, name))
    n = 2000
    df = spark.range(n).select(F.col("id"), F.when(F.col("id") > 0, F.col("id") - 1).alias("up"))
    got = from_root(df, [], "id", "up", F.lit(1), lambda a, b: a + b, "n").agg(F.max("depth"), F.max("n"), F.max("root")).first()
    assert tuple(got) == (n - 1, n, 0) and len(rounds) <= 13


def test_circles_are_errors(spark, monkeypatch):
    from voxelith.operators import trees

    monkeypatch.setattr(trees, "ROUNDS", 5)
    with pytest.raises(ValueError, match="circle"):
        from_root(spark.createDataFrame([(1, 2), (2, 1)], "id int, up int"), [], "id", "up", F.lit(1), lambda a, b: a + b, "n")


def test_matrices():
    a = np.array(G.local_matrix({"translation": [1, 2, 3], "rotation": [0.5, 0.5, 0.5, 0.5], "scale": [2, 3, 4]})).reshape(4, 4).T
    assert np.allclose(a @ [1, 0, 0, 1], [1, 4, 3, 1]) and np.allclose(a @ [0, 1, 0, 1], [1, 2, 6, 1]) and np.allclose(a @ [0, 0, 1, 1], [5, 2, 3, 1])
