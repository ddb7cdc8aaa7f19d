"""Triangles of binary glTF files: the JSON chunk's node tree and the binary chunk's accessors, as tables.

A file is read as one row by Spark's binaryFile reader (2 GB at most). Its nodes and its primitives become rows; world
matrices are products along the tree.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelith.operators.meshes import soup
from voxelith.operators.trees import from_root

#: Fixed values of the format: the file's and its chunks' marks, component types, numbers of components, and triangles.
MAGIC, JSON_CHUNK, BIN_CHUNK = 0x46546C67, 0x4E4F534A, 0x004E4942
COMPONENTS = {5120: "<i1", 5121: "<u1", 5122: "<i2", 5123: "<u2", 5125: "<u4", 5126: "<f4"}
PARTS = {"SCALAR": 1, "VEC2": 2, "VEC3": 3, "VEC4": 4}
TRIANGLES = 4
IDENTITY = [1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0]
NODE = "path string, node int, parent int, mesh int, matrix array<double>"
PRIMITIVE = "path string, mesh int, primitive int, positions array<double>, idx array<int>"


def chunks(content: bytes) -> tuple[dict, bytes]:
    """(the JSON chunk, the binary chunk or nothing) of a file; other chunks are passed over."""
    if len(content) < 20 or struct.unpack_from("<II", content) != (MAGIC, 2):
        raise ValueError("not a binary glTF file of version 2")
    doc, data, at = None, b"", 12
    while at + 8 <= len(content):
        size, kind = struct.unpack_from("<II", content, at)
        body = content[at + 8 : at + 8 + size]
        if len(body) < size:
            raise ValueError("a chunk is longer than its file")
        if kind == JSON_CHUNK and doc is None:
            doc = json.loads(body)
        elif kind == BIN_CHUNK and not data:
            data = body
        at += 8 + size + -size % 4
    if doc is None:
        raise ValueError("no JSON chunk")
    return doc, data


def accessor(doc: dict, data: bytes, index: int) -> np.ndarray:
    """The values of an accessor, a row for each element. One without a buffer view is all zeros."""
    a = doc["accessors"][index]
    if "sparse" in a or a.get("normalized"):
        raise ValueError("sparse and normalized accessors are not read")
    kind, parts, n = np.dtype(COMPONENTS[a["componentType"]]), PARTS[a["type"]], a["count"]
    if "bufferView" not in a:
        return np.zeros((n, parts), kind)
    view = doc["bufferViews"][a["bufferView"]]
    if view.get("buffer", 0) != 0 or "uri" in doc["buffers"][0]:
        raise ValueError("buffers outside the file are not read")
    start = view.get("byteOffset", 0) + a.get("byteOffset", 0)
    stride = view.get("byteStride") or kind.itemsize * parts
    end = start + stride * (n - 1) + kind.itemsize * parts if n else start
    if end > min(len(data), view.get("byteOffset", 0) + view["byteLength"]):
        raise ValueError("an accessor is longer than its buffer")
    return np.ndarray((n, parts), kind, data, start, (stride, kind.itemsize))


def local_matrix(node: dict) -> list[float]:
    """A node's 4 x 4 matrix by columns, from its own or from translation, rotation and scale."""
    if "matrix" in node:
        return [float(v) for v in node["matrix"]]
    (tx, ty, tz), (x, y, z, w), s = node.get("translation", (0, 0, 0)), node.get("rotation", (0, 0, 0, 1)), node.get("scale", (1, 1, 1))
    columns = [
        (1 - 2 * (y * y + z * z), 2 * (x * y + w * z), 2 * (x * z - w * y)),
        (2 * (x * y - w * z), 1 - 2 * (x * x + z * z), 2 * (y * z + w * x)),
        (2 * (x * z + w * y), 2 * (y * z - w * x), 1 - 2 * (x * x + y * y)),
    ]
    return [float(v) for c, k in zip(columns, s) for v in (*(e * k for e in c), 0)] + [float(tx), float(ty), float(tz), 1.0]


def _rows(files: DataFrame, schema: str, tell: Any) -> DataFrame:
    names = [p.split()[0] for p in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"]):
                yield pd.DataFrame(list(tell(path, *chunks(bytes(content)))), columns=names).astype(object)

    return files.select("path", "content").mapInPandas(run, schema)


def nodes(files: DataFrame) -> DataFrame:
    """`path, node, parent, mesh, matrix` of all nodes; `parent` is null for roots, `mesh` for nodes without one."""

    def tell(path: str, doc: dict, _: bytes) -> Iterator[tuple]:
        up = {c: i for i, n in enumerate(doc.get("nodes", [])) for c in n.get("children", [])}
        for i, n in enumerate(doc.get("nodes", [])):
            yield path, i, up.get(i), n.get("mesh"), local_matrix(n)

    return _rows(files, NODE, tell)


def primitives(files: DataFrame) -> DataFrame:
    """`path, mesh, primitive, positions, idx` of all primitives made of triangles; `idx` is null without an index."""

    def tell(path: str, doc: dict, data: bytes) -> Iterator[tuple]:
        for m, mesh in enumerate(doc.get("meshes", [])):
            for k, p in enumerate(mesh["primitives"]):
                if p.get("mode", TRIANGLES) == TRIANGLES and "POSITION" in p["attributes"]:
                    idx = accessor(doc, data, p["indices"]).ravel().astype(np.int64).tolist() if "indices" in p else None
                    yield path, m, k, accessor(doc, data, p["attributes"]["POSITION"]).astype(np.float64).ravel().tolist(), idx

    return _rows(files, PRIMITIVE, tell)


def product(a: Column, b: Column) -> Column:
    """The product of two 4 x 4 matrices by columns."""
    return F.array(*(sum((a[4 * k + r] * b[4 * c + k] for k in range(4)), F.lit(0.0)) for c in range(4) for r in range(4)))


def triangles(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """`path, node, primitive, tri_id, kax..kcz`: the triangles of files in world coordinates, as 32-bit floats.

    A mesh that several nodes have is there once for each. `tri_id` counts within the primitive. Without an index corners
    come in order. Files that aren't binary glTF of version 2 are an error, and so are accessors beyond their buffer.
    """
    files = spark.read.format("binaryFile").load(paths)
    placed = from_root(nodes(files), ["path"], "node", "parent", F.col("matrix"), product, "world").where("mesh IS NOT NULL")
    shapes = placed.select("path", "node", "mesh", "world").join(primitives(files), ["path", "mesh"])
    mesh = F.struct("path", "node", "primitive").alias("mesh_id")
    got = soup(shapes.select(mesh, "positions", "idx", "world"))
    return got.select("mesh_id.*", *(c for c in got.columns if c != "mesh_id"))
