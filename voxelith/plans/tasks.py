"""Runs a list of tasks over named clouds, as a JSON document describes it; DataFrames stay lazy until they are written.

    {"version": 1, "tasks": [
        {"id": "in", "type": "Read", "config": {"inputs": ["a.ply", "b.splat"], "output": "cloud", "maxShDegree": 2}},
        {"id": "move", "type": "Modify", "config": {"input": "cloud", "output": "cloud", "transform": [...], "deletedIndices": [...]}},
        {"id": "lod", "type": "AutoLod", "config": {"input": "cloud", "output": "small", "ratio": 0.3}},
        {"id": "out", "type": "Write", "config": {"input": "small", "output": "small.parquet"}}]}

A task reads and writes resources by name, in order; an output may have the name of an input.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelith.operators import chunk_lod, extents, octree
from voxelith.operators import clouds as C
from voxelith.operators import voxels as V
from voxelith.sources import lod_directory
from voxelith.sources.ply_format import PlySource
from voxelith.sources.splat_format import SplatSource
from voxelith.storage import materialise

Resources = dict[str, DataFrame]


def _format(path: str) -> str:
    for ext in ("splat", "ply", "parquet"):
        if path.rstrip("/").endswith(f".{ext}"):
            return ext
    raise ValueError(f"no reader or writer for {path}")


def read(spark: SparkSession, res: Resources, c: dict) -> None:
    """Several files as one cloud; columns that a file lacks are null, and `source_id` counts the files."""
    out = None
    for i, path in enumerate(c["inputs"]):
        df = spark.read.format(_format(path)).load(path).withColumn("source_id", F.lit(i))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise ValueError("Read has no inputs")
    degree = c.get("maxShDegree", 3)
    if not 0 <= degree <= 3:
        raise ValueError("maxShDegree must be from 0 to 3")
    res[c["output"]] = C.truncate_sh(out, degree) if "sh" in out.columns else out


def write(spark: SparkSession, res: Resources, c: dict) -> None:
    """One cloud to files; rows are in Morton order of cells of the given size unless `mortonSort` is off.

    Chunks of AutoChunkLod become a directory with a manifest.
    """
    df = res[c["input"]]
    if {"chunk_id", "level"} <= set(df.columns):
        lod_directory.write(df, c["output"], c.get("firstShared", 3))
        return
    kind = _format(c["output"])
    if c.get("mortonSort", True):
        size = c.get("cell", 0.05)
        finite = {a: F.when(F.abs(a) < float("inf"), F.col(a)) for a in "xyz"}  # rows without a finite place come first
        low = df.agg(*(F.min(v).alias(a) for a, v in finite.items())).first()
        cells = [F.coalesce(F.floor((v - F.lit(low[a])) / size).cast("bigint"), F.lit(0)) for a, v in finite.items()]
        df = C.morton_sorted(df, C.morton(*cells), int(spark.conf.get("spark.sql.shuffle.partitions"))).drop("morton")
    df.write.format(kind).mode("append" if kind != "parquet" else "errorifexists").save(c["output"])


def modify(spark: SparkSession, res: Resources, c: dict) -> None:
    """Deletes the splats of a bitmap of ids, then moves single ones, then the whole cloud."""
    df = res[c["input"]]
    if words := c.get("deletedIndices"):
        df = C.delete_indices(df, spark.createDataFrame(list(enumerate(words)), "pos bigint, word bigint"), c.get("id", "splat_id"), c.get("bitmapWidth", 32))
    rows = c.get("isRowMatrix", True)
    turned = lambda m: [float(v) for v in (m if rows else [m[4 * k + r] for r in range(4) for k in range(4)])]
    moves = [(i, n, turned(t["transform"])) for n, t in enumerate(c.get("indicesTransform", [])) for w, word in enumerate(t["indices"]) for i in _bits(w, word)]
    if moves:
        df = C.local_transforms(df, spark.createDataFrame(moves, "idx bigint, ordinal int, m array<double>"), c.get("id", "splat_id"))
    if m := c.get("transform"):
        df = C.transform(df, [float(v) for v in m], rows)
    res[c["output"]] = df


def _bits(at: int, word: int, width: int = 32) -> list[int]:
    return [at * width + b for b in range(width) if word >> b & 1]


def auto_lod(spark: SparkSession, res: Resources, c: dict) -> None:
    res[c["output"]] = C.lod_reduce(res[c["input"]], c.get("ratio", 0.3), c.get("cell", 0.05), c.get("counts"), c.get("scaleBoost", 1.0))


def auto_chunk_lod(spark: SparkSession, res: Resources, c: dict) -> None:
    """Octree chunks in levels of detail. Chunk files are Parquet; other types are refused."""
    if c.get("type", "parquet") != "parquet":
        raise ValueError(f"no writer for chunks of type {c['type']}")
    levels = [(float(v["precision"]), float(v.get("scaleBoost", 1.0))) for v in c["levels"]] if "levels" in c else None
    res[c["output"]] = materialise(chunk_lod.build(res[c["input"]], c.get("maxChunkCounts", 400_000), levels), "chunk-lod")


def voxel(spark: SparkSession, res: Resources, c: dict) -> None:
    """Voxelises a cloud and writes the octree's pair of files.

    A splat is in the cell of its centre, or with `extentSigmas` in all cells that its ellipsoid of so many deviations meets.
    """
    size = c.get("voxelResolution", 0.05)
    low, high = (tuple(float(v) for v in side) for side in c.get("box", [[-100.0] * 3, [100.0] * 3]))
    cutoff = c.get("opacityCutoff", 0.1)
    if sigmas := c.get("extentSigmas"):
        cells = materialise(extents.extent_occupancy(res[c["input"]], V.Grid(low, (size,) * 3), sigmas, cutoff, low, high), "voxels")
        held = cells.agg(*(F.min(i).alias(f"{i}0") for i in V.CELL), *(F.max(i).alias(f"{i}1") for i in V.CELL)).first()
        if held["ix0"] is None:
            raise ValueError("Voxel: no splat reaches into the box")
        origin = tuple(a + held[f"{i}0"] * size for a, i in zip(low, V.CELL))
        blocks = max((held[f"{i}1"] - held[f"{i}0"]) // V.LEAF + 1 for i in V.CELL)
        cells = cells.withColumns({i: F.col(i) - held[f"{i}0"] for i in V.CELL})
    else:
        df = res[c["input"]].where(V.in_box(V.Vec(F.col("x"), F.col("y"), F.col("z")), low, high))
        box = df.agg(*(F.min(a).alias(f"{a}0") for a in "xyz"), *(F.max(a).alias(f"{a}1") for a in "xyz")).first()
        origin = tuple(box[f"{a}0"] for a in "xyz")
        blocks = max(int((box[f"{a}1"] - box[f"{a}0"]) / size) // V.LEAF + 1 for a in "xyz")
        cells = V.occupancy(df, V.Grid(origin, (size,) * 3), cutoff)
    depth = max(1, (blocks - 1).bit_length())
    side = 2**depth * V.LEAF * size
    meta = {"version": "1", "gridBounds": {"min": list(origin), "max": [o + side for o in origin]}, "voxelResolution": size, "leafSize": V.LEAF, "treeDepth": depth}
    octree.write_pair(*octree.build(V.leaf_masks(cells), depth), meta, c["output"])


TASKS: dict[str, Callable[[SparkSession, Resources, dict], None]] = {"Read": read, "Write": write, "Modify": modify, "AutoLod": auto_lod, "AutoChunkLod": auto_chunk_lod, "Voxel": voxel}


def run(spark: SparkSession, document: str | dict) -> Resources:
    """Runs the tasks in order and returns the resources."""
    doc = json.loads(document) if isinstance(document, str) else document
    for source in (SplatSource, PlySource):
        spark.dataSource.register(source)
    res: Resources = {}
    for t in doc["tasks"]:
        if t["type"] not in TASKS:
            raise ValueError(f"task {t.get('id')}: no such type: {t['type']}")
        TASKS[t["type"]](spark, res, t["config"])
    return res
