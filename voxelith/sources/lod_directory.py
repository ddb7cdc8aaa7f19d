"""Chunked level-of-detail directories: Parquet per level and chunk file, and one `lod-meta.json`."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelith.operators import manifests as L
from voxelith.operators.clouds import forward_box, quantile_box
from voxelith.sources.files import opened


def write(splats: DataFrame, path: str, first_shared: int = 3, sh_degree: int = 0, tails: float = 0.01, max_chunks: int = 1_000_000) -> dict:
    """Writes `splats` (`chunk_id, level, x, y, z, ...`) under `path`, a folder for each file of the manifest.

    Levels from `first_shared` on share one file each; the others have a file for each chunk. Rows of a file are sorted by
    chunk, so a chunk is a run of rows, told by offset and count; a shared file has parts, read in order of their names,
    so that no task writes a whole level. The forward box holds most of level 0. Bounds leave `tails` of each side out. The manifest has
    a row for each chunk and level, at most `max_chunks`, which is all that comes to the driver.
    """
    keyed = L.pack_low_levels(splats, first_shared)
    counts = keyed.groupBy("chunk_id", "level", "file_key").agg(F.count(F.lit(1)).alias("count"))
    pieces = L.with_offsets(counts, ["file_key"], ["chunk_id"]).join(quantile_box(splats, tails, 1 - tails, ["chunk_id"]), "chunk_id")
    rows = pieces.limit(max_chunks + 1).collect()
    if len(rows) > max_chunks:
        raise ValueError(f"more than {max_chunks} chunks; raise the limit or use larger chunks")
    files = sorted({r.file_key for r in rows})
    number = {f: i for i, f in enumerate(files)}
    keyed.repartitionByRange("file_key", "chunk_id").sortWithinPartitions("file_key", "chunk_id").write.partitionBy("file_key").parquet(f"{path}/data")
    levels = max((r.level for r in rows), default=-1) + 1
    tree: dict = {}
    for r in sorted(rows, key=lambda r: (r.chunk_id, r.level)):
        node = tree.setdefault(r.chunk_id, {"bound": {"min": [r.x0, r.y0, r.z0], "max": [r.x1, r.y1, r.z1]}, "lods": []})
        node["lods"].append({"file": number[r.file_key], "offset": r.offset, "count": r["count"]})
    meta = {"magicCode": L.MAGIC, "type": L.KIND, "version": "1", "counts": sum(r["count"] for r in rows if r.level == 0), "shDegree": sh_degree, "levels": levels, "files": files}
    ahead = forward_box(splats.where("level = 0")).first()
    meta["forwardBox"] = {"min": [ahead.x0, ahead.y0, ahead.z0], "max": [ahead.x1, ahead.y1, ahead.z1]} if rows else None
    meta |= {"permanentFiles": [i for f, i in number.items() if f.startswith("shared/")], "tree": list(tree.values())}
    fs, root = opened(path)
    with fs.open_output_stream(f"{root}/lod-meta.json", compression=None) as f:
        f.write(json.dumps(meta).encode())
    return meta


def read_files(spark: SparkSession, path: str, files: list[str] | None = None) -> DataFrame:
    """The rows of all files or of some; the others aren't opened."""
    df = spark.read.option("basePath", f"{path}/data").parquet(f"{path}/data")
    return df if files is None else df.where(F.col("file_key").isin(files))
