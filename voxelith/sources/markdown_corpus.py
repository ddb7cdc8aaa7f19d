"""A folder of text files kept equal to a table of pages: changed ones are written, stale ones deleted, empty folders pruned."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelith.operators.corpus import stale
from voxelith.sources.files import opened
from voxelith.storage import materialise


def sync(pages: DataFrame, root: str, path: str = "path", content: str = "content") -> DataFrame:
    """Makes the files below `root` those of `pages` and returns `path, action` of what was written or deleted.

    Files are compared by hash and written by tasks, each whole under its own path, so a task that runs again leaves the
    same files. Null contents count as empty. Paths that are null, repeated, absolute or lead out of `root` are refused.
    """
    spark = pages.sparkSession
    want = pages.select(F.col(path).alias("path"), F.coalesce(F.col(content), F.lit("")).alias("content"))
    bad = want.where("path IS NULL OR path = '' OR path RLIKE '^/|(^|/)[.][.](/|$)'").limit(1).collect()
    bad += want.groupBy("path").count().where("count > 1").limit(1).collect()
    if bad:
        raise ValueError(f"no path for a page of its own: {bad[0].path}")
    fs, base = opened(root)
    fs.create_dir(base, recursive=True)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = opened(root)
        for b in batches:
            out = []
            for name in b.column(0).to_pylist():
                digest = hashlib.sha256()
                with store.open_input_stream(f"{top}/{name}", compression=None) as f:
                    while part := f.read(1 << 20):
                        digest.update(part)
                out.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["path", "hash"])

    def below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = opened(root)
        for b in batches:
            for folder, deep in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found = store.get_file_info(pafs.FileSelector(f"{top}/{folder}", recursive=True)) if deep else [store.get_file_info(f"{top}/{folder}")]
                names = [f.path[len(top.rstrip("/")) + 1 :] for f in found if f.type == pafs.FileType.File]
                for i in range(0, len(names), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(names[i : i + 10_000], pa.string())], names=["path"])

    # The driver only lists what is in the folder itself; tasks list the folders in it.
    top = [(f.path[len(base.rstrip("/")) + 1 :], f.type == pafs.FileType.Directory) for f in fs.get_file_info(pafs.FileSelector(base))]
    some = spark.createDataFrame(top, "path string, deep boolean").repartition(max(1, min(len(top), 1000)), "path")
    have = some.mapInArrow(below, "path string").repartition("path").mapInArrow(hashed, "path string, hash string")
    actions = stale(have, want.select("path", F.sha2(F.col("content"), 256).alias("hash")), "path", "hash")
    actions = materialise(actions, "corpus-actions")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = opened(root)
        for b in batches:
            for name, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if text is None:
                    if store.get_file_info(f"{top}/{name}").type == pafs.FileType.File:
                        store.delete_file(f"{top}/{name}")
                    continue
                store.create_dir(f"{top}/{name}".rpartition("/")[0], recursive=True)
                with store.open_output_stream(f"{top}/{name}", compression=None) as f:
                    f.write(text.encode())
            yield b.select([0])

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = opened(root)
        for b in batches:
            for name in b.column(0).to_pylist():
                while name and not store.get_file_info(pafs.FileSelector(f"{top}/{name}", allow_not_found=True)):
                    if store.get_file_info(f"{top}/{name}").type == pafs.FileType.Directory:
                        store.delete_dir(f"{top}/{name}")
                    name = name.rpartition("/")[0]
            yield b

    for action in ("delete", "write"):  # a folder may take the place of a file
        some = actions.where(F.col("action") == action)
        some = some.join(want, "path").select("path", "content") if action == "write" else some.select("path", F.lit(None).cast("string").alias("content"))
        some.mapInArrow(apply, "path string").write.format("noop").mode("overwrite").save()
    folders = actions.where("action = 'delete'").select(F.regexp_extract("path", "^(.*)/", 1).alias("path")).where("path <> ''").distinct()
    folders.mapInArrow(prune, "path string").write.format("noop").mode("overwrite").save()
    return actions
