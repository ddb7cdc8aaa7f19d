"""Spark data source `splat`: 32-byte rows of centre, scale, colour and quaternion, read in byte ranges.

    spark.dataSource.register(SplatSource)
    spark.read.format("splat").load(path)
    df.write.format("splat").mode("append").save(path)
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from voxelith.sources.files import listed, opened

#: The layout of a row.
ROW = np.dtype([("p", "<f4", 3), ("s", "<f4", 3), ("c", "u1", 4), ("q", "u1", 4)])
COLUMNS = ["x", "y", "z", "sx", "sy", "sz", "r", "g", "b", "a", "q0", "q1", "q2", "q3"]
SCHEMA = ", ".join(f"{c} {'float' if i < 6 else 'smallint'}" for i, c in enumerate(COLUMNS))
SPLIT_ROWS = 1 << 20


def decoded(raw: bytes) -> pa.RecordBatch:
    """The whole rows in `raw`; bytes that fill no row are left."""
    rows = np.frombuffer(raw[: len(raw) // ROW.itemsize * ROW.itemsize], ROW)
    cols = [np.ascontiguousarray(rows[f][:, i]) for f, n in (("p", 3), ("s", 3), ("c", 4), ("q", 4)) for i in range(n)]
    kinds = [pa.float32()] * 6 + [pa.int16()] * 8
    return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int16) if i >= 6 else c, k) for i, (c, k) in enumerate(zip(cols, kinds))], names=COLUMNS)


def encoded(batch: pa.RecordBatch) -> bytes:
    rows = np.zeros(batch.num_rows, ROW)
    get = lambda c: batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False)
    for f, names in (("p", COLUMNS[:3]), ("s", COLUMNS[3:6]), ("c", COLUMNS[6:10]), ("q", COLUMNS[10:])):
        for i, c in enumerate(names):
            rows[f][:, i] = get(c) if f in "ps" else np.clip(get(c), 0, 255)
    return rows.tobytes()


class Range(InputPartition):
    def __init__(self, path: str, start: int, size: int):
        super().__init__((path, start, size))
        self.path, self.start, self.size = path, start, size


class SplatReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Range]:
        step = SPLIT_ROWS * ROW.itemsize
        return [Range(f, at, min(step, size - at)) for f, size in listed(self.path, ".splat") for at in range(0, size, step)] or [Range("", 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if part.size >= ROW.itemsize:
            fs, _ = opened(self.path)
            with fs.open_input_file(part.path) as f:
                yield decoded(f.read_at(part.size, part.start))


class Written(WriterCommitMessage):
    def __init__(self, file: str, rows: int):
        self.file, self.rows = file, rows


class SplatWriter(DataSourceArrowWriter):
    """A file per task, under a name of its own; files of failed jobs are deleted."""

    def __init__(self, path: str):
        self.path = path

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        fs, root = opened(self.path)
        fs.create_dir(root, recursive=True)
        name, rows = f"{root}/part-{uuid.uuid4().hex}.splat", 0
        with fs.open_output_stream(name, compression=None) as f:
            for b in batches:
                f.write(encoded(b))
                rows += b.num_rows
        return Written(name, rows)

    def commit(self, messages: list) -> None:
        fs, root = opened(self.path)
        with fs.open_output_stream(f"{root}/_SUCCESS", compression=None):
            pass

    def abort(self, messages: list) -> None:
        fs, _ = opened(self.path)
        for m in messages:
            if m is not None:
                fs.delete_file(m.file)


class SplatSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "splat"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> SplatReader:
        return SplatReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> SplatWriter:
        return SplatWriter(self.options["path"])
