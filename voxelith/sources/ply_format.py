"""Spark data source `ply`: vertices of binary little-endian or text PLY files, read in ranges of rows."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition
from pyspark.sql.types import DoubleType, FloatType, IntegerType, LongType, ShortType, StructField, StructType

from voxelith.sources.files import listed, opened
from voxelith.sources.splat_format import Written

#: Names of number types in headers, as numpy and Spark types.
TYPES = {
    "char": ("i1", ShortType()), "uchar": ("u1", ShortType()), "short": ("<i2", IntegerType()), "ushort": ("<u2", IntegerType()), "int": ("<i4", IntegerType()), "uint": ("<u4", LongType()),
    "float": ("<f4", FloatType()), "double": ("<f8", DoubleType()), "int8": ("i1", ShortType()), "uint8": ("u1", ShortType()), "int16": ("<i2", IntegerType()), "uint16": ("<u2", IntegerType()),
    "int32": ("<i4", IntegerType()), "uint32": ("<u4", LongType()), "float32": ("<f4", FloatType()), "float64": ("<f8", DoubleType()),
}
ARROW = {ShortType(): pa.int16(), IntegerType(): pa.int32(), LongType(): pa.int64(), FloatType(): pa.float32(), DoubleType(): pa.float64()}
SPLIT_ROWS = 1 << 18
HEADER = 1 << 16


class Head:
    """A header: format, number of vertices, their properties, and where the rows begin."""

    def __init__(self, raw: bytes):
        end = raw.find(b"end_header\n")
        if not raw.startswith(b"ply") or end < 0:
            raise ValueError("not a PLY file")
        self.start, self.rows, self.binary, inside = end + len(b"end_header\n"), 0, False, False
        self.fields: list[tuple[str, str]] = []
        first = True
        for line in raw[:end].decode("ascii", "replace").split("\n"):
            words = line.split()
            if words[:1] == ["format"]:
                if words[1] not in ("binary_little_endian", "ascii"):
                    raise ValueError(f"unsupported PLY format {words[1]}")
                self.binary = words[1] != "ascii"
            elif words[:1] == ["element"]:
                if not first and inside is False and not self.fields:
                    raise ValueError("vertices must be the first element")
                inside = words[1] == "vertex"
                self.rows = int(words[2]) if inside else self.rows
                first = False
            elif words[:1] == ["property"] and inside:
                if words[1] == "list":
                    raise ValueError("vertices with lists aren't supported")
                self.fields.append((words[2], words[1]))
        self.dtype = np.dtype([(n, TYPES[t][0]) for n, t in self.fields])

    def schema(self) -> StructType:
        return StructType([StructField(n, TYPES[t][1]) for n, t in self.fields])

    def batch(self, rows: np.ndarray) -> pa.RecordBatch:
        kinds = [ARROW[TYPES[t][1]] for _, t in self.fields]
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[n])).cast(k) for (n, _), k in zip(self.fields, kinds)], names=[n for n, _ in self.fields])


def head_of(fs, path: str) -> Head:
    with fs.open_input_file(path) as f:
        return Head(f.read_at(min(HEADER, f.size()), 0))


class Rows(InputPartition):
    def __init__(self, path: str, start: int, n: int):
        super().__init__((path, start, n))
        self.path, self.start, self.n = path, start, n


class PlyReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType):
        self.path, self.names = path, schema.fieldNames()

    def partitions(self) -> list[Rows]:
        fs, _ = opened(self.path)
        out = []
        for f, _size in listed(self.path, ".ply"):
            h = head_of(fs, f)
            if [n for n, _ in h.fields] != self.names:
                raise ValueError(f"{f} has other properties than the first file")
            out += [Rows(f, at, min(SPLIT_ROWS, h.rows - at)) for at in range(0, h.rows, SPLIT_ROWS)] if h.binary else [Rows(f, 0, h.rows)]
        return out or [Rows("", 0, 0)]

    def read(self, part: Rows) -> Iterator[pa.RecordBatch]:
        if not part.n:
            return
        fs, _ = opened(self.path)
        h = head_of(fs, part.path)
        with fs.open_input_file(part.path) as f:
            if h.binary:
                size = h.dtype.itemsize
                yield h.batch(np.frombuffer(f.read_at(part.n * size, h.start + part.start * size), h.dtype))
            else:
                lines = f.read_at(f.size() - h.start, h.start).split(b"\n")[: part.n]
                yield h.batch(np.array([tuple(float(v) for v in line.split()) for line in lines], dtype=h.dtype))


class PlyWriter(DataSourceArrowWriter):
    """Binary files of at most SPLIT_ROWS vertices each, since a header tells their number before they come."""

    def __init__(self, path: str, schema: StructType):
        self.path = path
        kinds = {"float": "float", "double": "double", "smallint": "short", "int": "int", "tinyint": "char", "bigint": "double"}
        self.fields = [(f.name, kinds[f.dataType.simpleString()]) for f in schema]

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        fs, root = opened(self.path)
        fs.create_dir(root, recursive=True)
        stem, files, held, total = f"{root}/part-{uuid.uuid4().hex}", 0, [], 0
        dtype = np.dtype([(n, TYPES[t][0]) for n, t in self.fields])

        def flush(rows: list[np.ndarray]) -> None:
            n = sum(map(len, rows))
            head = "ply\nformat binary_little_endian 1.0\n" + f"element vertex {n}\n" + "".join(f"property {t} {c}\n" for c, t in self.fields) + "end_header\n"
            with fs.open_output_stream(f"{stem}-{files}.ply", compression=None) as f:
                f.write(head.encode())
                for r in rows:
                    f.write(r.tobytes())

        for b in batches:
            r = np.zeros(b.num_rows, dtype)
            for i, (n, _) in enumerate(self.fields):
                r[n] = b.column(i).to_numpy(zero_copy_only=False)
            for at in range(0, len(r), SPLIT_ROWS):
                held.append(r[at : at + SPLIT_ROWS])
                total += len(held[-1])
                if sum(map(len, held)) >= SPLIT_ROWS:
                    flush(held)
                    held, files = [], files + 1
        if held or not files:
            flush(held)
        return Written(stem, total)

    def commit(self, messages: list) -> None:
        fs, root = opened(self.path)
        with fs.open_output_stream(f"{root}/_SUCCESS", compression=None):
            pass

    def abort(self, messages: list) -> None:
        fs, root = opened(self.path)
        stems = tuple(m.file for m in messages if m is not None)
        for f, _ in listed(root, ".ply"):
            if stems and f.startswith(stems):
                fs.delete_file(f)


class PlySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ply"

    def schema(self) -> StructType:
        fs, _ = opened(self.options["path"])
        files = listed(self.options["path"], ".ply")
        if not files:
            raise FileNotFoundError(self.options["path"])
        return head_of(fs, files[0][0]).schema()

    def reader(self, schema: StructType) -> PlyReader:
        return PlyReader(self.options["path"], schema)

    def writer(self, schema: StructType, overwrite: bool) -> PlyWriter:
        return PlyWriter(self.options["path"], schema)
