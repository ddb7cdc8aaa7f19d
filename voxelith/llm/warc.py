"""WARC archives of pages: an index first, then coalesced byte-range reads of the records that are wanted."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelith.llm.heavy import winners
from voxelith.storage import fresh_path, materialise

#: Bytes of an archive file, after which a task begins another.
FILE_BYTES = 1 << 30
#: Records with at most GAP bytes between them are read at once, up to RANGE bytes.
GAP, RANGE = 64 << 10, 8 << 20
#: Bytes of records that a task reads.
TASK_BYTES = 128 << 20
#: Payload groups that are broadcast at most; more are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Pages have no fetch time; a fixed one keeps reruns equal.
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
INDEX = "page_id string, url string, digest string, record_type string, file string, offset bigint, length bigint"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: str | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{digest}')}>"


def record(page_id: str | None, url: str | None, payload: bytes, digest: str, refers_to: str | None = None, revisit: bool = False) -> bytes:
    """One WARC/1.0 record, gzipped. A revisit has the HTTP head of its page and no payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    target = quote(url, safe="!#$%&'()*+,/:;=?@[]~") if url else f"urn:page:{quote(page_id or '')}"
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(page_id, digest)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", target),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if page_id is not None:
        fields.append(("X-Page-ID", quote(page_id)))
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)), ("X-Refers-To-Page-ID", quote(refers_to))]
    text = "WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(text.encode() + block + b"\r\n\r\n") + pack.flush()


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC fields, HTTP fields, payload) of an unpacked record; field names in lower case."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    warc = _fields(head)
    block = rest[: int(warc["content-length"])]
    if not warc.get("content-type", "").startswith("application/http"):
        return warc, {}, block
    head, _, payload = block.partition(b"\r\n\r\n")
    return warc, _fields(head), payload


def _fields(head: bytes) -> dict[str, str]:
    out = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        k, _, v = line.partition(":")
        out[k.strip().lower()] = v.strip()
    return out


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if re.match(r"\w+:/", path) else f"file://{path}")


def write_archives(pages: DataFrame, path: str | None = None, min_bytes: int = 0) -> DataFrame:
    """Writes a record for each row of `pages` (`page_id, url, html`) and returns the index, one row per record.

    Of equal payloads of `min_bytes` or more the page of least id is a response and the others are revisits of it; all
    smaller payloads are responses. A null html is an empty payload, a null url gets a URN. A null page_id loses to any
    other; where all are null, all are responses. Rows that repeat the least id are all responses. Ids may be of any type
    that a cast to string and back leaves as it is. An empty table gives an empty index. Other columns play no part.

    Each task writes files of its own under a name that no other attempt has, in the shared folder if no `path` is given.
    Only files that the index names count, so an attempt that is lost leaves nothing that is read.
    """
    spark = pages.sparkSession
    path = path or fresh_path(spark, "warc")
    html = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    keys = materialise(pages.select("page_id", F.sha1(html).alias("sha1"), F.length(html).alias("bytes")).where(F.col("bytes") >= min_bytes), "warc-keys")
    groups = [g.where("group_size > 1") for g in winners(keys, "sha1", F.min("page_id"))]
    heavy, light = (g.select(F.col("sha1").alias("g_sha1"), F.col("best").cast("string").alias("first_id")) for g in groups)
    light = materialise(light, "warc-groups")
    rows = pages.select(F.col("page_id").cast("string").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"), F.when(F.length(html) >= min_bytes, F.sha1(html)).alias("sha1"))
    on = F.col("sha1") == F.col("g_sha1")
    if light.count() <= BROADCAST_ROWS:
        rows = rows.join(F.broadcast(heavy.unionByName(light)), on, "left")
    else:  # frequent payloads find their group map-side, so that only the others are shuffled by digest
        common = F.broadcast(heavy)
        rows = rows.join(common, on).unionByName(rows.join(common, on, "left_anti").join(light, on, "left"))
    rows = rows.select("page_id", "url", "html", "first_id")
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open(path)
        fs.create_dir(root, recursive=True)
        sink, file, at, files = None, "", 0, 0
        stem = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}"
        try:
            for b in batches:
                index: list[list] = [[], [], [], [], []]
                for page_id, url, text, first in zip(*(c.to_pylist() for c in b.columns)):
                    if sink is None or at >= FILE_BYTES:
                        if sink:
                            sink.close()
                        file, at, files = f"{stem}-{files}.warc.gz", 0, files + 1
                        sink = fs.open_output_stream(f"{root}/{file}", compression=None)
                    payload = text.encode()
                    digest = base32_sha1(payload)
                    revisit = first is not None and page_id != first
                    raw = record(page_id, url, payload, digest, first, revisit)
                    sink.write(raw)
                    for column, v in zip(index, (digest, "revisit" if revisit else "response", f"{path}/{file}", at, len(raw))):
                        column.append(v)
                    at += len(raw)
                kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
                arrays = [pa.array(v, k) for v, k in zip(index, kinds)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *arrays], names=["page_id", "url", "digest", "record_type", "file", "offset", "length"])
        finally:
            if sink:
                sink.close()

    index = rows.mapInArrow(run, INDEX)
    return materialise(index.withColumn("page_id", F.col("page_id").cast(kind)), "warc-index")


def read_records(index: DataFrame, payload: bool = True) -> DataFrame:
    """The records that `index` names (rows of what write_archives() returned, filtered as one likes), read back.

    `page_id, payload_bytes, payload_digest, record_type, refers_to`, and `payload` if asked for (null for revisits); ids
    have the type of the index's. Records of a stretch of a file go to one task in order of their offset; neighbours are read by one range
    request. A payload that doesn't have its digest is an error.
    """
    cols = "page_id string, payload_bytes bigint, payload_digest string, record_type string, refers_to string" + ", payload binary" * payload
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), *[pa.binary()] * payload]
    names = [c.split()[0] for c in cols.split(", ")]
    stretch = F.expr(f"offset div {RANGE}")
    # Index rows are small, what they stand for is not: as many partitions as the records' bytes need.
    total = index.agg(F.sum("length")).first()[0] or 0
    n = max(int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // TASK_BYTES)
    wanted = index.select("file", "offset", "length").repartition(n, "file", stretch).sortWithinPartitions("file", "offset")

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
        file, start, end, inside = "", 0, 0, []
        for b in batches:
            for f, o, n in zip(*(c.to_pylist() for c in b.columns)):
                if inside and (f != file or o - end > GAP or max(end, o + n) - start > RANGE):
                    yield file, start, end, inside
                    inside = []
                if not inside:
                    file, start, end = f, o, o
                inside.append((o, n))
                end = max(end, o + n)
        if inside:
            yield file, start, end, inside

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, source = "", None
        for file, start, end, inside in ranges(batches):
            if file != opened:
                if source:
                    source.close()
                fs, local = _open(file)
                opened, source = file, fs.open_input_file(local)
            raw = source.read_at(end - start, start)
            rows: list[list] = [[] for _ in kinds]
            for o, n in inside:
                warc, http, body = parse(zlib.decompress(raw[o - start : o - start + n], 31))
                digest = warc["warc-payload-digest"].removeprefix("sha1:")
                revisit = warc["warc-type"] == "revisit"
                if not revisit and base32_sha1(body) != digest:
                    raise ValueError(f"the record at {o} of {file} doesn't have the payload of its digest")
                page, refers = warc.get("x-page-id"), warc.get("x-refers-to-page-id")
                row = (page and unquote(page), int(http["content-length"]) if revisit else len(body), digest, warc["warc-type"], refers and unquote(refers), None if revisit else body)
                for column, v in zip(rows, row):
                    column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(rows, kinds)], names=names)
        if source:
            source.close()

    kind = index.schema["page_id"].dataType
    return wanted.mapInArrow(run, cols).withColumns({c: F.col(c).cast(kind) for c in ("page_id", "refers_to")})
