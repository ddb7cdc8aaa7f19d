import base64
import gzip
import hashlib

import pytest

from voxelith.llm import warc
from voxelith.llm.warc import read_records, write_archives

SCHEMA = "page_id bigint, url string, html string, first_id int, g_sha1 string"


def rows():
    texts = ["<p>é</p>", "", None, "<p>é</p>", "a\r\n\r\nWARC/1.0\r\nb", "x" * 400_000, "", "lone"]
    out = [(10 - i, f"http://x.example/{i}?ü\n", t, 1, "clash") for i, t in enumerate(texts)]
    return [*out, *((100 + i, None, "<p>é</p>", 1, "") for i in range(60)), (7, "http://again", "<p>é</p>", 1, ""), (None, None, "lone", 1, "")]


def b32(t):
    return base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()


@pytest.mark.parametrize(("min_bytes", "bound"), [(0, 10), (5, 10), (0, 0)])
def test_round_trip(spark, monkeypatch, min_bytes, bound):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", bound)
    data = rows()
    index = write_archives(spark.createDataFrame(data, SCHEMA).repartition(3), min_bytes=min_bytes)
    got = read_records(index).collect()
    first = {}
    for r in data:
        if r[0] is not None:
            first[r[2] or ""] = min(first.get(r[2] or "", r[0]), r[0])
    want = []
    for r in data:
        t = r[2] or ""
        revisit = len(t.encode()) >= min_bytes and r[0] != first[t]
        want.append((str(r[0]), len(t.encode()), b32(t), "revisit" if revisit else "response", first[t] if revisit else None, None if revisit else t.encode()))
    assert sorted(map(str, want)) == sorted(str((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, bytes(r.payload) if r.payload is not None else None)) for r in got)


def test_ranges_are_coalesced_and_files_are_gzip_members(spark, monkeypatch, tmp_path):
    index = write_archives(spark.createDataFrame(rows(), SCHEMA).coalesce(1), f"file://{tmp_path}/w")
    some = index.where("page_id > 100 AND page_id % 7 = 0")
    assert {r.page_id for r in read_records(some, payload=False).collect()} == {105, 112, 119, 126, 133, 140, 147, 154}
    at = sorted((r.offset, r.length) for r in index.collect())
    assert at[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(at, at[1:]))
    (file,) = (tmp_path / "w").iterdir()
    assert gzip.decompress(file.read_bytes()).count(b"WARC/1.0\r\nWARC-Type: ") == len(rows())
    raw = file.read_bytes()[at[3][0] : at[3][0] + at[3][1]]
    fields, http, body = warc.parse(gzip.decompress(raw))
    assert fields["warc-record-id"].startswith("<urn:uuid:") and int(http["content-length"]) >= len(body)


def test_a_damaged_payload_is_an_error(spark, tmp_path):
    index = write_archives(spark.createDataFrame([(1, "u", "text" * 50, 0, "")], SCHEMA), f"file://{tmp_path}/w")
    (file,) = (tmp_path / "w").iterdir()
    whole = gzip.decompress(file.read_bytes()).replace(b"texttext", b"TEXTtext", 1)
    bad = gzip.compress(whole)
    file.write_bytes(bad)
    from pyspark.sql import functions as F

    with pytest.raises(Exception, match="doesn't have the payload"):
        read_records(index.withColumn("length", F.lit(len(bad)).cast("bigint"))).collect()


def test_empty_table(spark):
    index = write_archives(spark.createDataFrame([], SCHEMA))
    assert index.count() == 0 and read_records(index).count() == 0


def test_ids_of_other_types(spark):
    data = [("a\nb: é", "<p>1</p>"), ("b", "<p>1</p>"), (None, "<p>1</p>"), ("2", "x")]
    got = read_records(write_archives(spark.createDataFrame([(i, None, t) for i, t in data], "page_id string, url string, html string"))).collect()
    assert sorted((str(r.page_id), r.record_type, r.refers_to) for r in got) == sorted([("a\nb: é", "response", None), ("b", "revisit", data[0][0]), ("None", "revisit", data[0][0]), ("2", "response", None)])
