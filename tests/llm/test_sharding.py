import zlib
from collections import defaultdict

from voxelith.llm.sharding import assign_shards, write_shards

SCHEMA = "doc_id bigint, text string, shard int, before int"


def rows():
    return [*((i * 3, "é" * (i * 37 % 90), 1, 1) for i in range(300)), (None, None, 0, 0), (None, "x", 0, 0), (9, "é", 0, 0), (9, "é", 0, 0), (5, "y" * 30_000, 0, 0)]


def test_shards_are_runs_of_near_equal_bytes(spark):
    got = assign_shards(spark.createDataFrame(rows(), SCHEMA).repartition(7), 8).collect()
    assert len(got) == len(rows())
    want = sorted(((r[0] is not None, r[0] or 0), zlib.crc32((r[1] or "").encode()), len((r[1] or "").encode()) + 16) for r in rows())
    placed = sorted(got, key=lambda r: (r.shard, r.slot))
    assert [((r.doc_id is not None, r.doc_id or 0), r.text_crc32, r.size) for r in placed] == want
    shards = defaultdict(list)
    for r in placed:
        shards[r.shard].append(r)
    assert all([r.slot for r in s] == list(range(len(s))) for s in shards.values())
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
    share, longest = sum(r.size for r in got) / 8, max(r.size for r in got)
    assert all(abs(sum(r.size for r in s) - share) <= longest for s in shards.values())


def test_written_shards_hold_their_documents(spark, tmp_path):
    df = spark.createDataFrame(rows(), SCHEMA.replace("before", "crc")).selectExpr("*", "shard AS p_id", "crc AS size")
    write_shards(df, str(tmp_path / "out"), 5)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.columns == [*df.columns, "shard_"]
    assert sorted(map(str, got.select(df.columns).collect())) == sorted(map(str, df.collect()))
    placed = assign_shards(df, 5).collect()
    assert sorted((str(r.doc_id), r["shard_"]) for r in got.collect()) == sorted((str(r.doc_id), r.shard) for r in placed)


def test_empty_table(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    assert assign_shards(none).count() == 0
    write_shards(none.drop("shard"), str(tmp_path / "none"), 5)
    assert not [p for p in (tmp_path / "none").iterdir() if p.name.startswith("shard")]
