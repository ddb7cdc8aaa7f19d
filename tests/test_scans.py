"""Compositions and neighbours in groups, one of which holds most rows, against plain loops."""

import math
import random

import pytest
from pyspark.sql import functions as F

from voxelith import ordering
from voxelith.streaming import folds, scans, windows


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    keys = ["hot"] * 900 + ["b"] * 80 + [None] * 15 + ["one"]
    r.shuffle(keys)
    return [(i, k, r.choice([None, r.uniform(-5, 5)]) if r.random() < 0.2 else r.uniform(-5, 5), r.choice([0.0, -1.0, r.random()])) for i, k in enumerate(keys)]


def groups(rows):
    out = {}
    for r in rows:
        out.setdefault(r[1], []).append(r)
    return out.values()


KINDS = "id int, k string, target double, dt double"


@pytest.mark.parametrize(("run", "last"), [(64, 4096), (3, 4)])
def test_affine_maps_equal_a_loop(spark, rows, monkeypatch, run, last):
    monkeypatch.setattr(scans, "RUN", run)
    monkeypatch.setattr(scans, "LAST", last)
    gain = F.when(F.col("id") % 37 == 0, 0.0).otherwise(F.col("dt"))
    got = {r.id: r.x for r in scans.affine(spark.createDataFrame(rows, KINDS), ["k"], [F.col("id")], gain, F.coalesce("target", F.lit(1.0)), "x").collect()}
    for g in groups(rows):
        x = 0.0
        for i, _, target, dt in g:
            x = (0.0 if i % 37 == 0 else dt) * x + (1.0 if target is None else target)
            assert got[i] == pytest.approx(x, rel=1e-9, abs=1e-9)
    assert len(got) == len(rows)


def test_following_equals_a_loop(spark, rows):
    df = spark.createDataFrame(rows, KINDS)
    got = {r.id: r.v for r in scans.follow(df, ["k"], [F.col("id")], F.col("target"), F.col("dt"), 3.0, "v").collect()}
    for g in groups(rows):
        v = None
        for i, _, target, dt in g:
            v = None if target is None else target if v is None else v + (target - v) * (1 - math.exp(-max(0.0, dt) * 3))
            assert (got[i] is None) == (v is None) and (v is None or got[i] == pytest.approx(v, rel=1e-9, abs=1e-9))


def test_orientations_equal_a_loop(spark, rows):
    rnd = random.Random(8)
    data = [(i, k, *(rnd.gauss(0, 1) for _ in range(4))) for i, k, _, _ in rows] + [(5000, "hot", 0.0, 0.0, 0.0, 0.0)]
    got = {r.id: r.q for r in scans.orientations(spark.createDataFrame(data, "id int, k string, qx double, qy double, qz double, qw double"), ["k"], [F.col("id")]).collect()}
    for g in groups(data):
        x, y, z, w = 0.0, 0.0, 0.0, 1.0
        for i, _, *q in g:
            n = math.sqrt(sum(v * v for v in q))
            a, b, c, d = [v / n for v in q] if n else (0.0, 0.0, 0.0, 1.0)
            x, y, z, w = w * a + x * d + y * c - z * b, w * b - x * c + y * d + z * a, w * c + x * b - y * a + z * d, w * d - x * a - y * b - z * c
            assert tuple(got[i]) == pytest.approx((x, y, z, w), abs=1e-9)


def test_a_hot_group_is_many_tasks_work(spark, rows, monkeypatch):
    """90 % of the rows have one key; no task has more than a part of them, in any of the tables that are written."""
    written = []
    real = ordering.materialise
    monkeypatch.setattr(ordering, "materialise", lambda df, name, *a: written.append(real(df, name, *a)) or written[-1])
    scans.affine(spark.createDataFrame(rows, KINDS), ["k"], [F.col("id")], F.lit(0.5), F.lit(1.0), "x")
    files = written[0].groupBy(F.input_file_name()).count().collect()
    assert len(files) >= 3 and max(r["count"] for r in files) < 0.6 * len(rows)


def test_neighbours_equal_a_loop(spark, rows):
    df = spark.createDataFrame([(*r, 1) for r in rows], KINDS + ", pos int").repartition(3)
    got = {r.id: (r.prev and r.prev.dt, r.next and r.next.dt) for r in ordering.with_neighbours(df, ["k"], [F.col("id")], ["dt"]).collect()}
    for g in groups(rows):
        for before, r, after in zip([None, *g], g, [*g[1:], None]):
            assert got[r[0]] == (before and before[3], after and after[3])
    assert ordering.with_neighbours(df.where("false").drop("pos"), ["k"], [F.col("id")], ["dt"]).count() == 0


def test_no_rows(spark):
    df = spark.createDataFrame([], KINDS)
    assert scans.affine(df, ["k"], [F.col("id")], F.lit(1.0), F.lit(1.0), "x").count() == 0


def starts(rows, gap):
    out, since = {}, {}
    for i, k, at in sorted(rows, key=lambda r: (r[2], r[0])):
        out[i] = k not in since or at >= since[k] + gap
        if out[i]:
            since[k] = at
    return out


@pytest.mark.parametrize("gap", [700, 10**6])
def test_windows_start_as_in_a_loop(spark, gap):
    rnd = random.Random(gap)
    rows = [(i, rnd.choice(["hot"] * 9 + ["b", None]), rnd.randrange(3000)) for i in range(500)] + [(900 + i, "same", 7) for i in range(9)]
    df = spark.createDataFrame(rows, "id int, k string, t bigint").repartition(4)
    want = starts(rows, gap)
    assert {r.id: r.starts for r in windows.chain(df, "k", "t", gap, ["id"]).collect()} == want
    start, step, out, _ = folds.window_starts(gap)
    assert {r.id: r.starts for r in folds.fold(df, "k", ["t", "id"], ["t"], start, step, out).collect()} == want
    told = sorted((str(r.k), r.start, r.n, r.id) for r in windows.throttle_from_first(df, "k", "t", gap, "id", ["id"]).collect())
    loop, at = [], {}
    for i, k, t in sorted(rows, key=lambda r: (r[2], r[0])):
        if want[i]:
            at[k] = len(loop)
            loop.append([str(k), t, 0, 0])
        loop[at[k]][2:] = [loop[at[k]][2] + 1, i]
    assert told == sorted(map(tuple, loop))


def test_windows_start_alike_in_a_stream(spark, tmp_path):
    rnd = random.Random(1)
    rows = [(i, rnd.choice("ab"), i * 3 + rnd.randrange(3)) for i in range(200)]
    kinds = "id int, k string, t bigint"
    for part in range(4):
        spark.createDataFrame(rows[part * 50 : part * 50 + 50], kinds).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
    start, step, out, state = folds.window_starts(20)
    stream = spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).option("latestFirst", "false").json(f"{tmp_path}/in")
    folds.fold_stream(stream, "k", ["t", "id"], ["t"], start, step, out, state).writeStream.format("memory").queryName("window_starts").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination(200)
    got = {r.id: r.starts for r in spark.table("window_starts").collect()}
    assert got == {r.id: r.starts for r in windows.chain(spark.createDataFrame(rows, kinds), "k", "t", 20, ["id"]).collect()}


def test_no_windows_without_rows(spark):
    df = spark.createDataFrame([], "id int, k string, t bigint")
    assert windows.chain(df, "k", "t", 5, ["id"]).count() == 0 and windows.throttle_from_first(df, "k", "t", 5, "id", ["id"]).count() == 0
