"""Chunked levels of detail against a recursive split and a search over code prefixes."""

import json
import random

import numpy as np
import pytest

from voxelith.__main__ import document, parser
from voxelith.operators import chunk_lod, clouds
from voxelith.plans import tasks

KINDS = ", ".join(f"{c} double" for c in chunk_lod.BODY)
LEVELS = [(1.0, 1.0), (0.5, 1.0), (0.1, 1.5)]


def gaussian(rnd, p, a=0.9):
    return (*p, *[0.1 + rnd.random() / 10] * 3, 0.0, 0.0, 0.0, 1.0, *(rnd.random() for _ in range(3)), a)


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(5)
    near = [gaussian(rnd, [rnd.gauss(2, 0.05) for _ in range(3)]) for _ in range(300)]
    wide = [gaussian(rnd, [rnd.uniform(-9, 9) for _ in range(3)]) for _ in range(150)]
    same = [gaussian(rnd, (1.0, 1.0, 1.0)) for _ in range(40)]
    flat = [(*g[:5], 0.0, *g[6:]) for g in wide[:5]]
    return near + wide + same + flat


def codes(rows):
    low = [min(r[i] for r in rows) for i in range(3)]
    side = max(max(r[i] for r in rows) - low[i] for i in range(3))
    out = []
    for r in rows:
        cell = [min(int((r[i] - low[i]) / side * 2**20), 2**20 - 1) for i in range(3)]
        out.append(sum((cell[i] >> b & 1) << (3 * b + i) for b in range(20) for i in range(3)))
    return out


def split(some, limit, level=0, deepest=12):
    if len(some) <= limit or level == deepest:
        return [some] if some else []
    up = 3 * (20 - level - 1)
    return [part for k in range(8) for part in split([c for c in some if c >> up & 7 == k], limit, level + 1, deepest)]


def test_chunks_and_levels_equal_brute_force(spark, rows):
    got = chunk_lod.build(spark.createDataFrame(rows, KINDS), 60, LEVELS)
    counts = {(r.chunk_id, r.level): r["count"] for r in got.groupBy("chunk_id", "level").count().collect()}
    want = {}
    for i, chunk in enumerate(split(sorted(codes(rows)), 60)):
        want[i, 0] = len(chunk)
        for level, (share, _) in enumerate(LEVELS[1:], 1):
            target = max(1, int(len(chunk) * share))
            want[i, level] = max(n for n in (len({c >> (60 - k) for c in chunk}) for k in range(61)) if n <= target)
    assert counts == want
    first = got.where("level = 0").select(*chunk_lod.BODY).collect()
    assert sorted(map(tuple, first)) == sorted(rows)
    wide = got.where("level = 2").selectExpr("min(sx) AS low").first().low
    assert wide >= 0.1 * 1.5 * 0.999


def test_levels_without_rows_or_places(spark, rows):
    assert chunk_lod.build(spark.createDataFrame([], KINDS), 60, LEVELS).count() == 0
    inf = float("inf")
    odd = [(None, *rows[0][1:]), (float("nan"), *rows[1][1:]), (inf, *rows[1][1:]), (0.0, -inf, *rows[1][2:]), *rows[:1]]
    got = chunk_lod.build(spark.createDataFrame(odd, KINDS), 60, LEVELS).collect()
    assert [(r.chunk_id, r.level) for r in got] == [(0, 0), (0, 1), (0, 2)]
    faint = chunk_lod.build(spark.createDataFrame([(*r[:-1], 0.0) for r in rows[:9]], KINDS), 60, LEVELS, faint=1 / 255)
    assert {r.level for r in faint.collect()} == {0}


def test_rows_at_infinity_change_nothing(spark, rows):
    inf = float("inf")
    count = lambda data: sorted((r.chunk_id, r.level, r["count"]) for r in chunk_lod.build(spark.createDataFrame(data, KINDS), 100, LEVELS).groupBy("chunk_id", "level").count().collect())
    odd = [(inf, *rows[0][1:]), (0.0, -inf, *rows[0][2:]), (0.0, 0.0, float("nan"), *rows[0][3:])]
    assert count(rows + odd) == count(rows)


def test_crowded_cells_are_split_to_the_finest(spark):
    rnd = random.Random(9)
    far = [gaussian(rnd, p) for p in ((0.0, 0.0, 0.0), (1.0, 1.0, 1.0))]
    clump = [gaussian(rnd, [0.7 + rnd.random() * 1e-4 for _ in range(3)]) for _ in range(300)] + [gaussian(rnd, (0.2, 0.2, 0.2))] * 30
    data = far + clump
    got = chunk_lod.build(spark.createDataFrame(data, KINDS), 20, LEVELS[:1]).groupBy("chunk_id").count().orderBy("chunk_id").collect()
    assert [r["count"] for r in got] == [len(s) for s in split(sorted(codes(data)), 20, deepest=20)]
    assert max(r["count"] for r in got) == 30


def matrix(q):
    x, y, z, w = q
    return np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]])


def covariance(r):
    t = matrix(r[6:10])
    return t @ np.diag(np.square(r[3:6])) @ t.T


def test_merged_covariance_is_the_mixtures(spark):
    rng = np.random.default_rng(4)
    rows = []
    for g in range(40):
        for _ in range(1 + g % 5):
            q = rng.normal(size=4) if g % 4 else np.array([0.0, 0, 0, 1])
            rows.append((g, *map(float, rng.normal(size=3)), *map(float, rng.uniform(0.01, 2, 3)), *map(float, q / np.linalg.norm(q)), *map(float, rng.uniform(0.1, 0.9, 4))))
    got = {r.grp: tuple(r)[2:] for r in clouds.merge_gaussians(spark.createDataFrame(rows, f"grp int, {KINDS}"), ["grp"]).collect()}
    for g in range(40):
        some = [r[1:] for r in rows if r[0] == g]
        w = np.array([r[13] * r[3] * r[4] * r[5] for r in some])
        p = np.array([r[:3] for r in some])
        m = w @ p / w.sum()
        want = sum(v * (covariance(r) + np.outer(r[:3] - m, r[:3] - m)) for v, r in zip(w, some)) / w.sum()
        assert np.allclose(covariance(got[g]), want, rtol=0, atol=1e-9) and np.allclose(got[g][:3], m)
        if len(some) == 1 and g % 4 == 0:
            assert np.allclose(got[g][3:10], some[0][3:10])


def test_task_writes_a_directory(spark, tmp_path, rows):
    spark.createDataFrame(rows, KINDS).write.parquet(f"{tmp_path}/a.parquet")
    args = ["lod:auto-chunk", "--max-chunk-counts", "100", f"{tmp_path}/a.parquet", f"{tmp_path}/lod"]
    res = tasks.run(spark, document(parser().parse_args(args)))
    meta = json.loads((tmp_path / "lod" / "lod-meta.json").read_text())
    assert meta["levels"] == 5 and meta["counts"] == len(rows) == res["c"].where("level = 0").count()
    parts = spark.read.parquet(f"{tmp_path}/lod/data")
    assert parts.count() == res["c"].count() == sum(v["count"] for n in meta["tree"] for v in n["lods"])
    inside = sum(all(low <= r[i] <= high for i, (low, high) in enumerate(zip(*meta["forwardBox"].values()))) for r in rows)
    assert inside >= 0.8 * len(rows)
    with pytest.raises(ValueError, match="no writer for chunks"):
        tasks.run(spark, document(parser().parse_args([args[0], "--type", "sog", *args[1:]])))


def test_documents_of_commands():
    ends = [("Read", {"inputs": ["a.ply"], "output": "c"}), ("Write", {"input": "c", "output": "b.splat"})]
    told = lambda *a: [(t["type"], t["config"]) for t in document(parser().parse_args(a))["tasks"]]
    assert told("create", "a.ply", "b.splat") == ends
    assert told("lod:auto", "--ratio", "0.5", "a.ply", "b.splat") == [ends[0], ("AutoLod", {"input": "c", "output": "c", "ratio": 0.5}), ends[1]]
