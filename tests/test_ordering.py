"""Orders and quantiles within groups, one of which holds most rows, against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelith import ordering
from voxelith.operators import clouds as C
from voxelith.operators import scene as N
from voxelith.streaming import folds


@pytest.fixture
def rows():
    r = random.Random(3)
    keys = ["hot"] * 60 + ["b"] * 15 + [None] * 10 + ["one"]
    return [(i, k, r.choice([None, r.randint(0, 9)]), r.randint(-5, 5)) for i, k in enumerate(keys)]


@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_places_and_sums_in_groups(spark, rows, monkeypatch, broadcast):
    monkeypatch.setattr(ordering, "GROUP_ROWS", broadcast)
    df = spark.createDataFrame(rows, "id int, k string, v int, n int")
    got = {r.id: (r.place, r.before) for r in ordering.in_groups(df, ["k"], [F.col("v"), F.col("id")], size="n", unique=True).collect()}
    want = {}
    for k in {k for _, k, _, _ in rows}:
        before = 0
        for place, (i, _, _, n) in enumerate(sorted((r for r in rows if r[1] == k), key=lambda r: (r[2] is not None, r[2] or 0, r[0]))):
            want[i] = (place, before)
            before += n
    assert got == want


def test_groups_of_an_empty_table(spark):
    df = spark.createDataFrame([], "id int, k string")
    assert ordering.in_groups(df, ["k"], [F.col("id")]).collect() == []
    assert ordering.group_quantiles(df, ["k"], "id", {"m": 0.5}).collect() == []


def test_quantiles_of_groups(spark, rows):
    df = spark.createDataFrame(rows, "id int, k string, v int, n int")
    got = {r.k: (r.low, r.mid) for r in ordering.group_quantiles(df, ["k"], "v", {"low": 0.1, "mid": 0.5}).collect()}
    values = {k: [v for _, key, v, _ in rows if key == k and v is not None] for k in {r[1] for r in rows}}
    assert set(got) == {k for k, v in values.items() if v}
    for k, (low, mid) in got.items():
        assert (low, mid) == pytest.approx((np.quantile(values[k], 0.1), np.quantile(values[k], 0.5)))


def test_box_of_all_and_of_axes_without_values(spark):
    points = spark.createDataFrame([("a", float(i), 2.0 * i, None) for i in range(11)], "k string, x double, y double, z double")
    (whole,), (group,) = C.quantile_box(points, 0.1, 0.9).collect(), C.quantile_box(points, 0.1, 0.9, ["k"]).collect()
    assert tuple(whole) == pytest.approx((1.0, 9.0, 2.0, 18.0, None, None))
    assert tuple(group)[1:] == tuple(whole)


def test_first_use_of_equal_rows(spark):
    used = C.first_use(spark.createDataFrame([(1, 5), (1, 5), (1, 7), (None, 1), (None, 2)], "o int, at int"), "o", ["at"])
    assert sorted((r.o or 0, r.cloned) for r in used.collect()) == [(0, False), (0, True), (1, False), (1, True), (1, True)]


def test_clips_by_parts_of_names(spark):
    clips = spark.createDataFrame([("m", 0, "Run_run"), ("m", 1, "Idle"), ("m", 2, None), ("m", 3, "")], "model string, ordinal int, clip string")
    wanted = spark.createDataFrame([("go", 0, "walk"), ("go", 1, "run"), ("stay", 0, "idle"), ("any", 0, ""), ("none", 0, "a longer pattern")], "action string, rank int, pattern string")
    assert sorted(tuple(r) for r in N.find_clips(clips, wanted).collect()) == [("m", "any", "Run_run"), ("m", "go", "Run_run"), ("m", "stay", "Idle")]


@pytest.mark.parametrize("most", [N.PATTERNS, 0])
def test_parts_of_names_are_not_broadcast(spark, monkeypatch, most):
    """Every name is in many parts: only patterns may be broadcast, and only if they are few."""
    monkeypatch.setattr(N, "PATTERNS", most)
    clips = spark.createDataFrame([("m", k, f"Run_{k % 3}") for k in range(9)] + [("m", None, "Run_2"), (None, 1, "run")], "model string, ordinal int, clip string")
    wanted = spark.createDataFrame([("go", 0, "run"), ("go", 1, ""), ("end", 0, "_1")], "action string, rank int, pattern string")
    got = N.find_clips(clips.limit(20), wanted)
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert ("BuildLeft" not in plan) and ("BroadcastHashJoin" in plan) == (most > 0)
    assert {(r.model, r.action): r.clip for r in got.collect()} == {("m", "go"): "Run_2", ("m", "end"): "Run_1", (None, "go"): "run"}


def test_null_key_is_one_key(spark):
    big = 2**60 + 1
    rows = spark.createDataFrame([(k, t, 1.0) for k in (None, 1, big) for t in range(4)], "k bigint, t int, v double")
    got = folds.fold(rows, "k", ["t"], ["v"], (0.0,), lambda s, v: ((s[0] + v[0],), (s[0] + v[0],)), "total double")
    assert sorted(((r.k or 0), r.t, r.total) for r in got.collect()) == [(k, t, t + 1.0) for k in (0, 1, big) for t in range(4)]
