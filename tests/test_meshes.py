"""Rays and capsules against every triangle, one pair at a time, and how many pairs are met."""

import random

import numpy as np
import pytest

from voxelith.operators import meshes as M
from voxelith.plans import cloud_queries as Q
from voxelith.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"
TRI = "tri_id bigint, " + ", ".join(f"{n}{a} double" for n in M.CORNERS for a in "xyz")
RAY = "ray_id bigint, ox double, oy double, oz double, dx double, dy double, dz double, max_t double"


def soup(seed, n=250):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        size = rnd.choice([0.05, 0.3, 1, 4, 30])
        mid = [rnd.uniform(-20, 20) for _ in range(3)]
        out.append((i, *(m + rnd.gauss(0, size) for _ in range(3) for m in mid)))
    flat = [(n + k, *(float(v) for v in c)) for k, c in enumerate([(0, 0, 0, 4, 0, 0, 0, 0, 4), (4, 0, 0, 4, 0, 4, 0, 0, 4), (2, 2, 2, 2, 2, 2, 2, 2, 2), (0, 0, 0, 4, 0, 0, 0, 0, 4)])]
    return out + flat + [(n + 9, float("inf"), *[0.0] * 8), (n + 10, float("nan"), *[0.0] * 8)]


def hit(o, d, k):
    a, b, c = k
    e1, e2 = b - a, c - a
    p = np.cross(d, e2)
    det = e1 @ p
    if not abs(det) >= 1e-10:
        return None
    u, q = (o - a) @ p / det, np.cross(o - a, e1)
    v, t = d @ q / det, e2 @ q / det
    return t if u >= 0 and v >= 0 and u + v <= 1 and t >= 0 else None


@pytest.mark.parametrize(("cell", "waves"), [(1.0, 4), (0.25, 1), (8.0, 6)])
def test_first_hits_equal_all_pairs(spark, cell, waves):
    rnd = random.Random(2)
    rays = [(i, *(rnd.uniform(-25, 25) for _ in range(3)), *(rnd.gauss(0, 1) for _ in range(3)), rnd.choice([3.0, 100.0, 1e9])) for i in range(150)]
    rays += [(200 + i, float(i), 9.0, 1.0, 0.0, -1.0, 0.0, 50.0) for i in range(6)] + [(300, 1.0, 1.0, 1.0, 0.0, 0.0, 0.0, 9.0), (301, 1.0, 5.0, 1.0, 0.0, -1e-9, 0.0, 9.0), (302, float("nan"), 0.0, 0.0, 1.0, 0.0, 0.0, 9.0), (303, 0.0, 2.0, 0.0, 0.0, -1.0, 0.0, 9.0)]
    tris = soup(1)
    want = {}
    for r in rays:
        o, d = np.array(r[1:4]), np.array(r[4:7])
        if not np.linalg.norm(d) >= 1e-8 or not np.isfinite(o).all():
            continue
        d = d / np.linalg.norm(d)
        found = [(t, k[0]) for k in tris if np.isfinite(k[1:]).all() and (t := hit(o, d, np.array(k[1:]).reshape(3, 3))) is not None and t <= r[7]]
        if found:
            want[r[0]] = min((round(t, 9), k) for t, k in found)
    got = {r.ray_id: (round(r.t, 9), r.tri_id) for r in M.first_hit(spark.createDataFrame(rays, RAY), spark.createDataFrame(tris, TRI), cell, waves).collect()}
    assert got == want


def near_triangle(p, k):
    a, b, c = k
    out = []
    for s, e in ((a, b), (b, c), (c, a)):
        d = e - s
        out.append(s + d * (np.clip((p - s) @ d / (d @ d), 0, 1) if d @ d else 0))
    n = np.cross(b - a, c - a)
    if n @ n:
        q = p - n * ((p - a) @ n / (n @ n))
        inside = all(np.cross(e - s, q - s) @ n >= 0 for s, e in ((a, b), (b, c), (c, a)))
        out += [q] if inside else []
    return min(out, key=lambda q: (p - q) @ (p - q))


def push(capsule, k):
    """Samples along the middle line, the best refined once by the line's point nearest to it; see the operator."""
    p, half, radius = np.array(capsule[1:4]), capsule[4], capsule[5]
    k = np.array(k).reshape(3, 3)
    at = [p + np.array([0, half * (i * 2 / 5 - 1), 0]) for i in range(6)]
    s, t = min(((s, near_triangle(s, k)) for s in at), key=lambda x: round(float((x[0] - x[1]) @ (x[0] - x[1])), 12))
    g = p + np.array([0, np.clip(t[1] - p[1], -half, half), 0])
    h = near_triangle(g, k)
    if (g - h) @ (g - h) < (s - t) @ (s - t):
        s, t = g, h
    dist = np.linalg.norm(s - t)
    return radius - dist if dist < radius and radius - dist > 1e-4 else 0.0


def test_capsules_equal_all_pairs(spark):
    rnd = random.Random(6)
    tris = [k for k in soup(3) if np.isfinite(k[1:]).all() and k[1:4] != k[4:7]]
    capsules = [(i, *(rnd.uniform(-22, 22) for _ in range(3)), rnd.choice([0.0, 0.9, 3.0]), rnd.choice([0.3, 1.5])) for i in range(60)]
    df = spark.createDataFrame(capsules, "capsule_id bigint, x double, y double, z double, half_height double, radius double")
    got = {r.capsule_id: r for r in M.capsule_push(df, spark.createDataFrame(tris, TRI)).collect()}
    for c in capsules:
        depth = max(push(c, k[1:]) for k in tris)
        assert (c[0] in got) == (depth > 0)
        if depth > 0:
            assert got[c[0]].depth == pytest.approx(depth, abs=1e-5)
            assert np.linalg.norm([got[c[0]].px, got[c[0]].py, got[c[0]].pz]) == pytest.approx(depth, abs=1e-5)


def test_capsules_among_crossing_triangles_write_no_pairs(spark, monkeypatch):
    """Every triangle crosses every capsule's box; in pieces of a few rows. Some capsules are close to one, some aren't."""
    wrote, write = [], M.materialise

    def counted(df, *rest):
        out = write(df, *rest)
        wrote.append(out.count())
        return out

    monkeypatch.setattr(M, "materialise", counted)
    monkeypatch.setattr(M, "PIECE", 9)
    rnd = random.Random(8)
    tris = [(i, *(v for _ in range(3) for v in (rnd.uniform(-1, 1), rnd.uniform(-1, 1), rnd.uniform(-1, 1)))) for i in range(150)]
    tris += [(1000 + i, *k[1:]) for i, k in enumerate(tris[:20])] + [(2000, 0.4, -1.0, -1.0, 0.4, 1.0, -1.0, 0.4, 0.0, 1.0)]
    capsules = [(i, *(rnd.uniform(-1.6, 1.6) for _ in range(3)), rnd.choice([0.0, 0.9]), rnd.choice([0.3, 0.6])) for i in range(60)]
    df = spark.createDataFrame(capsules, "capsule_id bigint, x double, y double, z double, half_height double, radius double")
    got = {r.capsule_id: r for r in M.capsule_push(df, spark.createDataFrame(tris, TRI)).collect()}
    for c in capsules:
        depth = max(push(c, k[1:]) for k in tris)
        assert (c[0] in got) == (depth > 0)
        assert depth == 0 or got[c[0]].depth == pytest.approx(depth, abs=1e-9)
    assert max(wrote) < len(capsules) * len(tris) / 3


def test_the_query_of_all_splats_equals_all_pairs(spark):
    tris = [tuple(r[c] for c in ("tri_id", *(f"{n}{a}" for n in M.CORNERS for a in "xyz"))) for r in Q.tris(spark, SF).collect()]
    got = {r.capsule_id: r.depth for r in QUERIES["capsule_mesh"](spark, SF).collect()}
    for r in Q.splats(spark, SF).select("splat_id", "x", "y", "z").where("splat_id % 7 = 0").collect():
        depth = max(push((0, r.x * 8, r.y * 8, r.z * 8, 0.9, 0.6), k[1:]) for k in tris)
        assert got.get(r.splat_id, 0.0) == pytest.approx(depth, abs=1e-5)


def test_small_triangles_meet_few_rays(spark):
    """A terrain of small triangles under many rays: pairs met are near the pairs that hit, not all pairs."""
    n = 30
    quads = [(float(x), float(z)) for x in range(n) for z in range(n)]
    tris = [(2 * i + k, *c) for i, (x, z) in enumerate(quads) for k, c in enumerate([(x, 0.0, z, x + 1, 0.0, z, x, 0.0, z + 1), (x + 1, 0.0, z, x + 1, 0.0, z + 1, x, 0.0, z + 1)])]
    t = M.dealt(spark.createDataFrame(tris, TRI))
    assert t.groupBy("tri_id").count().agg({"count": "max"}).first()[0] <= 8 * 3
    rays = [(i, x + 0.3, 40.0, z + 0.4, 0.0, -1.0, 0.0, 100.0) for i, (x, z) in enumerate(quads)]
    got = M.first_hit(spark.createDataFrame(rays, RAY), spark.createDataFrame(tris, TRI)).collect()
    assert {(r.ray_id, r.tri_id, r.t) for r in got} == {(i, 2 * i, 40.0) for i in range(n * n)}


def test_far_rays_meet_the_first_sheets_only(spark, monkeypatch):
    """Twenty sheets of triangles, rays from far above: a ray isn't compared with what lies behind its hit, nor rows made of pairs."""
    met, pieces = [], M.in_pieces

    def counted(left, right, *rest):
        met.append(left.join(right, M.KEY).count())
        return pieces(left, right, *rest)

    monkeypatch.setattr(M, "in_pieces", counted)
    monkeypatch.setattr(M, "PIECE", 7)
    monkeypatch.setattr(M, "GROUP_ROWS", 50)
    tris = [(10 * y + k, -9.0, float(y), -9.0, 9.0, float(y), -9.0, -9.0, float(y), 9.0) for y in range(20) for k in range(5)]
    rays = [(i, -8 + i % 10 * 0.7, 500.0, -8 + i // 10 * 0.7, 0.0, -1.0, 0.0, 1e4) for i in range(100)]
    got = M.first_hit(spark.createDataFrame(rays, RAY), spark.createDataFrame(tris, TRI)).collect()
    assert {(r.ray_id, r.tri_id, r.t) for r in got} == {(i, 190, 481.0) for i in range(100)}
    assert sum(met) < len(rays) * len(tris) / 3


def test_no_triangles_and_no_rays(spark):
    t, r = spark.createDataFrame(soup(1, 3), TRI), spark.createDataFrame([(1, 0.0, 9.0, 0.0, 0.0, -1.0, 0.0, 50.0)], RAY)
    assert M.first_hit(r, t.where("false")).count() == 0
    assert M.first_hit(r.where("false"), t).count() == 0
    c = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 1.0, 1.0)], "capsule_id bigint, x double, y double, z double, half_height double, radius double")
    assert M.capsule_push(c, t.where("false")).count() == 0
