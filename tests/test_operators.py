"""Operators against plain loops and hand-made cases."""

import itertools
import math
import random
import time

import pytest
from pyspark.sql import functions as F

from voxelith.functions import text as T
from voxelith.functions import vectors as X
from voxelith.operators import clouds as C
from voxelith.operators import corpus as K
from voxelith.operators import manifests as L
from voxelith.operators import meshes as M
from voxelith.operators import ray_paths as P
from voxelith.operators import voxels as V
from voxelith.operators import octree
from voxelith.plans import tasks
from voxelith.storage import written
from voxelith.streaming import folds as S
from voxelith.streaming import windows as W

GRID = V.Grid(cell=(1.0, 1.0, 1.0))


def cells(spark, some):
    return spark.createDataFrame(sorted(some), "ix bigint, iy bigint, iz bigint")


def test_each_bit_of_a_leaf(spark):
    for x, y, z in ((0, 0, 0), (3, 3, 1), (0, 0, 2), (3, 3, 3)):  # bits 0, 31, 32 and 63
        (m,) = V.leaf_masks(cells(spark, [(x, y, z)])).collect()
        assert m.lo | m.hi << 32 == 1 << (z * 16 + y * 4 + x) and not m.solid
    (m,) = V.leaf_masks(cells(spark, set(itertools.product(range(4), repeat=3)))).collect()
    assert m.solid and V.leaf_masks(cells(spark, [(0, 0, 0)]).where("false")).count() == 0


def test_surface_leaves_the_inside_out(spark):
    cube = set(itertools.product(range(5), repeat=3))
    got = {tuple(r) for r in V.surface(cells(spark, cube)).collect()}
    assert got == {p for p in cube if 0 in p or 4 in p}


def test_rays(spark):
    some = cells(spark, {(3, 0, 0), (5, 0, 0), (0, 2, 0), (2, 2, 2)})
    rays = [
        (1, 0.5, 0.5, 0.5, 1.0, 0.0, 0.0, 10.0),  # along x to cell 3
        (2, 0.5, 0.5, 0.5, 2.0, 0.0, 0.0, 1.0),  # too short: a direction of length 2 doubles it, still not 3
        (3, 3.5, 0.5, 0.5, 1.0, 0.0, 0.0, 10.0),  # starts inside
        (4, 0.5, 9.5, 0.5, 0.0, -1.0, 0.0, 20.0),  # down
        (5, 0.5, 0.0, 0.5, 1.0, 0.0, 0.0, 10.0),  # on the lower border: inside
        (6, 0.5, 10.0, 0.5, 1.0, 0.0, 0.0, 10.0),  # on the upper border: outside
        (7, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0, 10.0),  # through corners
        (8, -5.0, 0.5, 0.5, 1.0, 0.0, 0.0, 100.0),  # enters the box
    ]
    df = spark.createDataFrame(rays, "ray_id bigint, ox double, oy double, oz double, dx double, dy double, dz double, max_t double")
    got = {r.ray_id: (round(r.t, 9), r.ix, r.iy, r.iz) for r in P.first_hit(df, some, GRID, (0, 0, 0), (10, 10, 10)).collect()}
    assert got == {1: (2.5, 3, 0, 0), 3: (0.0, 3, 0, 0), 4: (6.5, 0, 2, 0), 5: (2.5, 3, 0, 0), 7: (2.0, 2, 2, 2), 8: (8.0, 3, 0, 0)}
    down = V.first_hit_down(df.where("ray_id = 4"), some, GRID).first()
    assert (down.hit_y, down.t, down.iy) == (3.0, 6.5, 2)


def test_capsules(spark):
    floor = cells(spark, set(itertools.product(range(-3, 4), [0], range(-3, 4))))
    caps = spark.createDataFrame([(1, 0.5, 2.2, 0.5, 0.5, 1.0), (2, 0.5, 9.0, 0.5, 0.5, 1.0), (3, 0.4, 0.5, 0.5, 0.1, 0.3)], "capsule_id bigint, x double, y double, z double, half_height double, radius double")
    got = {r.capsule_id: r for r in V.capsule_push(caps, floor, GRID).collect()}
    assert set(got) == {1, 3}
    assert got[1].py == pytest.approx(0.3) and got[1].px == 0
    assert got[3].px == pytest.approx(-0.7)  # the middle line is inside: x is the least way
    out = {r.capsule_id: r for r in V.depenetrate(caps, floor, GRID).collect()}
    assert out[1].py == pytest.approx(0.3, abs=1e-3)


def pushed_out(p, half, r, solid, size):
    """The deepest push of a capsule out of voxels by a plain loop: depth and vector, or None."""
    best = None
    for c in sorted(solid, key=lambda c: c[::-1]):  # z, y, x: of equal depths the first counts
        lo = [i * s for i, s in zip(c, size)]
        hi = [v + s for v, s in zip(lo, size)]
        bottom, top = p[1] - half, p[1] + half
        y = top if top < lo[1] else bottom if bottom > hi[1] else max(bottom, min(top, (lo[1] + hi[1]) * 0.5))
        q = [p[0], y, p[2]]
        off = [v - max(a, min(b, v)) for v, a, b in zip(q, lo, hi)]
        d2 = off[0] * off[0] + off[1] * off[1] + off[2] * off[2]
        if d2 >= r * r:
            continue
        if d2 > 1e-12:
            d = math.sqrt(d2)
            depth, push = r - d, [v * ((r - d) / d) for v in off]
        else:
            way = [min(v - a, b - v) + r for v, a, b in zip(q, lo, hi)]
            depth, push = min(way), [0.0, 0.0, 0.0]
            k = way.index(depth)
            push[k] = -depth if q[k] - lo[k] < hi[k] - q[k] else depth
        if depth > 1e-4 and (best is None or depth > best[0]):
            best = depth, push
    return best


def taken_out(p, half, r, solid, size, rounds=4):
    total, normals = [0.0] * 3, []
    for _ in range(rounds):
        got = pushed_out([a + b for a, b in zip(p, total)], half, r, solid, size)
        if got is None:
            break
        push = got[1]
        for n in normals:
            dot = min(sum(a * b for a, b in zip(push, n)), 0.0)
            push = [a - dot * b for a, b in zip(push, n)]
        if len(normals) < 3:
            normals.append([v / math.hypot(*got[1]) for v in got[1]])
        total = [a + b for a, b in zip(total, push)]
    return total if math.hypot(*total) > 1e-4 else None


CAPSULES = "capsule_id bigint, x double, y double, z double, half_height double, radius double"


@pytest.mark.parametrize("few", [1 << 18, 0])
def test_capsules_of_all_sizes_as_a_plain_loop_has_them(spark, monkeypatch, few):
    monkeypatch.setattr(V, "FEW_WINDOWS", few)  # 0: windows are joined by a shuffle
    rng, size = random.Random(5), (1.0, 2.0, 0.75)
    grid = V.Grid(cell=size)
    solid = {c for c in itertools.product(range(-4, 4), range(-3, 3), range(-5, 5)) if rng.random() < 0.4}
    caps = [(i, *(rng.uniform(-4.5, 4.5) for _ in range(3)), *((rng.uniform(0, 1), rng.uniform(0, 0.7)) if i % 5 else (rng.uniform(1, 3), rng.uniform(0.75, 2)))) for i in range(300)]
    caps += [(300, 0.5, 1.0, 0.375, 0.25, 0.25), (301, -1.0, -2.0, -0.75, 0.5, 0.5), (302, 1.0, 0.0, 0.0, 0.0, 0.0)]  # in the middle and on corners, where depths are equal
    df, some = spark.createDataFrame(caps, CAPSULES), cells(spark, solid)
    once = {c[0]: got for c in caps if (got := pushed_out(c[1:4], *c[4:], solid, size))}
    found = {r.capsule_id: r for r in V.capsule_push(df, some, grid).collect()}
    assert set(found) == set(once) and len(once) > 150
    for i, (depth, push) in once.items():
        assert found[i].depth == pytest.approx(depth) and [found[i].px, found[i].py, found[i].pz] == pytest.approx(push)
    whole = {c[0]: got for c in caps if (got := taken_out(c[1:4], *c[4:], solid, size))}
    found = {r.capsule_id: [r.px, r.py, r.pz] for r in V.depenetrate(df, some, grid).collect()}
    assert set(found) == set(whole) and all(found[i] == pytest.approx(t) for i, t in whole.items())
    assert all(sum((i % 5 == 0) == wide for i in whole) > 30 for wide in (True, False))


def test_rounds_of_pushes_write_no_row_for_each_capsule(spark):
    floor = cells(spark, set(itertools.product(range(-3, 4), [0], range(-3, 4))))
    df = spark.createDataFrame([(i, 0.5, 2.2, 0.5, 0.3, 0.6) for i in range(50)], CAPSULES)
    since = written()
    got = V.depenetrate(df, floor, GRID)
    assert got.count() == 0 and written() - since == 1  # the windows; it was two tables for each round before
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "SortMergeJoin" not in plan


def test_capsules_that_share_an_id_or_have_none(spark):
    floor = cells(spark, set(itertools.product(range(-3, 4), [0], range(-3, 4))))
    odd = [(1, 0.5, 1.7, 0.5, 0.3, 0.6), (1, 0.5, 1.8, 0.5, 0.3, 0.6), (None, 0.5, 1.6, 0.5, 0.3, 0.6), (2, None, 1.5, 0.5, 0.3, 0.6), (3, 0.5, math.nan, 0.5, 0.3, 0.6), (4, 0.5, 1.5, 0.5, 0.3, None), (5, math.inf, 1.5, 0.5, 0.3, 0.6)]
    for far in (0.0, 0.5):  # reaching less than a cell, and more
        df = spark.createDataFrame([(*c[:2], c[2] and c[2] + far, c[3], c[4] + far, c[5]) for c in odd], CAPSULES)
        got = sorted((r.capsule_id or 0, round(r.py, 6)) for r in V.depenetrate(df.where("capsule_id IS NULL OR capsule_id < 5"), floor, GRID).collect())
        assert got == [(0, 0.3), (1, 0.1), (1, 0.2)]
        one = {r.capsule_id: round(r.py, 6) for r in V.capsule_push(df.where("capsule_id < 5"), floor, GRID).collect()}
        assert one == {1: 0.2}  # a row for each id, the deepest
    assert V.depenetrate(df.where("false"), floor, GRID).count() == V.depenetrate(df, floor.where("false"), GRID).count() == 0


def test_reachable(spark):
    wall = {(2, y, 0) for y in range(4)} | {(x, 4, 0) for x in range(3)}
    got = {(r.ix, r.iy): r.steps for r in V.reachable(cells(spark, wall), (0, 0, 0), (0, 0, 0), (5, 6, 1)).collect()}
    assert set(got) == {(x, y) for x in range(2) for y in range(4)} and got[(1, 3)] == 4
    assert V.reachable(cells(spark, wall), (2, 0, 0), (0, 0, 0), (5, 6, 1)).count() == 0


def near_triangle(p, a, b, c):
    """The nearest of many points of the triangle."""
    best = None
    for i in range(61):
        for j in range(61 - i):
            u, v = i / 60, j / 60
            q = [a[k] + (b[k] - a[k]) * u + (c[k] - a[k]) * v for k in range(3)]
            d = math.dist(p, q)
            best = d if best is None else min(best, d)
    return best


def test_nearest_points_of_triangles(spark):
    rnd = random.Random(2)
    tri = [tuple(rnd.uniform(-1, 1) for _ in range(3)) for _ in range(3)]
    pts = [tuple(rnd.uniform(-2, 2) for _ in range(3)) for _ in range(40)]
    names = [f"{n}{a}" for n in ("p", "ka", "kb", "kc") for a in "xyz"]
    df = spark.createDataFrame([(*p, *tri[0], *tri[1], *tri[2]) for p in pts], ", ".join(f"{n} double" for n in names))
    one = M.nearest(df, "p", "q").collect()
    two = df.select("px", "py", "pz", *X.closest_on_triangle(X.vec("p"), X.vec("ka"), X.vec("kb"), X.vec("kc")).named("q")).collect()
    for r, s in zip(one, two):
        p, q = (r.px, r.py, r.pz), (r.qx, r.qy, r.qz)
        assert q == pytest.approx((s.qx, s.qy, s.qz), abs=1e-9)
        assert math.dist(p, q) <= near_triangle(p, *tri) + 1e-9 and math.dist(p, q) >= near_triangle(p, *tri) - 0.05


def test_mesh_rays_and_capsules(spark):
    tri = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 4.0, 0.0, 0.0, 0.0, 0.0, 4.0), (2, 0.0, 1.0, 0.0, 4.0, 1.0, 0.0, 0.0, 1.0, 4.0)], "tri_id bigint, " + ", ".join(f"{n}{a} double" for n in M.CORNERS for a in "xyz"))
    cols = "ray_id bigint, ox double, oy double, oz double, dx double, dy double, dz double, max_t double"
    rays = spark.createDataFrame([(1, 1.0, 5.0, 1.0, 0.0, -2.0, 0.0, 50.0), (2, 1.0, -5.0, 1.0, 0.0, 1.0, 0.0, 50.0), (3, 1.0, 5.0, 1.0, 1.0, 0.0, 0.0, 50.0), (4, 1.0, 5.0, 1.0, 0.0, 0.0, 0.0, 50.0), (5, 1.0, 5.0, 1.0, 0.0, -1.0, 0.0, 3.0)], cols)
    assert {(r.ray_id, r.t, r.tri_id) for r in M.first_hit(rays, tri).collect()} == {(1, 4.0, 2), (2, 5.0, 1)}
    caps = spark.createDataFrame([(1, 1.0, 2.3, 1.0, 0.9, 0.6), (2, 1.0, 9.0, 1.0, 0.9, 0.6)], "capsule_id bigint, x double, y double, z double, half_height double, radius double")
    (got,) = M.capsule_push(caps, tri.where("tri_id = 2")).collect()
    assert got.capsule_id == 1 and got.py == pytest.approx(0.2) and got.depth == pytest.approx(0.2)
    flat = spark.createDataFrame([(1, *[0.0] * 9)], "tri_id bigint, " + ", ".join(f"{n}{a} double" for n in M.CORNERS for a in "xyz"))
    assert M.prepared(flat).select("nx", "ny", "nz").first() == (0.0, 0.0, 0.0)


def test_triangle_soup(spark):
    world = [float(v) for v in (1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, 10, 0, 0, 1)]
    pos = [float(v) for v in (0, 0, 0, 1, 0, 0, 0, 1, 0, 5, 5, 5)]
    df = spark.createDataFrame([(1, pos, [0, 1, 3], world), (2, pos[:9], None, world), (3, [], None, world)], "mesh_id int, positions array<double>, idx array<int>, world array<double>")
    got = {r.mesh_id: (r.kax, r.kbx, r.kcx, r.kcz) for r in M.soup(df).collect()}
    assert got == {1: (10.0, 11.0, 15.0, 5.0), 2: (10.0, 11.0, 10.0, 0.0)}


def test_half_equals_numpy(spark):
    import numpy as np

    v = [0.0, 1.0, 1 / 3, -2.5e-5, 6e-8, 2049.0, 65504.0, 1e6, -1234.567]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in v], "x double").select(C.half(F.col("x"))).collect()]
    with np.errstate(over="ignore"):
        assert got == [float(np.float16(x)) for x in v]


def test_transform_turns_rotations(spark):
    s = spark.createDataFrame([(1, 1.0, 0.0, 0.0, 1.0, 1.0, 1.0, 0.0, 0.0, 0.0, 1.0)], "splat_id bigint, x double, y double, z double, sx double, sy double, sz double, qx double, qy double, qz double, qw double")
    quarter = [0.0, -2, 0, 1, 2, 0, 0, 0, 0, 0, 2, 0, 0, 0, 0, 1]  # a quarter turn about z, doubled, moved along x
    r = C.transform(s, quarter).first()
    assert (r.x, r.y, r.z, r.sx) == pytest.approx((1, 2, 0, 2)) and (abs(r.qz), abs(r.qw)) == pytest.approx((math.sqrt(0.5),) * 2)
    by_columns = [quarter[4 * c + k] for k in range(4) for c in range(4)]
    assert tuple(C.transform(s, by_columns, row_major=False).first()) == pytest.approx(tuple(r))


def test_octree_chunks_cover_every_row_once(spark):
    rnd = random.Random(6)
    codes = [rnd.randrange(8**3) if rnd.random() < 0.5 else 7 for _ in range(400)]
    got = C.octree_chunks(spark.createDataFrame([(c,) for c in codes], "morton bigint"), 30, 3).collect()
    assert sum(r.n for r in got) == 400 and all(r.n <= 30 or r.level == 3 for r in got)


def test_lod_reduce_meets_its_target(spark):
    rnd = random.Random(7)
    rows = [(i, *(rnd.random() for _ in range(3)), 0.1, 0.1, 0.1, 0.0, 0.0, 0.0, 1.0, 0.5, 0.5, 0.5, 0.5) for i in range(300)]
    s = spark.createDataFrame(rows, "splat_id bigint, x double, y double, z double, sx double, sy double, sz double, qx double, qy double, qz double, qw double, r double, g double, b double, a double")
    out = C.lod_reduce(s, 0.1, 0.05).collect()
    assert 0 < len(out) <= 30 and sum(r.n for r in out) == 300


def test_budget_is_kept(spark):
    rows = [("s", c, lv, 10 * 2 ** (3 - lv), 1.0 / (1 + c)) for c in range(20) for lv in range(4)]
    got = L.within_budget(spark.createDataFrame(rows, "scene string, chunk_id int, level int, count int, score double"), 700).collect()
    assert len(got) == 20 and sum(r["count"] for r in got) <= 700 and min(r.level for r in got) < 3


def test_front_matter(spark):
    pages = ["---\ntitle: 'A'\nbad line\norder: 3\n---\nbody", "no marks", "---\ntitle: B\nnever ends", "---\nq: \"half'\n---\n"]
    df = spark.createDataFrame([(p,) for p in pages], "p string").select(T.front_matter(F.col("p")).alias("s"), T.front_matter(F.col("p"), strict=False).alias("l"))
    got = df.collect()
    assert [r.s for r in got] == [{"title": "A", "order": "3"}, {}, None, {"q": "half"}]
    assert [r.l for r in got] == [{"title": "A", "order": "3"}, {}, {}, {"q": "\"half'"}]


def test_text_functions(spark):
    row = spark.range(1).select(
        T.heading_signature(F.lit("# a\n## b\n#### c\n##no\n## d")).alias("sig"),
        T.link_targets(F.lit('see [a](b.md) ![i](c.png)[t](x "y") <a href="z">')).alias("links"),
        T.split_urls(F.lit(" a,b\n\nc ,")).alias("urls"),
        T.decode_entities(F.lit("&amp;lt; &lt;")).alias("last"),
        T.decode_entities(F.lit("&amp;lt;"), ampersand_first=True).alias("first"),
        T.url_file_name(F.lit("https://x.y/a%20b/c%2Bd.ply?q")).alias("name"),
        T.url_file_name(F.lit("https://host.example/")).alias("host"),
        T.url_file_name(F.lit("just text")).alias("none"),
        T.format_bytes(F.lit(1536)).alias("size"),
        T.kebab_case(F.lit("XMLHttpRequest2 Foo_bar")).alias("kebab"),
        T.format_label(F.lit("a.ply")).alias("label"),
    ).first()
    assert (row.sig, row.links, row.urls) == ("2,4,2", ["b.md", 'x "y"', "z"], ["a", "b", "c"])
    assert (row.last, row.first) == ("&lt; <", "<")
    assert (row.name, row.host, row.none, row["size"]) == ("c+d.ply", "host.example", "just text", "1.5 KB")
    assert (row.kebab, row.label) == ("xml-http-request-2-foo-bar", "PLY")


def test_markdown():
    page = '<h2 id="x">A &amp; B</h2><p>Some <b>bold</b> <code>x&lt;y</code> <a href="/u?a&amp;b">link</a></p><pre><code class="language-ts">let a = 1;\n</code></pre><ol><li>one</li><li> two </li></ol>tail<svg>no</svg>'
    want = "## A & B\n\nSome **bold** `x<y` [link](/u?a&b)\n\n```ts\nlet a = 1;\n```\n\n1. one\n2. two\n\ntail"
    assert T.markdown_of(page) == want


def test_markdown_of_nested_lists_and_broken_pages():
    nested = "<ul><li>a<ul><li>b <em>c</em></li><li></li><li>d</ul></li><li>e</ul>x<br>y<pre>\n  k &lt; l\n\n\n\nm</pre><h3> t\n u </h3><script>no()</script>"
    assert T.markdown_of(nested) == "- a\n  - b *c*\n  - d\n- e\n\nx\ny\n\n```\n  k < l\n\n\n\nm\n```\n\n### t u"
    assert T.markdown_of("<a href=/x>one<a>two</a></b> &amp; <b>open") == "[one](/x)two & open"
    began = time.time()
    for tag in ("<a>", "<b>", "<li>", "<ul><li>x", "<pre>", "</a>"):
        T.markdown_of(tag * 4_000)
    assert time.time() - began < 10


def test_unescape(spark):
    texts = ["a &lt;b&gt; &amp;lt; &#39;&#x1F600;&apos;", "&nbsp;&unknown; &#0; &#xD800; &", "", "plain", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(T.unescape(F.col("t"))).collect()] == ["a <b> &lt; '\U0001f600'", "\u00a0&unknown; \ufffd \ufffd &", "", "plain", None]


def test_symbols(spark):
    e = spark.createDataFrame([(1, "N", "A"), (2, "M", "A"), (3, "N", "B")], "entry_id int, namespace string, title string")
    asked = spark.createDataFrame([("A",), ("N.A",), ("B",), ("C",)], "symbol string")
    assert {r.symbol: (r.found, r.status) for r in K.resolve_symbols(asked, e).collect()} == {"A": (None, "ambiguous"), "N.A": (1, "ok"), "B": (3, "ok"), "C": (None, "missing")}
    assert {r.symbol: r.found for r in K.first_symbol(asked, e).collect()} == {"A": 1, "N.A": 1, "B": 3, "C": None}


def test_folds_do_not_mix_keys(spark):
    rows = spark.createDataFrame([(k, i, 0.03 if k == 1 else 0.3) for i in range(50) for k in (1, 2)], "k int, i int, dt double").repartition(5)
    start, step, out, _ = S.fixed_steps()
    got = S.fold(rows, "k", ["i"], ["dt"], start, step, out)
    assert {r.k: r.n for r in got.groupBy("k").agg(F.sum("steps").alias("n")).collect()} == {1: 90, 2: 150}


def test_streams_give_what_batches_give(spark, tmp_path):
    rows = [(k, i, random.Random(i * 7 + k).random() * 0.2, True, 0.0) for i in range(60) for k in (1, 2)]
    schema = "k int, i int, speed double, grounded boolean, vertical double"
    for part in range(3):
        spark.createDataFrame([r for r in rows if r[1] // 20 == part], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    start, step, out, state = S.locomotion()
    values = ["speed", "grounded", "vertical"]
    want = {(r.k, r.i): r.action for r in S.fold(spark.createDataFrame(rows, schema), "k", ["i"], values, start, step, out).collect()}
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    q = S.fold_stream(stream, "k", ["i"], values, start, step, out, state).writeStream.format("memory").queryName("moves").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.k, r.i): r.action for r in spark.table("moves").collect()} == want


def test_throttle_on_a_stream(spark, tmp_path):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), F.timestamp_seconds(F.col("id") * 7).alias("ts"), F.col("id"), (F.col("id") * 2).alias("v"))
    df.write.parquet(f"{tmp_path}/e")
    want = {tuple(r) for r in W.throttle(df, "k", "ts", "1 minute", "v", ["id"]).collect()}
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/e")
    q = W.throttle(stream, "k", "ts", "1 minute", "v", ["id"], watermark="1 minute").writeStream.format("memory").queryName("throttled_").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.table("throttled_").collect()} == want


def test_task_pipeline(spark, tmp_path):
    rnd = random.Random(9)
    cloud = spark.createDataFrame([(i, *(rnd.random() * 3 for _ in range(3)), *[0.1] * 3, *[0.0] * 3, 1.0, *[0.5] * 3, 0.9) for i in range(200)], "splat_id bigint, x double, y double, z double, sx double, sy double, sz double, qx double, qy double, qz double, qw double, r double, g double, b double, a double")
    cloud.write.parquet(f"{tmp_path}/a.parquet")
    res = tasks.run(spark, {"version": 1, "tasks": [
        {"id": "r", "type": "Read", "config": {"inputs": [f"{tmp_path}/a.parquet"] * 2, "output": "c"}},
        {"id": "m", "type": "Modify", "config": {"input": "c", "output": "c", "deletedIndices": [0b101], "transform": [1, 0, 0, 5, 0, 1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1], "indicesTransform": [{"indices": [0b1000], "transform": [1, 0, 0, 0, 0, 1, 0, 100, 0, 0, 1, 0, 0, 0, 0, 1]}]}},
        {"id": "l", "type": "AutoLod", "config": {"input": "c", "output": "s", "ratio": 0.2, "cell": 0.5}},
        {"id": "v", "type": "Voxel", "config": {"input": "c", "output": f"file://{tmp_path}/v", "voxelResolution": 0.5, "box": [[-100] * 3, [50] * 3]}},
        {"id": "e", "type": "Voxel", "config": {"input": "c", "output": f"file://{tmp_path}/e", "voxelResolution": 0.5, "box": [[-100] * 3, [50] * 3], "extentSigmas": 3}},
        {"id": "w", "type": "Write", "config": {"input": "s", "output": f"{tmp_path}/s.parquet"}},
    ]})
    moved = res["c"].where("splat_id = 3").select("y", "x").collect()
    assert res["c"].count() == 396 and all(r.y > 99 and r.x >= 5 for r in moved)
    assert 0 < spark.read.parquet(f"{tmp_path}/s.parquet").count() <= 79
    assert (tmp_path / "v" / "voxel.bin").stat().st_size > 0
    bits = {k: octree.read_pair(spark, f"file://{tmp_path}/{k}")[1].selectExpr("sum(bit_count(lo) + bit_count(hi)) AS n").first().n for k in "ve"}
    assert bits["e"] > bits["v"] > 0
    with pytest.raises(ValueError, match="no such type"):
        tasks.run(spark, {"tasks": [{"id": "x", "type": "Nope", "config": {}}]})
