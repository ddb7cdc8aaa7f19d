"""The Markdown corpus: files kept in step with pages, indexes, reports, and what is scraped from sources."""

import time

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from voxelith.functions import text as T
from voxelith.operators import corpus as C
from voxelith.operators import corpus_pages as P
from voxelith.sources import markdown_corpus
from voxelith.sources.files import listed


def files(root):
    return {str(p.relative_to(root)): p.read_text() for p in root.rglob("*") if p.is_file() and not p.name.startswith(".")}


def test_sync_writes_changes_and_prunes(spark, tmp_path):
    root = tmp_path / "corpus"
    page = lambda rows: spark.createDataFrame(rows, "path string, content string")
    first = markdown_corpus.sync(page([("a.md", "a"), ("m/b.md", "é"), ("old/deep/c.md", None)]), str(root))
    assert {tuple(r) for r in first.collect()} == {(p, "write") for p in ("a.md", "m/b.md", "old/deep/c.md")}
    assert files(root) == {"a.md": "a", "m/b.md": "é", "old/deep/c.md": ""}
    stamp = (root / "a.md").stat().st_mtime_ns
    second = markdown_corpus.sync(page([("a.md", "a"), ("m/b.md", "new")]), f"file://{root}")
    assert {tuple(r) for r in second.collect()} == {("m/b.md", "write"), ("old/deep/c.md", "delete")}
    assert files(root) == {"a.md": "a", "m/b.md": "new"} and not (root / "old").exists()
    assert (root / "a.md").stat().st_mtime_ns == stamp
    assert markdown_corpus.sync(page([]), str(root)).count() == 2 and files(root) == {} and root.exists()


@pytest.mark.parametrize("paths", [["../x.md"], ["/x.md"], ["a/../../x.md"], [None], ["a.md", "a.md"]])
def test_sync_refuses_paths(spark, tmp_path, paths):
    with pytest.raises(ValueError, match="no path"):
        markdown_corpus.sync(spark.createDataFrame([(p, "x") for p in paths], "path string, content string"), str(tmp_path / "c"))


def test_index_pages(spark):
    rows = [(f"s{i}", None if i == 3 else f"T{i}", "about" if i % 2 else "", (i * 7) % 10) for i in range(10)]
    got = {r.path: r.content for r in C.index_pages(spark.createDataFrame(rows, "slug string, title string, description string, order int"), "manual", 4).collect()}
    lines = [f"- [{t or s}]({s}.md)" + (f": {d}" if d else "") for s, t, d, _ in sorted(rows, key=lambda r: (r[3], r[0]))]
    want = {f"manual/index{'' if k == 0 else f'-{k + 1}'}.md": "\n".join(lines[4 * k : 4 * k + 4]) + "\n" for k in range(3)}
    assert got == want


def test_report(spark):
    got = C.report({"none": spark.range(0), "some": spark.range(3)}).collect()
    assert {tuple(r) for r in got} == {("none", 0, True), ("some", 3, False)}
    with pytest.raises(ValueError, match="no checks"):
        C.report({})


def test_manual_and_api_links(spark):
    manual = {
        "": None, "https://a/b.md": None, "#x": None, "/en/x.md": None, "api:T": "../api/slug.md", "../../examples/lod/": "../examples/lod.md",
        "../../api/?q": "../api/index.md?q", "../../manual/a//#h": "../manual/a.md#h", "x.md": "x.md", "x.md?v": "x.md?v", "x.mdx": None, "../../other/a": None,
    }
    df = spark.createDataFrame([(h,) for h in [*manual, None]], "href string")
    got = {r.href: r.t for r in df.select("href", T.manual_href(F.col("href"), F.lit("slug")).alias("t")).collect()}
    assert got == manual | {None: None}
    api = {"/en/api/": "./index.md", "/en/api/a/b#m": "./b.md#m", "/en/api/c/d/": "../c/d.md", "/de/api/a": None, "http://x": "http://x"}
    df = spark.createDataFrame([(h,) for h in api], "href string")
    assert {r.href: r.t for r in df.select("href", T.api_href(F.col("href"), F.lit("a/now"), "en").alias("t")).collect()} == api
    df = spark.createDataFrame([("api: N.T?x#y",), ("n/a",)], "href string")
    assert [r.s for r in df.select(T.api_symbol(F.col("href")).alias("s")).collect()] == ["N.T", None]


def test_scraped_sources(spark, tmp_path):
    text = "export const all = [{ code: 'en' }, {code:  \"zh\"}] as const;"
    df = spark.createDataFrame([(text,), ("none",), (None,)], "s string")
    assert [r.j for r in df.select(T.json_part(F.col("s")).alias("j")).collect()] == ["{ code: 'en' }, {code:  \"zh\"}", None, None]
    assert [r.c for r in df.where("s IS NULL OR s <> 'none'").select(T.locale_codes(F.col("s")).alias("c")).collect()] == [["en", "zh"], None]
    with pytest.raises(PySparkException, match="no locale"):
        df.select(T.locale_codes(F.col("s"))).collect()
    for name in ("a.md", "x/b.md", "node/c.md", "x/node/d.md", "x/e.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("")
    names = lambda **k: [p.removeprefix(f"{tmp_path}/") for p, _ in listed(str(tmp_path), ".md", **k)]
    assert names() == ["a.md", "node/c.md", "x/b.md", "x/node/d.md"]
    assert names(skip=("node",)) == ["a.md", "x/b.md"]


def test_constants_of_sources(spark):
    good = 'export const manifest = {"entries": [{"slug": "a/b", "title": "b"}]} as const;\n\nexport type M = 1;'
    rows = [(good,), (good.replace("manifest", "other"),), ("x" + good,), (good.replace('"entries"', "entries: {"),), (None,)]
    kind = "entries array<struct<slug:string,title:string>>"
    got = [r.m for r in spark.createDataFrame(rows, "s string").select(T.constant_json(F.col("s"), "manifest", kind).alias("m")).collect()]
    assert [(e.slug, e.title) for e in got[0].entries] == [("a/b", "b")]
    assert all(m is None or m.entries is None for m in got[1:])


def test_manual_links_by_segments(spark):
    links = {
        "../../examples/a/": "../examples/a.md", "../../api/": "../api/index.md", "../../manual/x/y?q#h": "../manual/x/y.md?q#h", "../../other/x": None, "../examples/a": None, "b.md#h": "b.md#h", "b.MD": None,
        "": None, "#h": None, "/root/x.md": None, "https://a/x.md": None, "api:N.T#m": "../api/n/t.md", "img.png": None, "../../api/t.md": "../api/t.md.md",
    }
    df = spark.createDataFrame([(h,) for h in links], "h string").select("h", T.manual_href(F.col("h"), F.lit("n/t")).alias("t"))
    assert {r.h: r.t for r in df.collect()} == links


def test_nested_marks_are_linear():
    def took(n):
        began = time.perf_counter()
        T.markdown_of("<b> " * n + "x" + "</b>" * n)
        return time.perf_counter() - began

    took(500)
    assert took(16_000) < 16 * 4 * max(took(1000), 0.005)
    assert T.markdown_of("<p><b><i> a</i> b </b> c</p>") == "***a* b** c"


def test_violations_are_named(spark):
    bad = spark.createDataFrame([(1, "x"), (2, "y")], "id int, what string")
    got = C.violations({"a": (bad, F.col("what")), "b": (bad.where("id > 1"), F.concat_ws(":", "id", "what")), "c": (bad.where("false"), F.col("id"))})
    assert sorted(map(tuple, got.collect())) == [("a", "x"), ("a", "y"), ("b", "2:y")]


def test_a_corpus_from_its_sources(spark, tmp_path):
    """Files of all three kinds, read, converted, indexed and written."""
    source = {
        "manual/start.md": "---\ntitle: Start\ndescription: How to begin\norder: 2\n---\n\nSee [it](api:Box), [ex](../../examples/one/#run) \"quoted\" and ![pic](./img/a.png \"A\").\n[![logo](logo.png)](https://a.example/)\n",
        "manual/deep/more.md": "no front matter, [gone](api:None) and ![root](/r.png)",
        "examples/one.json": '{"title": {"en": "One", "de": "Eins"}, "tags": ["a", "b"], "order": 1}',
        "examples/one.ts": "const x = 1;\n\n",
        "examples/two.json": "{}",
    }
    for name, text in source.items():
        (tmp_path / "src" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "src" / name).write_text(text)
    read = lambda folder, pattern: P.read_sources(spark, f"{tmp_path}/src/{folder}", pattern)
    entries = spark.createDataFrame([(1, "Box", "geo", "geo/box"), (2, "Ball", "geo", "geo/ball")], "entry_id bigint, title string, namespace string, slug string")
    manual = P.manual_pages(read("manual", "*.md"), entries, "../src/manual")
    html = '<h2>Box</h2><p>Like <a href="/de/api/geo/ball/#r">a ball</a> or <a href="https://a.example/">that</a>.</p>'
    about = [("geo/box", "Box", "class Box", "A box", "Shapes", "geo", html), ("geo/ball", "Ball", None, None, "geo", "geo", None)]
    api = P.api_pages(spark.createDataFrame(about, "slug string, title string, signature string, description string, category string, namespace string, html string"), "de")
    examples = P.example_pages(read("examples", "*.json"), read("examples", "*.ts"), "de", "en")
    pages = P.corpus({"manual": manual, "api": api, "examples": examples})
    markdown_corpus.sync(pages, str(tmp_path / "out"))
    got = files(tmp_path / "out")
    assert got["manual/start.md"] == (
        "# Start\n\n> How to begin\n\nSee [it](../api/geo/box.md), [ex](../examples/one.md#run) \"quoted\" and ![pic](../src/manual/img/a.png \"A\").\n[![logo](../src/manual/logo.png)](https://a.example/)\n"
    )
    assert got["manual/deep/more.md"] == "# deep/more\n\nno front matter, [gone](api:None) and ![root](/r.png)\n"
    assert got["manual/index.md"] == "- [deep/more](deep/more.md)\n- [Start](start.md): How to begin\n"
    assert got["api/geo/box.md"] == "# Box\n\n```ts\nclass Box\n```\n\nCategory: `Shapes` · Namespace: `geo`\n\n> A box\n\n## Box\n\nLike [a ball](./ball.md#r) or [that](https://a.example/).\n"
    assert got["api/geo/ball.md"] == "# Ball\n\nCategory: `geo`\n"
    assert got["examples/one.md"] == "# Eins\n\nTags: `a`, `b`\n\nSource: `one.ts`\n\n```ts\nconst x = 1;\n```\n"
    assert got["examples/two.md"] == "# two\n\nSource: `two.ts`\n\n```ts\n\n```\n"
    assert got["examples/index.md"] == "- [Eins](one.md)\n- [two](two.md)\n"
    assert got["index.md"] == "- [manual](manual/index.md): 2 pages\n- [api](api/index.md): 2 pages\n- [examples](examples/index.md): 2 pages\n"
    assert len(got) == 10
