"""Queries on pages, names and references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelith.functions import text as T
from voxelith.operators import corpus as C
from voxelith.plans.carriers import table
from voxelith.plans.registry import SQL, query

LINKS = r"""SELECT page_id, t.pos - 1 AS place, t.href FROM (SELECT page_id, regexp_extract_all(html, '\bhref="([^"'']+)"', 1) AS hrefs FROM pages), LATERAL (SELECT unnest(hrefs) AS href, generate_subscripts(hrefs, 1) AS pos) t"""


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(T.href_targets(F.col("html"))).alias("place", "href"))


@query(f"SELECT page_id, place::INT AS place, href FROM ({LINKS})")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links(spark, sf_dir)


@query(
    rf"""SELECT href, regexp_matches(href, '^[A-Za-z][A-Za-z\d+.-]*:') AS is_external, href NOT LIKE '/%' AND href NOT LIKE '#%' AND NOT regexp_matches(href, '^[A-Za-z][A-Za-z\d+.-]*:') AS is_local,
  regexp_extract(href, '^([^?#]*)', 1) AS path, regexp_extract(href, '(?s)^[^?#]*(.*)$', 1) AS trailing, count(*) AS n FROM ({LINKS}) GROUP BY ALL"""
)
def link_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.col("href")
    path, trailing = T.split_trailing(h)
    return links(spark, sf_dir).groupBy("href", T.is_external(h).alias("is_external"), T.is_local(h).alias("is_local"), path.alias("path"), trailing.alias("trailing")).agg(F.count(F.lit(1)).alias("n"))


@query(
    r"""WITH h AS (SELECT page_id, regexp_extract_all(html, '(?s)<h[1-6]\b[^>]*>.*?</h[1-6]>') AS hs FROM pages), u AS (SELECT page_id, unnest(hs) AS h, generate_subscripts(hs, 1) AS p FROM h)
SELECT page_id, (p - 1)::INT AS place, substr(h, 3, 1)::INT AS level,
  trim(replace(replace(replace(replace(replace(regexp_replace(h, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&')) AS text FROM u"""
)
def page_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = table(spark, sf_dir, "pages").select("page_id", F.posexplode(T.headings(F.col("html"))).alias("place", "h"))
    return got.select("page_id", "place", "h.level", "h.text")


@query()
def html_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.html_to_markdown(F.col("html")).alias("markdown"))


@query(
    r"""SELECT page_id, url, CASE WHEN len(list_filter(string_split(path, '/'), lambda x: x <> '')) > 0 THEN list_filter(string_split(path, '/'), lambda x: x <> '')[-1] ELSE host END AS file_name
FROM (SELECT page_id, url, regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path FROM pages)"""
)
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", "url", T.url_file_name(F.col("url")).alias("file_name"))


SIZES = "SELECT o_orderkey, (o_totalprice * pow(7, o_orderkey % 9) - 1000)::BIGINT AS size FROM orders"


@query(
    f"""WITH s AS (SELECT o_orderkey, size, CASE WHEN size >= 1073741824 THEN 3 WHEN size >= 1048576 THEN 2 WHEN size >= 1024 THEN 1 ELSE 0 END AS e FROM ({SIZES})),
v AS (SELECT *, size::DOUBLE / pow(1024.0, e) AS v FROM s)
SELECT o_orderkey, size, CASE WHEN size <= 0 THEN '0 B' ELSE CASE WHEN v >= 10 OR e = 0 THEN floor(v + 0.5)::BIGINT::VARCHAR ELSE format('{{:.1f}}', floor(v * 10 + 0.5) / 10) END
  || ' ' || ['B', 'KB', 'MB', 'GB'][e + 1] END AS label FROM v"""
)
def format_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.bround(F.col("o_totalprice") * F.pow(F.lit(7.0), F.col("o_orderkey") % 9) - 1000, 0).cast("bigint")
    return table(spark, sf_dir, "orders").select("o_orderkey", size.alias("size")).withColumn("label", T.format_bytes(F.col("size")))


@query(
    r"""SELECT p_partkey, lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(n, '([A-Z]+)([A-Z][a-z])', '\1-\2', 'g'), '([a-z])([A-Z])', '\1-\2', 'g'), '([A-Za-z])(\d+)', '\1-\2', 'g'), '[\s_]+', '-', 'g')) AS slug
FROM (SELECT p_partkey, p_brand || 'XMLFile_' || p_type || p_size || ' ' || p_name AS n FROM part)"""
)
def kebab_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.col("p_brand"), F.lit("XMLFile_"), F.col("p_type"), F.col("p_size").cast("string"), F.lit(" "), F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", T.kebab_case(name).alias("slug"))


@query(
    r"""WITH n AS (SELECT p_partkey, lower(regexp_replace(regexp_replace(p_brand || p_type || ' ' || p_name, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g')) AS t FROM part),
w AS (SELECT p_partkey, list_filter(regexp_split_to_array(t, '[^a-z0-9]+'), lambda x: x <> '') AS ws FROM n)
SELECT p_partkey, contains(array_to_string(ws, ''), 'brand1') OR len(list_filter(ws, lambda x: starts_with(x, 'brand'))) > 0 AND len(list_filter(ws, lambda x: starts_with(x, '1'))) > 0 AS shown FROM w"""
)
def token_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.col("p_brand"), F.col("p_type"), F.lit(" "), F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", T.matches(text, F.lit("Brand 1")).alias("shown"))


@query(
    r"""SELECT p_brand, count(*) FILTER (contains(lower(p_type), 'a')) AS visible, count(*) FILTER (contains(lower(p_type), 'a')) = 0 AS hidden FROM part GROUP BY p_brand"""
)
def group_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.group_visibility(table(spark, sf_dir, "part"), "p_brand", F.contains(F.lower("p_type"), F.lit("a")))


@query("SELECT doc_id, lang, source, lag(doc_id) OVER w AS prev, lead(doc_id) OVER w AS next FROM documents WINDOW w AS (PARTITION BY lang, source ORDER BY n_chars, doc_id)")
def doc_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return C.neighbours(d, ["lang", "source"], [F.col("n_chars"), F.col("doc_id")], "doc_id").select("doc_id", "lang", "source", "prev", "next")


@query("SELECT lang, source, min(doc_id) AS first, list(doc_id ORDER BY doc_id) AS items FROM documents GROUP BY lang, source")
def group_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.groups_first_seen(table(spark, sf_dir, "documents"), ["lang", "source"], "doc_id", "doc_id")


@query(
    """SELECT c_custkey, c_mktsegment, c_mktsegment || CASE WHEN n = 1 THEN '' ELSE '-' || n END AS unique_slug FROM (
  SELECT *, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) AS n FROM customer)"""
)
def dup_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.numbered_slugs(table(spark, sf_dir, "customer"), ["c_nationkey"], "c_mktsegment", "c_custkey").select("c_custkey", "c_mktsegment", "unique_slug")


@query("SELECT DISTINCT lang, list_sort(list(DISTINCT source)) AS kinds FROM documents GROUP BY lang")
def distinct_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.array_sort(F.collect_set("source")).alias("kinds"))


@query("SELECT lang, source, arg_min(n_chars, doc_id) AS n_chars FROM documents GROUP BY lang, source")
def distinct_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document of each composite key."""
    return C.latest(table(spark, sf_dir, "documents"), ["lang", "source"], [-F.col("doc_id")]).select("lang", "source", "n_chars")


@query("SELECT doc_id, lang, CASE lang WHEN 'de' THEN 0 WHEN 'en' THEN 1 ELSE 2 END::INT AS rank FROM documents")
def listed_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.ranked_by_list(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", ["de", "en"])


@query(f"SELECT l.page_id, l.place::INT AS place, l.href FROM ({LINKS}) l WHERE NOT EXISTS (SELECT 1 FROM pages p WHERE l.href = regexp_extract(p.url, '^[a-z]+://[^/?#]+([^?#]*)', 1))")
def missing_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = table(spark, sf_dir, "pages").select(F.regexp_extract("url", r"^[a-z]+://[^/?#]+([^?#]*)", 1).alias("path"))
    return C.broken(links(spark, sf_dir), paths, "href", "path")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def orphan_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers that no order names."""
    return C.orphans(table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders"), "c_custkey", "o_custkey")


@query(
    """WITH d AS (SELECT DISTINCT lang, n_chars % 100 AS slug FROM documents), b AS (SELECT slug FROM d WHERE lang = 'en'), l AS (SELECT DISTINCT lang FROM d WHERE lang <> 'en')
SELECT l.lang, b.slug, 'missing' AS problem FROM b, l WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.lang = l.lang AND d.slug = b.slug)
UNION ALL SELECT lang, slug, 'extra' FROM d WHERE lang <> 'en' AND slug NOT IN (SELECT slug FROM b)"""
)
def pair_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("lang", (F.col("n_chars") % 100).alias("slug"))
    return C.parity(d, "lang", "slug", "en")


_ENTRIES = "SELECT p_partkey AS entry_id, p_brand AS namespace, 'T' || p_partkey % 300 AS title FROM part"
_ASKED = "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'Brand#11.' ELSE '' END || 'T' || o_custkey % 400 AS symbol FROM orders"


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr("p_partkey entry_id", "p_brand namespace", "'T' || p_partkey % 300 title")


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey", "CASE WHEN o_orderkey % 3 = 0 THEN 'Brand#11.' ELSE '' END || 'T' || o_custkey % 400 symbol")


@query(
    f"""WITH k AS (SELECT name, count(*) AS n, min(entry_id) AS id FROM (SELECT entry_id, title AS name FROM ({_ENTRIES}) UNION ALL SELECT entry_id, namespace || '.' || title FROM ({_ENTRIES})) GROUP BY name)
SELECT o_orderkey, symbol, CASE WHEN n = 1 THEN id END AS found, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'ambiguous' ELSE 'ok' END AS status FROM ({_ASKED}) LEFT JOIN k ON symbol = name"""
)
def symbol_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.resolve_symbols(_asked(spark, sf_dir), _entries(spark, sf_dir))


@query(
    f"""SELECT o_orderkey, symbol, coalesce((SELECT min(entry_id) FROM ({_ENTRIES}) WHERE title = symbol), (SELECT min(entry_id) FROM ({_ENTRIES}) WHERE namespace || '.' || title = symbol)) AS found FROM ({_ASKED})"""
)
def symbol_lookup_lenient(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.first_symbol(_asked(spark, sf_dir), _entries(spark, sf_dir))


@query(
    """SELECT key, action FROM (SELECT coalesce(e.o_orderkey, w.o_orderkey) AS key, CASE WHEN e.o_orderkey IS NULL THEN 'delete' WHEN w.o_orderkey IS NULL OR e.h <> w.h THEN 'write' END AS action
  FROM (SELECT o_orderkey, md5(o_orderstatus) AS h FROM orders WHERE o_orderkey % 3 > 0) e FULL JOIN (SELECT o_orderkey, md5(CASE WHEN o_orderkey % 7 = 0 THEN 'x' ELSE o_orderstatus END) AS h FROM orders WHERE o_orderkey % 5 > 0) w USING (o_orderkey))
WHERE action IS NOT NULL"""
)
def stale_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    want = o.where("o_orderkey % 3 > 0").select(F.col("o_orderkey").alias("path"), F.md5("o_orderstatus").alias("hash"))
    have = o.where("o_orderkey % 5 > 0").select(F.col("o_orderkey").alias("path"), F.md5(F.when(F.col("o_orderkey") % 7 == 0, "x").otherwise(F.col("o_orderstatus"))).alias("hash"))
    return C.stale(have, want).withColumnRenamed("path", "key")


@query("SELECT c.c_custkey, n.n_name || '/' || c.c_mktsegment AS route FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey UNION ALL SELECT c_custkey, 'all/' || c_mktsegment FROM customer")
def route_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item once under its own locale and once under the common one."""
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    own = c.join(n, c.c_nationkey == n.n_nationkey).select("c_custkey", F.concat_ws("/", "n_name", "c_mktsegment").alias("route"))
    return own.unionByName(c.select("c_custkey", F.concat_ws("/", F.lit("all"), "c_mktsegment").alias("route")))


@query("SELECT user_id, event_type, arg_max(event_id, event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY user_id, event_type")
def cache_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record that each key holds after all puts, the last writer's."""
    return C.latest(table(spark, sf_dir, "events"), ["user_id", "event_type"], [F.col("event_id")]).select("user_id", "event_type", "event_id", "value")


@query("SELECT user_id, event_type, event_id FROM (SELECT user_id, event_type, max(event_id) AS event_id FROM events GROUP BY 1, 2) WHERE event_id % 3 = 0")
def cache_versioned_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gets that ask for version 0: keys whose last record has another version are misses."""
    e = table(spark, sf_dir, "events").withColumn("version", F.col("event_id") % 3)
    return C.latest(e, ["user_id", "event_type"], [F.col("event_id")], F.col("version") == 0).select("user_id", "event_type", "event_id")


@query("SELECT page_id, regexp_replace('img/' || page_id || '.PNG', '\\.[^./]*$', '') || '.' || substr(replace(replace(to_base64(unhex(sha256(html))), '+', '-'), '/', '_'), 1, 16) || '.PNG' AS name, 'image/png' AS mime FROM pages")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("img/"), F.col("page_id").cast("string"), F.lit(".PNG"))
    return table(spark, sf_dir, "pages").select("page_id", T.hashed_name(path, F.col("html").cast("binary")).alias("name"), T.mime_type(path).alias("mime"))


@query("SELECT n_nationkey, '/' || n_name || '/manual/' || n_regionkey AS path, (n_nationkey * 65793 + 17)::BIGINT AS colour FROM nation")
def locale_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    hexed = F.concat(F.lit("#"), F.lower(F.lpad(F.hex(F.col("n_nationkey") * 65793 + 17), 6, "0")))
    path = T.locale_path(F.concat(F.lit("/"), "n_name", F.lit("/")), F.concat(F.lit("/manual//"), F.col("n_regionkey").cast("string")))
    return table(spark, sf_dir, "nation").select("n_nationkey", path.alias("path"), T.colour_int(hexed).alias("colour"))


@query(
    """SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'a/b/c.md' WHEN 1 THEN 'a/c.md' WHEN 2 THEN 'c.md' ELSE 'a/b/d/c.md' END AS resolved,
  CASE n_nationkey % 4 WHEN 0 THEN './y.md' WHEN 1 THEN '../x/y.md' WHEN 2 THEN '../../z.md' ELSE '../../a.md' END AS relative FROM nation"""
)
def relative_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey") % 4
    pick = lambda *v: F.element_at(F.array(*map(F.lit, v)), (k + 1).cast("int"))
    return table(spark, sf_dir, "nation").select(
        "n_nationkey",
        T.normalise_path(F.lit("a/b"), pick("./c.md", "../c.md", "../../../c.md", "d//./c.md")).alias("resolved"),
        T.relative_md(pick("m/a", "m/a", "m/n/a", "m/n/a"), pick("m/y", "x/y", "z", "a")).alias("relative"),
    )


@query("SELECT page_id, regexp_matches(html, '(?i)(?:intranet\\.example|/private/|https?://short\\.)') OR page_id % 11 = 0 AS banned FROM pages")
def banned_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.when(F.col("page_id") % 11 == 0, F.concat("html", F.lit("https://SHORT.example"))).otherwise(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", T.is_banned(html, [r"intranet\.example", "/private/", r"https?://short\."]).alias("banned"))


@query(
    """SELECT s_suppkey, ['ply', 'splat', 'spz', 'json', NULL, 'compressed.ply'][s_suppkey % 6 + 1] AS kind FROM supplier"""
)
def file_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = (F.col("s_suppkey") % 6 + 1).cast("int")
    name = F.element_at(F.array(*map(F.lit, ["x", "b.SPLAT?v=1", "dir.v2/c.spz", "m.json", "readme.txt", "e.compressed.ply"])), k)
    head = F.when(k == 1, F.lit("ply\nformat")).when(k == 4, F.lit('{"a":1}')).otherwise(F.lit("")).cast("binary")
    return table(spark, sf_dir, "supplier").select("s_suppkey", T.file_kind(name, head).alias("kind"))


@query(
    r"""WITH l AS (SELECT page_id, html, list_distinct(regexp_extract_all(html, 'href="([^"'')]+)"', 1)) AS ls FROM pages)
SELECT page_id, md5(list_reduce(list_filter(ls, lambda x: starts_with(x, '/')), lambda acc, x: replace(acc, 'href="' || x || '"', 'href="' || lower(x) || '.md"'), html)) AS rewritten FROM l"""
)
def rewritten_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root links of all pages point to Markdown pages in lower case."""
    pages = table(spark, sf_dir, "pages").select("page_id", "html")
    mapping = links(spark, sf_dir).where(F.startswith("href", F.lit("/"))).select(F.col("href").alias("link"), F.concat(F.lower("href"), F.lit(".md")).alias("target")).distinct()
    return C.rewrite_links(pages, mapping, "page_id", "html").select("page_id", F.md5("html").alias("rewritten"))


_HREF = """SELECT o_orderkey, 'T' || o_custkey % 400 AS title, CASE o_orderkey % 8 WHEN 0 THEN 'https://a.example/' || o_orderkey WHEN 1 THEN '#part' WHEN 2 THEN 'api:T' || o_custkey % 400 || '#' || o_orderkey
  WHEN 3 THEN '/root/' || o_orderkey WHEN 4 THEN '../../examples/e' || o_orderkey || '/?q=1#h' WHEN 5 THEN '../../api/' WHEN 6 THEN './p' || o_orderkey || '.md#x' ELSE 'image.png' END AS href FROM {orders}"""


@query(
    rf"""WITH h AS ({_HREF.format(orders="orders")}), e AS (SELECT title, min(entry_id) AS id FROM ({_ENTRIES}) GROUP BY title)
SELECT o_orderkey, href, CASE WHEN starts_with(href, 'api:') THEN '../api/e' || id || '.md'
  WHEN regexp_matches(href, '^\.\./\.\./(examples|api)/') THEN replace(regexp_replace(href, '^\.\./\.\./([a-z]+)/([^/?#]*)/?', '../\1/\2.md'), '/.md', '/index.md')
  WHEN starts_with(href, './') THEN href END AS target FROM h LEFT JOIN e ON h.title = e.title"""
)
def manual_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of manual pages as the Markdown corpus has them; api: links are looked up among the entries."""
    asked = spark.sql(_HREF, orders=table(spark, sf_dir, "orders")).withColumn("symbol", T.api_symbol(F.col("href")))
    found = C.first_symbol(asked, _entries(spark, sf_dir))
    return found.select("o_orderkey", "href", T.manual_href(F.col("href"), F.concat(F.lit("e"), F.col("found").cast("string"))).alias("target"))


@query(
    """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '../ns' || p_size || '/t' || p_partkey || '.md#m' WHEN 2 THEN 'https://a.example/' END AS target
FROM (SELECT * FROM part WHERE p_partkey % 4 <> 1) UNION ALL SELECT p_partkey, './index.md#top' FROM part WHERE p_partkey % 4 = 1"""
)
def api_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of API pages; every page is one of the namespace `top`."""
    href = F.expr("CASE p_partkey % 4 WHEN 0 THEN '/en/api/ns' || p_size || '/t' || p_partkey || '/#m' WHEN 1 THEN '/en/api/#top' WHEN 2 THEN 'https://a.example/' ELSE 'mailto:a' END")
    return table(spark, sf_dir, "part").select("p_partkey", T.api_href(href, F.lit("top/page"), "en").alias("target"))


#: Checks of the content report: rule, query whose rows break it.
_RULES = {"links": missing_links, "assets": orphan_assets, "parity": pair_parity, "outputs": stale_outputs}


@query(" UNION ALL ".join(f"SELECT '{rule}' AS rule, count(*) AS n, count(*) = 0 AS ok FROM ({SQL[f.__name__]})" for rule, f in _RULES.items()))
def content_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each check of the corpus."""
    return C.report({rule: f(spark, sf_dir) for rule, f in _RULES.items()})


#: How a row that breaks a rule is named, in SQL that both engines know.
_SUBJECTS = {"links": "page_id || ' ' || href", "assets": "'customer ' || c_custkey", "parity": "lang || '/' || slug || ' ' || problem", "outputs": "action || ' ' || key"}


@query(" UNION ALL ".join(f"SELECT '{rule}' AS rule, {_SUBJECTS[rule]} AS subject FROM ({SQL[f.__name__]})" for rule, f in _RULES.items()))
def content_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each violation of the content report's checks."""
    return C.violations({rule: (f(spark, sf_dir), F.expr(_SUBJECTS[rule])) for rule, f in _RULES.items()})


_PAGE = """SELECT o_orderkey, CASE o_orderkey % 9 WHEN 0 THEN 'api:T#m' WHEN 1 THEN 'p' || o_custkey || '.md?q' WHEN 2 THEN './a/../b' || o_custkey || '.MD' WHEN 3 THEN '../up' || o_custkey || '.md#h' WHEN 4 THEN '../../out.md'
  WHEN 5 THEN 'https://a.example/x.md' WHEN 6 THEN '/root.md' WHEN 7 THEN '#h' ELSE 'image.png' END AS href FROM {orders}"""


@query(
    rf"""SELECT o_orderkey, href, CASE o_orderkey % 9 WHEN 0 THEN '/de/api/ns/t/#m' WHEN 1 THEN '/de/manual/guide/p' || replace(substr(href, 2), '.md?q', '') || '/?q' WHEN 2 THEN '/de/manual/guide/b' || replace(substr(href, 9), '.MD', '') || '/'
  WHEN 3 THEN '/de/manual/up' || replace(substr(href, 6), '.md#h', '') || '/#h' END AS target FROM ({_PAGE.format(orders="orders")})"""
)
def site_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of the manual page guide/page.md as the web site has them."""
    asked = spark.sql(_PAGE, orders=table(spark, sf_dir, "orders"))
    return asked.select("o_orderkey", "href", T.site_href(F.col("href"), F.lit("guide/page.md"), F.lit("de"), F.lit("ns/t")).alias("target"))


@query(
    """SELECT s_suppkey, ['PLY', 'SPLAT', 'NAME', 'Unknown'][s_suppkey % 4 + 1] AS label, ['2,3', '', '2,6', '4'][s_suppkey % 4 + 1] AS signature FROM supplier"""
)
def page_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Format labels of file names, and signatures of pages' headings."""
    pick = lambda *v: F.element_at(F.array(*map(F.lit, v)), (F.col("s_suppkey") % 4 + 1).cast("int"))
    name = pick("a.b.ply", "c.splat", "name", "end.")
    page = pick("# a\n## b\ntext\n### c", "text # x\n#y", "## a\n####### b\n###### c", "```\n#### in a fence\n```")
    return table(spark, sf_dir, "supplier").select("s_suppkey", T.format_label(name).alias("label"), T.heading_signature(page).alias("signature"))
