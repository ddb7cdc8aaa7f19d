"""A Markdown corpus from its sources: manual pages, API pages in HTML and examples become pages of text with indexes.

Everything gives `path, content` (and what an index needs), so that `sources.markdown_corpus.sync` can write it.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelith.functions import text as T
from voxelith.operators.corpus import first_symbol, index_pages

#: A Markdown link or image: its text in brackets, a target without spaces, and what may follow it in the parentheses.
LINK = r"\[[^\]]*\]\([^)\s]+[^)]*\)"


def read_sources(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """`path, source`: the text files below `root` whose names match the glob `pattern`, whole, by paths from `root`."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    below = root.rstrip("/").partition(":")[2].lstrip("/") if ":" in root else root.strip("/")  # Spark gives whole URIs
    own = F.regexp_replace("path", "^.*?" + re.escape(below) + "/", "")
    return files.select(own.alias("path"), F.decode("content", "UTF-8").alias("source"))


def relinked(body: Column, to: Callable[[Column], Column], images: bool = False) -> Column:
    """`body` with the targets of its links, or of its images, replaced by to(target) where that isn't null."""
    pattern = ("!" if images else r"(?<!!)") + LINK
    between, found = F.split(body, pattern, -1), F.regexp_extract_all(body, F.lit(pattern), F.lit(0))

    def changed(link: Column) -> Column:
        head, target, tail = (F.regexp_extract(link, r"(?s)^(!?\[[^\]]*\]\()([^)\s]+)(.*)$", i) for i in (1, 2, 3))
        return F.concat(head, F.coalesce(to(target), target), tail)

    new = F.transform(found, changed)
    return F.array_join(F.transform(F.arrays_zip(between.alias("t"), new.alias("n")), lambda x: F.concat(x["t"], F.coalesce(x["n"], F.lit("")))), "")


def manual_pages(sources: DataFrame, entries: DataFrame, images: str, section: str = "manual") -> DataFrame:
    """`path, content, slug, title, description, order` of manual pages (`path, source`, Markdown with front matter).

    `entries` (`entry_id, title, namespace, slug`) are the API pages that `api:` links look up; a link without one stays.
    Images that are neither web nor root links are taken from the folder `images`. A page without a title has its slug as
    one, and is 0th in order without a number. A description like the title is left out.
    """
    front = T.front_matter(F.col("source"), strict=False)
    body = F.regexp_replace("source", r"(?s)^---.*?\r?\n---\r?\n", "")
    pages = sources.select(F.regexp_replace("path", r"\.md$", "").alias("slug"), front.alias("front"), body.alias("body"))
    links = pages.select("slug", F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(r"(?<!!)\[[^\]]*\]\(([^)\s]+)"), F.lit(1)))).alias("href"))
    asked = first_symbol(links.select("href").distinct().withColumn("symbol", T.api_symbol(F.col("href"))), entries)
    about = asked.join(entries.select(F.col("entry_id").alias("found"), F.col("slug").alias("api")), "found", "left")
    targets = about.select("href", T.manual_href(F.col("href"), F.col("api")).alias("target")).where("target IS NOT NULL")
    own = links.join(targets, "href").groupBy("slug").agg(F.map_from_entries(F.collect_list(F.struct("href", "target"))).alias("to"))
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    pages = pages.join(own, "slug", "left").withColumn("to", F.coalesce("to", none))
    body = relinked(F.col("body"), lambda href: F.try_element_at(F.col("to"), href))
    image = lambda href: F.when(~href.rlike("^(https?://|/)"), F.concat(F.lit(images.rstrip("/") + "/"), F.regexp_replace(href, r"^\.?/+", "")))
    at = lambda k: F.try_element_at("front", F.lit(k))
    title = F.coalesce(at("title"), F.col("slug"))
    told = pages.select("slug", title.alias("title"), F.coalesce(at("description"), F.lit("")).alias("description"), F.coalesce(F.try_to_number(at("order"), F.lit("S999999999")).cast("double"), F.lit(0.0)).alias("order"), relinked(body, image, images=True).alias("body"))
    note = F.when((F.col("description") != "") & (F.col("description") != F.col("title")), F.concat(F.lit("> "), F.col("description")))
    content = F.concat(F.concat_ws("\n\n", F.concat(F.lit("# "), F.col("title")), note, F.trim(_ends("body"))), F.lit("\n"))
    return told.select(F.concat(F.lit(f"{section}/"), "slug", F.lit(".md")).alias("path"), content.alias("content"), "slug", "title", "description", "order")


def _ends(c: str) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def api_pages(entries: DataFrame, locale: str, section: str = "api") -> DataFrame:
    """`path, content, slug, title, description, order` of API pages: `slug, title, signature, description, category,
    namespace, html`, all but the first two may be null.

    Links to pages of the locale become relative ones to their Markdown pages; others stay. Order is that of titles.
    """
    code = lambda label, c: F.when(c.isNotNull() & (c != ""), F.concat(F.lit(f"{label}: `"), c, F.lit("`")))
    head = F.concat(F.lit("# "), F.col("title"), F.when(F.col("signature") != "", F.concat(F.lit("\n\n```ts\n"), F.col("signature"), F.lit("\n```"))).otherwise(F.lit("")))
    space = F.when(F.col("namespace").eqNullSafe(F.col("category")), F.lit(None)).otherwise(F.col("namespace"))
    meta = F.concat_ws(" · ", code("Category", F.col("category")), code("Namespace", space))
    body = F.coalesce(_ends("body"), F.lit(""))
    pages = entries.withColumn("body", T.html_to_markdown(F.col("html")))
    pages = pages.withColumn("body", relinked(F.col("body"), lambda href: T.api_href(href, F.col("slug"), locale)))
    note = F.when(F.col("description") != "", F.concat(F.lit("> "), F.col("description")))
    content = F.concat(F.concat_ws("\n\n", head, F.when(meta != "", meta), note, F.when(body != "", body)), F.lit("\n"))
    return pages.select(F.concat(F.lit(f"{section}/"), "slug", F.lit(".md")).alias("path"), content.alias("content"), "slug", "title", F.coalesce("description", F.lit("")).alias("description"), F.lit(0.0).alias("order"))


EXAMPLE = "title map<string, string>, tags array<string>, order double"


def example_pages(meta: DataFrame, code: DataFrame, locale: str, default: str, language: str = "ts", section: str = "examples") -> DataFrame:
    """`path, content, slug, title, description, order` of examples: `path, source` of their JSON descriptions and programs.

    An example has the names of both files without their extensions in common. Titles are taken in the locale, then in the
    default one, then from the name; an example without a number comes last, one without a program has an empty one. A
    description that is no JSON counts as one without fields.
    """
    name = lambda c: F.regexp_replace(c, r"\.[^./]*$", "")
    about = meta.select(name("path").alias("slug"), F.from_json("source", EXAMPLE, {"mode": "PERMISSIVE"}).alias("m"))
    both = about.join(code.select(name("path").alias("slug"), F.col("source").alias("code"), F.col("path").alias("from")), "slug", "left")
    title = F.coalesce(F.try_element_at("m.title", F.lit(locale)), F.try_element_at("m.title", F.lit(default)), F.col("slug"))
    tags = F.when(F.size("m.tags") > 0, F.concat(F.lit("Tags: "), F.array_join(F.transform("m.tags", lambda t: F.concat(F.lit("`"), t, F.lit("`"))), ", ")))
    hint = F.concat(F.lit("Source: `"), F.coalesce("from", F.concat("slug", F.lit(f".{language}"))), F.lit("`"))
    program = F.concat(F.lit(f"```{language}\n"), F.coalesce(F.regexp_replace("code", r"\s+$", ""), F.lit("")), F.lit("\n```"))
    content = F.concat(F.concat_ws("\n\n", F.concat(F.lit("# "), title), tags, hint, program), F.lit("\n"))
    order = F.coalesce("m.order", F.lit(float("inf")))
    return both.select(F.concat(F.lit(f"{section}/"), "slug", F.lit(".md")).alias("path"), content.alias("content"), "slug", title.alias("title"), F.lit("").alias("description"), order.alias("order"))


def corpus(sections: dict[str, DataFrame], per_page: int = 5000) -> DataFrame:
    """`path, content` of all pages of the sections, of each section's index, and of index.md, which lists the sections."""
    out, lines = None, []
    for section, pages in sections.items():
        index = index_pages(pages.select("slug", "title", "description", "order"), section, per_page)
        both = pages.select("path", "content").unionByName(index)
        out = both if out is None else out.unionByName(both)
        lines.append(pages.agg(F.count(F.lit(1)).alias("n")).select(F.lit(len(lines)).alias("i"), F.concat(F.lit(f"- [{section}]({section}/index.md): "), F.col("n").cast("string"), F.lit(" pages")).alias("line")))
    if out is None:
        raise ValueError("no sections")
    root = lines[0]
    for line in lines[1:]:
        root = root.unionByName(line)
    root = root.agg(F.array_sort(F.collect_list(F.struct("i", "line"))).alias("l"))
    return out.unionByName(root.select(F.lit("index.md").alias("path"), F.concat(F.array_join(F.col("l.line"), "\n"), F.lit("\n")).alias("content")))
