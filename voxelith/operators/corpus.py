"""Documentation corpora: parity, broken links, orphans, symbols, groups in first-seen order, neighbours and slugs."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelith.ordering import in_groups, in_order, with_neighbours


def parity(pages: DataFrame, locale: str, slug: str, default: str) -> DataFrame:
    """`locale, slug, problem`: slugs that a locale lacks or has beyond those of the default locale."""
    base = pages.where(F.col(locale) == default).select(slug).distinct()
    others = pages.where(F.col(locale) != default).select(locale, slug).distinct()
    names = [r[0] for r in others.select(locale).distinct().limit(1001).collect()]  # as few as languages
    if len(names) > 1000:
        raise ValueError(f"{locale} has more than 1000 values")
    want = base.select(F.explode(F.array(*map(F.lit, names)).cast("array<string>")).alias(locale), slug)
    missing = want.join(others, [locale, slug], "left_anti").select(locale, slug, F.lit("missing").alias("problem"))
    extra = others.join(base, slug, "left_anti").select(locale, slug, F.lit("extra").alias("problem"))
    return missing.unionByName(extra)


def broken(links: DataFrame, targets: DataFrame, link: str, target: str) -> DataFrame:
    """Links whose target doesn't exist."""
    return links.join(targets.select(F.col(target).alias("_target")).distinct(), F.col(link) == F.col("_target"), "left_anti")


def orphans(assets: DataFrame, used: DataFrame, asset: str, use: str) -> DataFrame:
    """Assets that nothing uses."""
    return assets.join(used.select(F.col(use).alias("_use")).distinct(), F.col(asset) == F.col("_use"), "left_anti")


def resolve_symbols(asked: DataFrame, entries: DataFrame, symbol: str = "symbol") -> DataFrame:
    """`asked` with `found, status`: an entry is known by its title and by Namespace.Title; `ok`, `ambiguous` or `missing`.

    `entries`: `entry_id, namespace, title`.
    """
    names = F.explode(F.array("title", F.concat_ws(".", "namespace", "title"))).alias("name")
    known = entries.select("entry_id", names).groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("entry_id").alias("found"))
    status = F.when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "ambiguous").otherwise("ok")
    out = asked.join(known, F.col(symbol) == F.col("name"), "left").withColumn("status", status)
    return out.withColumn("found", F.when(F.col("status") == "ok", F.col("found"))).drop("name", "n")


def first_symbol(asked: DataFrame, entries: DataFrame, symbol: str = "symbol") -> DataFrame:
    """`asked` with `found`: the first entry of that title, else the first of that dotted name (a lenient lookup)."""
    title = entries.groupBy(F.col("title").alias("t")).agg(F.min("entry_id").alias("by_title"))
    dotted = entries.groupBy(F.concat_ws(".", "namespace", "title").alias("d")).agg(F.min("entry_id").alias("by_name"))
    out = asked.join(title, F.col(symbol) == F.col("t"), "left").join(dotted, F.col(symbol) == F.col("d"), "left")
    return out.withColumn("found", F.coalesce("by_title", "by_name")).drop("t", "d", "by_title", "by_name")


def groups_first_seen(rows: DataFrame, by: list[str], ordinal: str, item: str) -> DataFrame:
    """Groups with `first`, their place by first appearance, and the items in order."""
    return rows.groupBy(*by).agg(F.min(ordinal).alias("first"), F.transform(F.array_sort(F.collect_list(F.struct(F.col(ordinal).alias("at"), F.col(item).alias("item")))), lambda s: s["item"]).alias("items"))


def neighbours(rows: DataFrame, by: list[str], order: list[Column], item: str) -> DataFrame:
    """`rows` with the items before and after in their group, `prev` and `next`. The order is total."""
    return with_neighbours(rows, by, order, [item]).withColumns({"prev": F.col("prev")[item], "next": F.col("next")[item]})


def numbered_slugs(rows: DataFrame, scope: list[str], slug: str, order: str) -> DataFrame:
    """`rows` with `unique_slug`: later ones of a slug get -2, -3, ..."""
    n = F.col("place") + 1
    return in_groups(rows, [*scope, slug], [F.col(order)]).withColumn("unique_slug", F.when(n == 1, F.col(slug)).otherwise(F.concat_ws("-", F.col(slug), n.cast("string")))).drop("place")


def ranked_by_list(rows: DataFrame, column: str, order: list[str]) -> DataFrame:
    """`rows` with `rank`: the place of a value in a fixed list; values that aren't in it come last."""
    at = F.array_position(F.array(*map(F.lit, order)), F.col(column))
    return rows.withColumn("rank", F.when(at > 0, at - 1).otherwise(F.lit(len(order))).cast("int"))


def group_visibility(items: DataFrame, group: str, match: Column) -> DataFrame:
    """`group, visible, hidden`: how many of a group's items match; it's hidden when none does."""
    return items.groupBy(group).agg(F.count_if(match).alias("visible")).withColumn("hidden", F.col("visible") == 0)


def stale(written: DataFrame, expected: DataFrame, path: str = "path", content: str = "hash") -> DataFrame:
    """`path, action`: `write` for new or changed outputs, `delete` for those that aren't expected any more; others are left."""
    e = expected.select(F.col(path).alias("path"), F.col(content).alias("new"))
    w = written.select(F.col(path).alias("path"), F.col(content).alias("old"))
    both = e.join(w, "path", "full")
    action = F.when(F.col("new").isNull(), "delete").when(F.col("old").isNull() | (F.col("old") != F.col("new")), "write")
    return both.select("path", action.alias("action")).where("action IS NOT NULL")


def latest(records: DataFrame, key: list[str], seq: list[Column], version: Column | None = None) -> DataFrame:
    """The last record of each key; with a version asked for, only if the record has it."""
    n = F.row_number().over(Window.partitionBy(*key).orderBy(*(s.desc() for s in seq)))
    out = records.withColumn("_n", n).where("_n = 1").drop("_n")
    return out if version is None else out.where(version)


def rewrite_links(pages: DataFrame, mapping: DataFrame, key: str, body: str, before: str = 'href="', after: str = '"') -> DataFrame:
    """`pages` with the link targets of `body` replaced where `mapping` (`link, target`) has them.

    The links found in all pages are joined to the mapping once; a page then gets its own few replacements. Targets stand
    between `before` and `after`, so one replacement doesn't touch another's text.
    """
    found = pages.select(key, F.explode(F.array_distinct(F.regexp_extract_all(body, F.lit(f"{re.escape(before)}([^\"')]+){re.escape(after)}"), F.lit(1)))).alias("link"))
    own = found.join(mapping, "link").groupBy(F.col(key).alias("_k")).agg(F.collect_list(F.struct("link", "target")).alias("_swap"))
    wrap = lambda c: F.concat(F.lit(before), c, F.lit(after))
    swapped = F.aggregate(F.coalesce("_swap", F.array().cast("array<struct<link:string,target:string>>")), F.col(body), lambda acc, p: F.replace(acc, wrap(p["link"]), wrap(p["target"])))
    return pages.join(own, F.col(key) == F.col("_k"), "left").withColumn(body, swapped).drop("_k", "_swap")


def report(checks: dict[str, DataFrame]) -> DataFrame:
    """`rule, n, ok`: how many violations each check has; a check is the rows that break it."""
    out = None
    for rule, rows in checks.items():
        n = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(rule).alias("rule"), "n", (F.col("n") == 0).alias("ok"))
        out = n if out is None else out.unionByName(n)
    if out is None:
        raise ValueError("no checks")
    return out


def violations(checks: dict[str, tuple[DataFrame, Column]]) -> DataFrame:
    """`rule, subject`: a row for each row that breaks a check, with a text that names it; see report() for the counts."""
    out = None
    for rule, (rows, subject) in checks.items():
        some = rows.select(F.lit(rule).alias("rule"), subject.cast("string").alias("subject"))
        out = some if out is None else out.unionByName(some)
    if out is None:
        raise ValueError("no checks")
    return out


def index_pages(entries: DataFrame, section: str, per_page: int = 5000) -> DataFrame:
    """`path, content`: a section's index of `entries` (`slug, title, description, order`), in order, `per_page` to a page.

    The first page is index.md, later ones index-2.md and so on, so no page holds a whole section of any size.
    """
    ordered, _, _ = in_order(entries.select("slug", "title", "description", "order"), [F.col("order"), F.col("slug")], name="index")
    about = F.when(F.col("description") != "", F.concat(F.lit(": "), "description")).otherwise(F.lit(""))
    line = F.concat(F.lit("- ["), F.coalesce("title", "slug"), F.lit("]("), "slug", F.lit(".md)"), about)
    page = F.floor(F.col("pos") / per_page) + 1
    pages = ordered.select(page.alias("page"), F.struct("pos", line.alias("line")).alias("at")).groupBy("page").agg(F.array_sort(F.collect_list("at")).alias("lines"))
    name = F.when(F.col("page") == 1, F.lit("index")).otherwise(F.concat(F.lit("index-"), F.col("page").cast("string")))
    return pages.select(F.concat(F.lit(f"{section}/"), name, F.lit(".md")).alias("path"), F.concat(F.array_join(F.col("lines.line"), "\n"), F.lit("\n")).alias("content"))
