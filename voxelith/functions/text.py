"""Text functions of documentation corpora, as columns."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions that can be loaded, image types by extension, size units, and reference patterns.
LOADABLE = [".ply", ".spz", ".splat", ".ksplat", ".lcc", ".sog", ".esz", ".json"]
MIME = {".gif": "image/gif", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".png": "image/png", ".svg": "image/svg+xml", ".webp": "image/webp"}
UNITS = ["B", "KB", "MB", "GB"]
EXTERNAL = r"(?i)^[a-z][a-z\d+.-]*:"
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")]
NAMED = {"&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&nbsp;": "\u00a0"}
API = "api:"


def kebab_case(c: Column) -> Column:
    """Words in lower case joined by hyphens; capitals, acronyms and numbers begin words."""
    for pattern, to in ((r"([A-Z]+)([A-Z][a-z])", "$1-$2"), (r"([a-z])([A-Z])", "$1-$2"), (r"([A-Za-z])(\d+)", "$1-$2"), (r"[\s_]+", "-")):
        c = F.regexp_replace(c, pattern, to)
    return F.lower(c)


def search_terms(c: Column) -> Column:
    """The words of a text, split where the case changes and at anything but letters and digits, in lower case."""
    c = F.regexp_replace(F.regexp_replace(c, r"([a-z0-9])([A-Z])", "$1 $2"), r"([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.filter(F.split(F.lower(c), r"[^a-z0-9]+"), lambda t: t != "")


def matches(text: Column, query: Column) -> Column:
    """Whether a search finds the text: its words run together hold the query's, or each word of the query begins one."""
    words, asked = search_terms(text), search_terms(query)
    begins = F.forall(asked, lambda q: F.exists(words, lambda w: F.startswith(w, q)))
    return F.contains(F.concat_ws("", words), F.concat_ws("", asked)) | begins


def url_file_name(c: Column) -> Column:
    """The last part of a URL's path, decoded; the host if it has none; the text itself if it isn't a URL."""
    path = F.try_parse_url(c, F.lit("PATH"))
    parts = F.filter(F.split(F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path), "/"), lambda p: p != "")
    name = F.when(F.size(parts) > 0, F.element_at(parts, -1))
    return F.when(c.rlike(r"^[A-Za-z][A-Za-z\d+.-]*://[^/\s]"), F.coalesce(name, F.try_parse_url(c, F.lit("HOST")), c)).otherwise(c)


def extension(c: Column) -> Column:
    """From the last dot on, in lower case, without a query or fragment; empty without a dot."""
    return F.lower(F.regexp_extract(F.regexp_replace(c, r"(?s)[?#].*$", ""), r"(\.[^./\\]*)$", 1))


def format_label(c: Column) -> Column:
    last = F.upper(F.element_at(F.split(c, r"\."), -1))
    return F.when(last == "", F.lit("Unknown")).otherwise(last)


def format_bytes(c: Column) -> Column:
    """A size in the largest unit up to GB that leaves 1 or more; one decimal under 10, none for bytes."""
    n = c.cast("double")
    e = F.when(n >= 1024.0**3, 3).when(n >= 1024.0**2, 2).when(n >= 1024.0, 1).otherwise(0)
    value = n / F.pow(F.lit(1024.0), e)
    whole = F.floor(value + 0.5).cast("bigint").cast("string")
    tenth = F.format_string("%.1f", F.floor(value * 10 + 0.5) / 10)
    unit = F.element_at(F.array(*map(F.lit, UNITS)), e + 1)
    return F.when(n <= 0, F.lit("0 B")).otherwise(F.concat(F.when((value >= 10) | (e == 0), whole).otherwise(tenth), F.lit(" "), unit))


def colour_int(c: Column) -> Column:
    return F.conv(F.substring(c, 2, 6), 16, 10).cast("bigint")


def split_trailing(c: Column) -> tuple[Column, Column]:
    """(path, what follows from the first ? or #)."""
    return F.regexp_extract(c, r"(?s)^([^?#]*)", 1), F.regexp_extract(c, r"(?s)^[^?#]*(.*)$", 1)


def is_external(c: Column) -> Column:
    return c.rlike(EXTERNAL)


def is_api(c: Column) -> Column:
    return F.startswith(split_trailing(c)[0], F.lit(API))


def is_local(c: Column) -> Column:
    return ~F.startswith(c, F.lit("/")) & ~F.startswith(c, F.lit("#")) & ~is_external(c)


def is_banned(c: Column, patterns: list[str]) -> Column:
    """Whether one of the user's patterns of links that mustn't be published occurs in a text, in any case of letters."""
    return c.rlike("(?i)(?:" + "|".join(patterns) + ")") if patterns else F.lit(False)


def link_targets(c: Column) -> Column:
    """Targets of Markdown links (not of images) and then of href attributes, in order."""
    links = F.regexp_extract_all(c, F.lit(r"(?:^|[^!])\[[^\]]*\]\(([^)]+)\)"), F.lit(1))
    return F.concat(links, href_targets(c))


def href_targets(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"\bhref=([\"'])([^\"']+)\1"), F.lit(2))


def heading_signature(c: Column) -> Column:
    """Depths of the headings of level 2 to 6, joined by commas; fences and front matter aren't skipped."""
    marks = F.regexp_extract_all(c, F.lit(r"(?m)^(#{2,6})[^\S\r\n]+\S"), F.lit(1))
    return F.array_join(F.transform(marks, lambda m: F.length(m).cast("string")), ",")


def headings(c: Column) -> Column:
    """`level, text` of HTML headings in order; tags stripped, entities decoded."""
    found = F.regexp_extract_all(c, F.lit(r"(?s)<h[1-6]\b[^>]*>.*?</h[1-6]>"), F.lit(0))
    return F.transform(found, lambda h: F.struct(F.substring(h, 3, 1).cast("int").alias("level"), F.trim(decode_entities(strip_tags(h))).alias("text")))


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, r"<[^>]*>", "")


def decode_entities(c: Column, ampersand_first: bool = False) -> Column:
    """Basic entities decoded. `&amp;` comes last, so that `&amp;lt;` stays `&lt;`; first, it becomes `<`."""
    for name, to in ([("&amp;", "&")] if ampersand_first else []) + ENTITIES + ([] if ampersand_first else [("&amp;", "&")]):
        c = F.replace(c, F.lit(name), F.lit(to))
    return c


def unescape(c: Column) -> Column:
    """Named and numeric entities decoded once each, from left to right; unknown ones stay. Null stays null.

    Numbers may be decimal or hexadecimal; those that are no character become U+FFFD.
    """
    pattern = r"&(?:#[0-9]{1,9}|#[xX][0-9a-fA-F]{1,8}|[A-Za-z]{2,8});"

    def decoded(e: Column) -> Column:
        hexed = e.rlike("^&#[xX]")
        number = F.when(hexed, F.conv(F.regexp_extract(e, "^&#[xX](.*);$", 1), 16, 10)).when(F.startswith(e, F.lit("&#")), F.regexp_extract(e, "^&#(.*);$", 1)).cast("bigint")
        good = (number > 0) & (number <= 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(F.when(good, number).otherwise(F.lit(0xFFFD))), 8, "0")), "UTF-32")
        named = F.element_at(F.create_map(*(F.lit(x) for pair in NAMED.items() for x in pair)), e)
        return F.when(number.isNotNull(), char).otherwise(F.coalesce(named, e))

    between, found = F.split(c, pattern, -1), F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), decoded)
    return F.array_join(F.transform(F.arrays_zip(between.alias("t"), found.alias("e")), lambda x: F.concat(x["t"], F.coalesce(x["e"], F.lit("")))), "")


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"[\s ]+", " "))


def hashed_name(path: Column, content: Column) -> Column:
    """The path with 16 characters of the content's SHA-256 (base64url) before its extension."""
    digest = F.substring(F.translate(F.base64(F.unhex(F.sha2(content, 256))), "+/", "-_"), 1, 16)
    return F.concat(F.regexp_replace(path, r"\.[^./]*$", ""), F.lit("."), digest, F.regexp_extract(path, r"(\.[^./]*)$", 1))


def mime_type(path: Column) -> Column:
    out = F.lit("application/octet-stream")
    for ext, kind in MIME.items():
        out = F.when(extension(path) == ext, F.lit(kind)).otherwise(out)
    return out


def locale_path(locale: Column, path: Column) -> Column:
    return F.regexp_replace(F.concat(F.lit("/"), locale, F.lit("/"), path), r"/{2,}", "/")


def normalise_path(base: Column, href: Column) -> Column:
    """`href` seen from the folder `base`, with `.` and `..` worked out; `..` at the top goes nowhere."""
    start = F.when(base == "", F.array().cast("array<string>")).otherwise(F.split(base, "/"))

    def step(acc: Column, part: Column) -> Column:
        up = F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
        return F.when((part == ".") | (part == ""), acc).when(part == "..", up).otherwise(F.array_append(acc, part))

    return F.array_join(F.aggregate(F.split(href, "/"), start, step), "/")


def relative_md(source: Column, target: Column) -> Column:
    """The path of the Markdown page `target` as seen from the page `source`."""
    a, b = F.split(source, "/"), F.split(target, "/")
    own = F.slice(a, F.lit(1), F.size(a) - 1)
    same = F.transform(F.arrays_zip(own.alias("l"), b.alias("r")), lambda x: x["l"].eqNullSafe(x["r"]))
    first_off = F.array_position(same, F.lit(False))
    common = F.when(first_off > 0, first_off - 1).otherwise(F.least(F.size(own), F.size(b))).cast("int")
    ups = F.size(own) - common
    down = F.array_join(F.slice(b, common + 1, F.greatest(F.size(b) - common, F.lit(0))), "/")
    return F.concat(F.when(ups == 0, F.lit("./")).otherwise(F.repeat(F.lit("../"), ups)), down, F.lit(".md"))


#: The sections that a manual page may point to.
SECTIONS = ("examples", "api", "manual")


def manual_href(href: Column, slug: Column) -> Column:
    """A manual page's link as the Markdown corpus has it, null if it stays as it is; `slug` is the page of an api: link.

    Links to other sections (two folders up, then the section) become pages of that section, a section alone its index.
    Links to Markdown pages stay; external links, root links and fragments aren't rewritten.
    """
    path, tail = split_trailing(href)
    parts = F.split(path, "/")
    outside = (F.size(parts) > 3) & (F.get(parts, F.lit(0)) == "..") & (F.get(parts, F.lit(1)) == "..") & F.get(parts, F.lit(2)).isin(*SECTIONS)
    page = F.array_join(F.filter(F.slice(parts, 4, F.greatest(F.size(parts) - 3, F.lit(0))), lambda p: p != ""), "/")
    page = F.concat(F.lit("../"), F.get(parts, F.lit(2)), F.lit("/"), F.when(page == "", "index").otherwise(page), F.lit(".md"), tail)
    untouched = (href == "") | is_external(href) | F.startswith(href, F.lit("/")) | F.startswith(href, F.lit("#"))
    api = F.concat(F.lit("../api/"), slug, F.lit(".md"))
    return F.when(is_api(href), api).when(untouched, F.lit(None)).when(outside, page).when(F.endswith(path, F.lit(".md")), href)


def site_href(href: Column, page: Column, locale: Column, slug: Column) -> Column:
    """A manual page's link as the web site has it, null if it stays as it is.

    `page` is the Markdown page's path in its locale's folder, `slug` the page of an api: link. Links to Markdown pages
    inside that folder become routes of the manual, others that lead out of it, to other files or to the web stay. What
    follows from the first ? or # is kept.
    """
    path, tail = split_trailing(href)
    folder = F.regexp_replace(page, "[^/]*$", "")
    parts = F.split(F.concat(folder, path), "/")
    depth = lambda acc, p: F.when(p == "..", acc - 1).when((p == "") | (p == "."), acc).otherwise(acc + 1)
    step = lambda acc, p: F.struct(depth(acc["at"], p).alias("at"), F.least(acc["least"], depth(acc["at"], p)).alias("least"))
    inside = F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.lit(0).alias("least")), step, lambda acc: acc["least"]) >= 0
    to = F.regexp_replace(normalise_path(F.lit(""), F.concat(folder, path)), r"(?i)\.md$", "")
    route = F.concat(F.lit("/"), locale, F.lit("/manual/"), to, F.lit("/"), tail)
    api = F.concat(F.lit("/"), locale, F.lit("/api/"), slug, F.lit("/"), tail)
    return F.when(is_api(href), api).when(is_local(href) & F.lower(path).endswith(".md") & inside & (to != ""), route)


def api_symbol(href: Column) -> Column:
    """The symbol of an api: link, null for other links."""
    return F.when(is_api(href), F.trim(F.regexp_extract(href, "(?s)^.{4}([^#?]*)", 1)))


def api_href(href: Column, current: Column, locale: str) -> Column:
    """A link of the API page `current` as the Markdown corpus has it: API pages of the locale by relative paths, web
    links as they are, others null."""
    base = f"/{locale}/api/"
    rest = F.substring(href, F.lit(len(base) + 1), F.length(href))
    page, tag = F.regexp_replace(F.regexp_extract(rest, "^([^#]*)", 1), "/$", ""), F.regexp_extract(rest, "(?s)(#.*)$", 1)
    own = F.concat(F.when(page == "", F.lit("./index.md")).otherwise(relative_md(current, page)), tag)
    return F.when(F.startswith(href, F.lit(base)), own).when(href.rlike("^https?://"), href)


def locale_codes(source: Column) -> Column:
    """The codes in a source text that lists locales as `code: '...'`, in order; a text without one is an error, null stays null."""
    found = F.regexp_extract_all(source, F.lit(r"""code:\s*["']([^"']+)["']"""), F.lit(1))
    return F.when(F.size(found) == 0, F.raise_error(F.lit("no locale in the source"))).otherwise(found)


def json_part(source: Column) -> Column:
    """What stands from the first brace to the last in a source text, null without such a part."""
    found = F.regexp_extract(source, r"(?s)(\{.*\})", 1)
    return F.when(found != "", found)


def constant_json(source: Column, name: str, schema: str) -> Column:
    """The value of `export const <name> = ... as const;` in a source text, parsed by `schema`.

    Null without such a constant at the text's start, and where it's no JSON of that schema's kind.
    """
    value = F.regexp_extract(source, rf"(?s)^export const {re.escape(name)} = (.*?) as const;\s*export type ", 1)
    return F.from_json(F.when(value != "", value), schema)


def split_urls(c: Column) -> Column:
    return F.filter(F.split(c, r"[\s,]+"), lambda x: x != "")


def file_kind(name: Column, head: Column) -> Column:
    """The splat file type by its first bytes or, failing that, its extension; null if it can't be loaded."""
    text = F.decode(F.substring(head, 1, 4), "ISO-8859-1")
    by_name = F.when(F.lower(name).rlike(r"\.compressed\.ply([?#].*)?$"), F.lit("compressed.ply"))
    for ext in LOADABLE:
        by_name = by_name.when(extension(name) == ext, F.lit(ext[1:]))
    return F.when(F.startswith(text, F.lit("{")), F.lit("json")).when(F.startswith(text, F.lit("PK\x03\x04")), F.lit("sog")).otherwise(F.coalesce(F.when(F.startswith(text, F.lit("ply")) & F.isnull(by_name), F.lit("ply")), by_name))


def front_matter(c: Column, strict: bool = True) -> Column:
    """The `key: value` lines between leading `---` marks, as a map; null where a strict reader finds no end mark.

    A lenient reader takes a page without an end mark as one without front matter, and takes quotes off only in pairs;
    a strict one takes a quote off either end.
    """
    block = F.regexp_extract(c, r"(?s)^---(.*?)\r?\n---\r?\n", 1)
    lines = F.filter(F.split(block, r"\r?\n"), lambda x: x.rlike(r"^[A-Za-z0-9_-]+:"))

    def pair(x: Column) -> Column:
        v = F.regexp_extract(x, r"^[A-Za-z0-9_-]+:\s*(.*)$", 1)
        v = F.trim(F.regexp_replace(v, r"^[\"']|[\"']$", "")) if strict else F.trim(F.regexp_replace(F.trim(v), r"^([\"'])(.*)\1$", "$2"))
        return F.struct(F.regexp_extract(x, r"^([A-Za-z0-9_-]+):", 1).alias("key"), v.alias("value"))

    last = F.map_from_entries(F.transform(lines, pair))
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    ended = c.rlike(r"(?s)^---(.*?)\r?\n---\r?\n")
    unended = F.lit(None) if strict else none
    return F.when(~F.startswith(c, F.lit("---")), none).when(ended, last).otherwise(unended)


class _Fence(str):
    """Finished code, whose white space stays as it is."""


class _Page(HTMLParser):
    """Markdown of one page, in one pass over its events.

    `out` has the pieces so far, `filled` the places of those that aren't blank, `open` the open tags with the place of each in `out`, where a mark can be put when the
    end tag comes; a tag that is never closed leaves no mark. Work is linear in the page's length.
    """

    MARKS = {"strong": "**", "b": "**", "em": "*", "i": "*"}
    BLOCKS = frozenset("p section article div details summary table tr blockquote".split())
    HEADINGS = frozenset(f"h{i}" for i in range(1, 7))
    UNSEEN = frozenset(("svg", "script", "style"))

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.filled: list[int] = []
        self.open: list[tuple[str, int, str]] = []
        self.count: Counter[str] = Counter()
        self.lists: list[list] = []
        self.item: int | None = None

    def _put(self, piece: str) -> None:
        if piece.strip():
            self.filled.append(len(self.out))
        self.out.append(piece)

    def _take(self, at: int) -> str:
        text = "".join(self.out[at:])
        del self.out[at:]
        del self.filled[bisect_left(self.filled, at) :]
        return text

    def _end_item(self) -> None:
        """The item's text on one line, 20 levels deep at most; an item without text goes, and its number with it."""
        if self.item is None:
            return
        text = " ".join(self._take(self.item).split())
        kind, n = self.lists[-1]
        self.item = None
        if text:
            self.lists[-1][1] = n + 1
            self._put("  " * min(len(self.lists) - 1, 20) + (f"{n + 1}. " if kind == "ol" else "- ") + text + "\n")

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        about = dict(attrs)
        if tag in ("br", "wbr", "img", "hr", "input", "meta", "link"):
            if tag == "br" and not self.count["svg"]:
                self._put("\n")
            return
        if tag == "a" and self.count["a"]:
            self.handle_endtag("a")
        if tag in ("ul", "ol"):
            self._end_item()
            self._put("\n\n" if not self.lists else "")
            self.lists.append([tag, 0])
        elif tag == "li" and self.lists:
            self._end_item()
            self.item = len(self.out)
        elif tag in self.BLOCKS or tag in self.HEADINGS or tag == "pre":
            self._put("\n\n")
        note = about.get("href") if tag == "a" else about.get("class") if tag == "code" else None
        self.open.append((tag, len(self.out), note or ""))
        self.count[tag] += 1
        if tag in self.MARKS:
            self._put("")

    def handle_endtag(self, tag: str) -> None:
        if not self.count[tag]:
            return
        while True:
            name, at, note = self.open.pop()
            self.count[name] -= 1
            if name in ("ul", "ol") and self.lists:
                self._end_item()
                self.lists.pop()
                self._put("\n" if not self.lists else "")
            if name == tag:
                break
        if tag in self.MARKS:
            self._wrap(at, self.MARKS[tag])
        elif tag == "a":
            text = self._take(at).strip()
            self._put(f"[{text}]({note})" if text and note else text or note)
        elif tag == "code" and not self.count["pre"]:
            self._put("`" + self._take(at).replace("`", "\\`") + "`")
        elif tag == "code":
            self.language = re.search(r"language-([\w-]+)", note)
        elif tag == "pre":
            language, self.language = getattr(self, "language", None), None
            self._put(_Fence(f"```{language[1] if language else ''}\n{self._take(at).strip(chr(10))}\n```"))
            self._put("\n\n")
        elif tag in self.HEADINGS:
            text = " ".join(self._take(at).split())
            self._put(f"{'#' * int(tag[1])} {text}\n\n" if text else "")
        elif tag == "li":
            self._end_item()
        elif tag in self.BLOCKS:
            self._put("\n\n")

    def _wrap(self, at: int, mark: str) -> None:
        k = bisect_left(self.filled, at + 1)
        if k < len(self.filled):
            first = self.filled[k]
            self.out[first] = self.out[first].lstrip()
            self.out[-1] = self.out[-1].rstrip()
            self.out[at] = mark
            self.filled.insert(k, at)
            self._put(mark)

    def handle_data(self, data: str) -> None:
        if not any(self.count[t] for t in self.UNSEEN):
            self._put(data)

    def markdown(self) -> str:
        self.close()
        self._end_item()
        done, run = [], []
        for piece in [*self.out, _Fence("")]:
            if not isinstance(piece, _Fence):
                run.append(piece)
                continue
            text = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n", "\n", "".join(run))).strip()
            done += [t for t in (text, str(piece)) if t]
            run = []
        return "\n\n".join(done)


def markdown_of(page: str) -> str:
    """One page of HTML as Markdown: headings, lists within lists, links, emphasis, code; other blocks are paragraphs."""
    parser = _Page()
    parser.feed(page)
    return parser.markdown()


def html_to_markdown(page: Column) -> Column:
    """HTML as Markdown, page by page; null stays null."""

    @F.pandas_udf("string")
    def convert(pages: pd.Series) -> pd.Series:
        return pages.map(lambda p: None if p is None else markdown_of(p))

    return convert(page)
