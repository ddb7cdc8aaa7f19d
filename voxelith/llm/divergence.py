"""Source divergence audit: the terms by which a source stands out in its language, and how far sources are apart.

A group is a source within a language. Terms that few documents of the language have are left out; each group and each
language gives every other term a smoothed probability in billionths, p = 1 + floor(10^9 (count + 1) / (N + V)), and a
term's divergence of p from q is floor((p - q)^2 / q). All arithmetic is on integers.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelith.llm.heavy import bounded
from voxelith.storage import discard, materialise

#: Documents of its language that a term is in at least, and terms reported for each group.
MIN_DOCS, TERMS = 3, 200
#: Entries that a task counts before it passes them on, bytes of text that are split at once, pairs of postings at once.
ENTRIES, PIECE, PAIRS = 400_000, 1 << 20, 1 << 20
#: Bytes to what they are in a term: letters A-Z lower-cased, other ASCII a space, the rest itself.
TERM_BYTES = bytes(c | 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, in lists of about PIECE bytes."""
    text = text.translate(TERM_BYTES)
    start = 0
    while start < len(text):
        end = text.find(b" ", start + PIECE)
        end = len(text) if end < 0 else end
        yield text[start:end].split()
        start = end


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """`lang, source, term, n, docs` of bounded runs of rows; a row with an empty term names each group."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))

    def told() -> pa.RecordBatch:
        lang, source, term, n, docs = [], [], [], [], []
        for (of_lang, of_source), (counts, seen) in held.items():
            m = len(counts) + 1
            lang += [of_lang] * m
            source += [of_source] * m
            term += [b"", *counts]
            n += [0, *counts.values()]
            docs += [0, *map(seen.__getitem__, counts)]
        held.clear()
        arrays = [pa.array(lang, pa.string()), pa.array(source, pa.string()), pa.array(term, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(docs, pa.int64())]
        return pa.RecordBatch.from_arrays(arrays, names=["lang", "source", "term", "n", "docs"])

    size = 0
    for b in batches:
        for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist()):
            counts, docs = held[lang, source]
            size -= len(counts)
            seen: set[bytes] = set()
            for some in terms(text):
                counts.update(some)
                seen.update(some)
            docs.update(seen)
            size += len(counts)
            if size >= ENTRIES:
                yield told()
                size = 0
    if held:
        yield told()


def share(count: str, total: str) -> Column:
    """The probability of a term in billionths; `count` and `total` are SQL. Decimals, so that no count is too large."""
    return F.expr(f"1 + CAST({count} + 1 AS DECIMAL(20, 0)) * 1000000000 DIV ({total})")


def apart(p: str, q: str) -> Column:
    """A term's divergence of `p` from `q`."""
    return F.expr(f"(({p}) - ({q})) * (({p}) - ({q})) DIV ({q})")


def _kept(docs: DataFrame, text_col: str, lang_col: str, source_col: str, min_docs: int) -> DataFrame:
    """`lang, source, term, n, total, first`, written: counts of kept terms in the group and the language.

    One row of each term is its `first`. A row with an empty term names each group. Tasks count their own rows, so a
    source that holds most documents is as many rows of the shuffle as others are. A term's rows in the shuffle and in the
    window are at most one for each source of the language (and each run of a task).
    """
    read = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c2) for c, c2 in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))]
    raw = docs.select(*read).mapInArrow(_counted, "lang string, source string, term string, n bigint, docs bigint")
    each = raw.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    each = each.select("lang", "source", "term", "n", F.sum("docs").over(term).alias("docs"), F.sum("n").over(term).alias("total"), (F.min("source").over(term) == F.col("source")).alias("first"))
    return materialise(each.where((F.col("docs") >= min_docs) | (F.col("term") == "")).drop("docs"), "divergence-counts")


def _groups(kept: DataFrame) -> DataFrame:
    """`gid, lang, source, n_group, n_lang, v, p0`, written: a row per group; `p0` is the probability of a term not in it."""
    real = F.col("term") != ""
    langs = materialise(kept.groupBy("lang").agg(F.sum("n").alias("n_lang"), F.count(F.when(real & F.col("first"), 1)).alias("v")), "divergence-langs")
    each = kept.groupBy("lang", "source").agg(F.sum("n").alias("n_group"))
    each = each.join(bounded(langs), "lang").withColumn("p0", F.when(F.col("v") > 0, share("0", "greatest(1, n_group + v)")))
    out = materialise(each.select(F.monotonically_increasing_id().alias("gid"), "lang", "source", "n_group", "n_lang", "v", "p0"), "divergence-groups")
    discard(langs)
    return out


def _best_terms(priced: DataFrame, buckets: DataFrame, top: int) -> DataFrame:
    """`gid, term, value` of the `top` terms of each group with p > q, ties by the term, written.

    A bucket has the terms of one count in a group, so one p; its least q bounds their divergence from above. Buckets are
    evaluated best bound first, in waves that have twice as many terms each, as long as a group has a bound that isn't
    below its `top`-th value. A wave has at most as many buckets as terms, and these are as few as the report's rows.
    """
    group = Window.partitionBy("gid").orderBy(F.desc("bound"), F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    bound = buckets.withColumn("q_least", share("least", "n_lang + v")).where("p > q_least").withColumn("bound", apart("p", "q_least"))
    ahead = F.coalesce(F.sum("terms").over(group), F.lit(0))
    bound = materialise(bound.select("gid", "n", "bound", F.floor(F.log2(ahead / F.lit(top) + 1)).alias("wave")), "divergence-bounds")
    rank = F.row_number().over(Window.partitionBy("gid").orderBy(F.desc("value"), "term"))
    best = None
    unseen = bound
    while (wave := unseen.agg(F.min("wave")).first()[0]) is not None:
        chosen = materialise(unseen.where(F.col("wave") == wave).select("gid", "n"), "divergence-wave")
        found = priced.join(bounded(chosen), ["gid", "n"]).where("p > q").select("gid", "term", apart("p", "q").alias("value"))
        rows = found if best is None else best.unionByName(found)
        now = materialise(rows.withColumn("rank", rank).where(F.col("rank") <= top).drop("rank"), "divergence-best")
        discard(chosen, *([best] if best is not None else []))
        best = now
        kth = best.groupBy("gid").agg(F.count(F.lit(1)).alias("found"), F.min("value").alias("kth")).where(F.col("found") == top)
        unseen = bound.where(F.col("wave") > wave).join(kth, "gid", "left").where("kth IS NULL OR bound >= kth").select(bound.columns)
    discard(bound)
    return best


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """`gid, other, value`: what terms that both groups have add to their divergence beyond what each alone adds.

    The postings of a term are expanded to ordered pairs of groups in runs of about PAIRS, and summed by pair.
    """
    sums: dict[tuple[int, int], int] = defaultdict(int)

    def told() -> pa.RecordBatch:
        arrays = [pa.array([k[0] for k in sums], pa.int64()), pa.array([k[1] for k in sums], pa.int64()), pa.array(list(sums.values()), pa.int64())]
        sums.clear()
        return pa.RecordBatch.from_arrays(arrays, names=["gid", "other", "value"])

    for b in batches:
        lists = b.column(0)
        flat = lists.flatten()
        gid, p, p0 = (flat.field(i).to_numpy() for i in range(3))
        if not len(gid):
            continue
        size = lists.value_lengths().to_numpy()
        groups, local = np.unique(gid, return_inverse=True)
        start = np.repeat(np.cumsum(size) - size, size)  # where each posting's term starts
        partners = np.repeat(size, size)
        upto = np.cumsum(partners)
        low = 0
        while low < len(gid):
            high = max(low + 1, int(np.searchsorted(upto, (upto[low - 1] if low else 0) + PAIRS, "right")))
            n = partners[low:high]
            i = np.repeat(np.arange(low, high), n)
            j = start[i] + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
            i, j = i[i != j], j[i != j]
            f = lambda x, y: (x - y) * (x - y) // y
            value = f(p[i], p[j]) - f(p[i], p0[j]) - f(p0[i], p[j]) + f(p0[i], p0[j])
            key, at = np.unique(local[i] * len(groups) + local[j], return_inverse=True)
            total = np.zeros(len(key), np.int64)
            np.add.at(total, at, value)
            for x, y, v in zip(groups[key // len(groups)].tolist(), groups[key % len(groups)].tolist(), total.tolist()):
                sums[x, y] += v
            low = high
            if len(sums) > ENTRIES:
                yield told()
    if sums:
        yield told()


def _pairs(priced: DataFrame, buckets: DataFrame, groups: DataFrame) -> DataFrame:
    """`gid, other, value` of all ordered pairs of groups of a language: the divergence summed over its kept terms.

    A sum has four parts: all terms as if neither had them, and what is added by those of one group, those of the other
    (both from the buckets, each with the number of its terms) and those of both (from postings).
    """
    other = groups.select("lang", F.col("gid").alias("other"), F.col("p0").alias("o0"))
    own = groups.select("lang", "gid", "v", "p0")
    none = own.join(other, "lang").where("gid <> other").select("gid", "other", F.when(F.col("v") > 0, F.col("v") * apart("p0", "o0")).otherwise(0).alias("value"))
    alone = buckets.join(bounded(other), "lang").where("gid <> other")
    to = alone.select("gid", "other", (F.col("terms") * (apart("p", "o0") - apart("p0", "o0"))).alias("value"))
    back = alone.select(F.col("other").alias("gid"), F.col("gid").alias("other"), (F.col("terms") * (apart("o0", "p") - apart("o0", "p0"))).alias("value"))
    posts = priced.groupBy("lang", "term").agg(F.collect_list(F.struct("gid", "p", "p0")).alias("posts"))
    both = posts.where("size(posts) > 1").select("posts").mapInArrow(_met, "gid bigint, other bigint, value bigint")
    return none.unionByName(to).unionByName(back).unionByName(both).groupBy("gid", "other").agg(F.sum("value").alias("value"))


def divergence(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = MIN_DOCS, top: int = TERMS
) -> DataFrame:
    """`lang, source, part, item, value, rank`: how each source of a language stands out from it and from the others.

    Part `term`: up to `top` terms that the group has and gives a higher probability than its language, by divergence
    from the language. Part `pair`: every other source of the language, by the divergence from it over all kept terms.
    Ties go by the item in order of its bytes in UTF-8. A language keeps terms that `min_docs` of its documents have.

    Null texts, languages and sources count as empty. Repeated rows are documents of their own. Texts of any length are
    read whole. A group without terms has pairs, of value 0 if its language keeps no term. Other columns play no part. An
    empty table gives no rows. A term's postings, one for each source of the language, are one row; pairs of sources are
    as many as the report has rows. Buckets of a group have distinct counts, so they are at most the root of twice its
    words.
    """
    kept = _kept(docs, text_col, lang_col, source_col, min_docs)
    groups = _groups(kept)
    near = bounded(groups)
    priced = kept.where("term <> ''").join(near, ["lang", "source"])
    priced = priced.select("gid", "lang", "term", "n", "total", "n_lang", "v", "p0", share("n", "n_group + v").alias("p"), share("total", "n_lang + v").alias("q"))
    buckets = priced.groupBy("gid", "n").agg(F.count(F.lit(1)).alias("terms"), F.min("total").alias("least"), *(F.first(c).alias(c) for c in ("lang", "n_lang", "v", "p0", "p")))
    buckets = materialise(buckets, "divergence-buckets")
    pairs = _pairs(priced, buckets, groups).select("gid", F.lit("pair").alias("part"), "other", F.lit(None).cast("string").alias("term"), "value")
    best = _best_terms(priced, buckets, top)
    names = groups.select(F.col("gid").alias("other"), F.col("source").alias("other_source"))
    rows = pairs.join(bounded(names), "other").select("gid", "part", F.col("other_source").alias("item"), "value")
    if best is not None:
        rows = rows.unionByName(best.select("gid", F.lit("term").alias("part"), F.col("term").alias("item"), "value"))
    rank = F.row_number().over(Window.partitionBy("gid", "part").orderBy(F.desc("value"), "item")).cast("int")
    rows = rows.withColumn("rank", rank)
    return rows.join(near.select("gid", "lang", "source"), "gid").select("lang", "source", "part", "item", "value", "rank")
