"""Near-duplicate classes: DartMinHash signatures of weighted word shingles, banded joining, and exact verification."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelith.graphs import forest, with_roots
from voxelith.llm.dart_minhash import GOLDEN, MASK, U, mix, signatures
from voxelith.llm.heavy import SUPPORT, attach
from voxelith.llm.texts import with_columns
from voxelith.storage import clashless, columns, discard, materialise, row_hash

SHINGLE = 5
SIMILARITY = 0.8
#: 24 bands of 5 coordinates miss a pair of similarity 0.8 once in 14,000, one of 0.85 once in 700,000.
BANDS, ROWS = 24, 5
#: Bits of the bitmaps that rule pairs out.
BITS = 1024
#: Nodes of a bucket that are compared with as many others in one group.
PART_ROWS = 500
#: Ids that are broadcast at most; more are joined by a shuffle.
BROADCAST_ROWS = 200_000


class _Hashes(dict):
    """Hashes of words, forgotten when there are many."""

    def __missing__(self, word: str) -> int:
        if len(self) > 150_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _Hashes()


def shingles(text: str, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts) of the text's runs of `width` words (runs of word characters, lower-cased); hashes sorted.

    A text of fewer words has one shingle of them all, a text without words has none.
    """
    words = re.findall(r"\w+", text.lower())
    if not words:
        return np.empty(0, U), np.empty(0, np.int64)
    h = np.fromiter(map(_hashes.__getitem__, words), U, len(words))
    n = max(1, len(h) - width + 1)
    acc = np.zeros(n, U)
    for j in range(min(width, len(h))):
        acc = mix(acc * U(3) + h[j : j + n] + U(j + 1))
    return np.unique(acc, return_counts=True)


def occurrences(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A hash of its own for each occurrence of a shingle: the Jaccard similarity of such sets is the weighted one."""
    first = np.repeat(np.cumsum(counts) - counts, counts)
    nth = (np.arange(len(first)) - first).astype(U)
    each = np.repeat(hashes, counts)
    return np.where(nth == 0, each, mix(each ^ nth * U(GOLDEN & MASK)))


def _sign(model: dict, texts: list[str]) -> list[list]:
    sets = [shingles(t, model["width"]) for t in texts]
    each = np.array([len(h) for h, _ in sets])
    n = [int(c.sum()) for _, c in sets]
    cat = lambda i, kind: np.concatenate([*(s[i] for s in sets), np.empty(0, kind)]).astype(kind)
    sig = signatures(cat(0, U), np.repeat(np.arange(len(sets)), each), len(sets), model["bands"] * model["rows"], cat(1, np.float64))
    sig = sig.reshape(len(sets), model["bands"], model["rows"])
    key = np.zeros(sig.shape[:2], U) + np.arange(model["bands"], dtype=U)
    for j in range(model["rows"]):
        key = mix(key * U(5) + sig[:, :, j])
    same = [xxhash.xxh3_128_hexdigest(h.tobytes() + c.tobytes()) if len(h) else None for h, c in sets]
    return [same, n, [k if m else [] for k, m in zip(key.view(np.int64), n)]]


def _signed(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """`doc_id, text_md5, same, n, bands` from `doc_id, text_md5, text`. `same` is equal for equal sets of shingles."""
    model = {"width": width, "bands": bands, "rows": rows}
    new = [("same", "string", pa.string()), ("n", "int", pa.int32()), ("bands", "array<bigint>", pa.list_(pa.int64()))]
    return with_columns(docs, F.col("text"), lambda: lambda texts: _sign(model, texts), new, ["doc_id", "text_md5"])


def _shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """`node, sh, n, bits` from `node, text`: the shingles' occurrences, their number, and a bitmap of them."""

    def work(texts: list[str]) -> list[list]:
        sets = [occurrences(*shingles(t, width)) for t in texts]
        odd = [np.packbits((np.bincount((s & U(BITS - 1)).astype(np.int64), minlength=BITS) & 1).astype(np.uint8)).view(np.int64) for s in sets]
        return [[s.view(np.int64) for s in sets], [len(s) for s in sets], odd]

    new = [("sh", "array<bigint>", pa.list_(pa.int64())), ("n", "int", pa.int32()), ("bits", "array<bigint>", pa.list_(pa.int64()))]
    return with_columns(docs, F.col("text"), lambda: work, new, ["node"])


def _bounded(df: DataFrame) -> DataFrame:
    """`df`, a written table, to be broadcast if it's counted to be small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _verdicts(docs: DataFrame, id_col: str, text_col: str, width: int, similarity: float, bands: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """(signed rows, one verdict per set of shingles), both written; see near_classes()."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    given = docs.select(F.col(id_col).alias("doc_id"), F.md5(F.encode(text, "UTF-8")).alias("text_md5"), text.alias("text"))
    signed = materialise(_signed(given, width, bands, rows).withColumn("rid", F.monotonically_increasing_id()), "near-signed")

    n = signed.count()  # bounds the rows of what follows

    # Equal sets: one node each, the row of least id. Partial minima are taken before the shuffle.
    best = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_md5", "rid", "bands")).alias("best")
    nodes = signed.where("same IS NOT NULL").groupBy("same").agg(best, F.count(F.lit(1)).alias("copies"))
    nodes = materialise(nodes.select("same", "copies", F.col("best.rid").alias("node"), "best.no_id", "best.doc_id", "best.text_md5", "best.bands"), "near-nodes", n)

    # Buckets of two nodes or more; the least one leads. Both sides of the join are written tables, so that Spark can
    # split a bucket that very many nodes are in.
    slots = nodes.select(F.explode("bands").alias("bucket"), "node")
    leads = slots.groupBy("bucket").agg(F.count(F.lit(1)).alias("c"), F.min("node").alias("lead")).where("c > 1")
    leads = materialise(leads.drop("c"), "near-leads", n * bands)
    live = materialise(slots.join(leads, "bucket"), "near-buckets", n * bands)
    wanted = materialise(nodes.select("node", "doc_id", "text_md5", "bands").join(live.select("node").distinct(), "node", "left_semi"), "near-wanted", n)
    sets = _sets_of(given, wanted, width)

    pairs = live.where("node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct()
    links = _verified(pairs, sets, similarity, n * bands)
    below = forest(links, "near-forest", n)

    # What is left to compare are nodes of different classes in one bucket, but for its lead.
    classed = materialise(live.select("bucket", "node", "lead").join(below, "node", "left").select("bucket", "node", "lead", F.coalesce("label", "node").alias("label")), "near-classed", n * bands)
    mixed = _mixed(classed, n * bands)
    if not mixed.isEmpty():
        about = sets.select("node", "n", "bits").join(wanted.select("node", "bands"), "node")
        slots = materialise(classed.join(mixed, "bucket").join(about, "node"), "near-slots", n * bands)
        alike = F.least("n", "n2") >= F.greatest("n", "n2") * similarity
        more = _verified(_candidates(slots, alike & _may_reach(similarity)), sets, similarity)
        if not more.isEmpty():
            stars = below.select(F.col("node").alias("a"), F.col("label").alias("b"))
            below = forest(stars.unionByName(more), "near-forest", n)
        discard(slots, more)
    discard(leads, live, wanted, sets, links, classed, mixed)

    # Classes of one node are settled; those of several are summed by label.
    named = materialise(nodes.drop("bands").join(with_roots(below), "node", "left"), "near-named", n)
    several = named.where("label IS NOT NULL")
    best = F.min(F.struct("no_id", "doc_id", "node")).alias("best")
    total = several.groupBy("label").agg(best, F.sum("copies").alias("class_size"), F.count(F.lit(1)).alias("group_size"))
    total = materialise(total.select("label", F.struct(F.col("best.doc_id").alias("class_id"), F.col("best.node").alias("kept"), "class_size").alias("best"), "group_size"), "near-totals", n)
    common = F.col("group_size") > several.count() * SUPPORT  # so 1 / SUPPORT labels at most
    several = attach(several, total.where(common), total.where(~common), "label").select("same", "copies", "node", "doc_id", "text_md5", "best.*")
    alone = named.where("label IS NULL").select("same", "copies", "node", "doc_id", "text_md5", F.col("doc_id").alias("class_id"), F.col("node").alias("kept"), F.col("copies").alias("class_size"))
    out = materialise(several.unionByName(alone), "near-verdicts", n)
    discard(nodes, below, named, total)
    return signed, out


def _sets_of(given: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    w = wanted.select("node", F.col("doc_id").alias("w_id"), F.col("text_md5").alias("w_md5"))
    on = given.text_md5.eqNullSafe(F.col("w_md5")) & given.doc_id.eqNullSafe(F.col("w_id"))
    sets = materialise(_shingle_sets(given.join(_bounded(w), on).select("node", "text"), width), "near-sets")
    if sets.count() == wanted.count():
        return sets
    once = materialise(sets.dropDuplicates(["node"]), "near-sets")  # repeated rows give a node's set more than once
    discard(sets)
    return once


def _mixed(classed: DataFrame, rows: int) -> DataFrame:
    """`bucket, major, parts, chunks` of the buckets that hold several classes, written.

    `major` is the label of most of the bucket's nodes. Nodes of other classes are compared with all; `parts` and `chunks`
    are how many groups of about PART_ROWS the bucket's nodes and those of other classes are dealt to.
    """
    each = classed.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("c"))
    each = each.groupBy("bucket").agg(F.sum("c").alias("m"), F.max(F.struct("c", "label")).alias("top"), F.count(F.lit(1)).alias("classes")).where("classes > 1")
    groups = lambda n: F.ceil(n / PART_ROWS).cast("int")
    return materialise(each.select("bucket", F.col("top.label").alias("major"), groups(F.col("m")).alias("parts"), groups(F.col("m") - F.col("top.c")).alias("chunks")), "near-mixed", rows)


def _candidates(slots: DataFrame, reach: Column) -> DataFrame:
    """Pairs (a, b) of nodes of different classes that share a bucket, `reach` each other and aren't its lead.

    A bucket's nodes are dealt to parts, those outside its major class to chunks, and each part meets each chunk in a
    group of its own. Only pairs in reach leave the join, in the first of the buckets that they share: where that holds
    one class only or one of the pair leads it, they have been settled.
    """
    place = F.array_position("bands", F.col("bucket"))
    slots = slots.withColumn("place", place).where("node <> lead")
    rest = slots.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumn("part", F.pmod(F.hash("node"), F.col("parts")))
    other = slots.where("label <> major").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("chunk", F.pmod(F.hash("node"), F.col("chunks")))
    other = other.select("bucket", "part", "chunk", *(F.col(c).alias(c + "2") for c in ("node", "label", "n", "bits", "bands")))
    shared = F.array_position(F.zip_with("bands", "bands2", lambda x, y: x == y), True)
    once = (F.col("label") == F.col("major")) | (F.col("node") < F.col("node2"))
    met = rest.join(other.hint("merge"), ["bucket", "part", "chunk"]).where((F.col("label") != F.col("label2")) & once & reach & (shared == F.col("place")))
    return met.select(F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b")).distinct()


def _may_reach(similarity: float) -> Column:
    """Whether sets of `n` and `n2` shingles with the bitmaps `bits` and `bits2` can have this similarity.

    A bitmap has the parities of the shingles in each bit's class, so two differ in no more bits than the sets' shingles
    that are in one of them only. This bounds the common shingles from above: no link is lost.
    """
    apart = sum((F.bit_count(F.col("bits")[i].bitwiseXOR(F.col("bits2")[i])) for i in range(BITS // 64)), F.lit(0))
    return F.col("n") + F.col("n2") - apart >= 2 * (similarity / (1 + similarity) * (F.col("n") + F.col("n2")) - 1e-6)


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float, most: int | None = None) -> DataFrame:
    """The `pairs` whose sets have this Jaccard similarity, written. There are `most` pairs at most. 64 bits of each shingle are compared."""
    a = sets.select(F.col("node").alias("a"), F.col("sh").alias("sa"))
    b = sets.select(F.col("node").alias("b"), F.col("sh").alias("sb"))
    common = F.size(F.array_intersect("sa", "sb"))
    both = pairs.join(a, "a").join(b, "b").withColumn("common", common)
    return materialise(both.where(F.col("common") >= similarity * (F.size("sa") + F.size("sb") - F.col("common")) - 1e-9).select("a", "b"), "near-links", most)


def near_classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """`rid, doc_id, text_md5, class_id, class_size, kept` per row of `docs`.

    Two rows are linked when the weighted Jaccard similarity of their `width`-word shingles is `similarity` or more (a
    shingle weighs as much as it occurs); classes are the connected rows. Candidates are rows that agree in a band of
    their signatures; each link is verified on the whole texts. `class_id` is the least id of the class, null ids last;
    one row of it is `kept`. `rid` numbers the rows.

    Rows with equal shingles are one node, so copies meet no one but their own representative. In a bucket all nodes are
    compared with the least one, its lead, and classes are found once. After that nodes of one class needn't be compared.
    In a bucket with several classes the nodes outside the largest one are compared with all others of it, in groups of
    bounded size; a bitmap of each set, looked at inside the join, leaves only pairs that can be links. Classes are found
    once more with these links.

    Null texts count as empty. Texts without words are alone, each a class of its own. Texts of fewer than `width` words
    are linked when their words are equal. Repeated rows are in one class. Rows of null ids stand behind the others of
    their class and are told apart by their texts. An empty table gives no rows.
    """
    signed, verdicts = _verdicts(docs, id_col, text_col, width, similarity, bands, rows)
    lone = signed.where("same IS NULL").select("rid", "doc_id", "text_md5", F.col("doc_id").alias("class_id"), F.lit(1).cast("bigint").alias("class_size"), F.lit(True).alias("kept"))
    keys = signed.where("same IS NOT NULL").select("rid", "doc_id", "text_md5", "same")
    found = verdicts.select("same", F.struct("class_id", "class_size", "kept").alias("best"), F.col("copies").alias("group_size"))
    common = F.col("group_size") > signed.count() * SUPPORT  # so 1 / SUPPORT sets at most
    found = attach(keys, found.where(common), found.where(~common), "same")
    return found.select("rid", "doc_id", "text_md5", "best.class_id", "best.class_size", (F.col("rid") == F.col("best.kept")).alias("kept")).unionByName(lone)


def near_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """`doc_id, class_id, class_size, kept` per row; see near_classes()."""
    return near_classes(docs, id_col, text_col, **how).select("doc_id", "class_id", "class_size", "kept")


def drop_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """The rows of `docs` that stay, one per class, with the columns of `docs`; see near_classes().

    Texts without words (as near_classes() finds them) all stay, repeated rows of them too. Of other rows with the id and
    text that stay, the one of least row_hash() does.
    """
    signed, verdicts = _verdicts(docs, id_col, text_col, width, similarity, bands, rows)
    md5, k_id, k_md5, rn, lone = (clashless(docs, c) for c in ("text_md5", "k_id", "k_md5", "rn", "lone"))
    kept = verdicts.where("node = kept").select("doc_id", "text_md5", F.lit(False).alias(lone))
    kept = kept.unionByName(signed.where("same IS NULL").select("doc_id", "text_md5", F.lit(True).alias(lone)))
    kept = kept.select(F.col("doc_id").alias(k_id), F.col("text_md5").alias(k_md5), lone).distinct()  # equal texts agree on `lone`
    keyed = docs.withColumn(md5, F.md5(F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")))
    out = keyed.join(kept, F.col(id_col).eqNullSafe(F.col(k_id)) & (F.col(md5) == F.col(k_md5)))
    first = F.row_number().over(Window.partitionBy(id_col, md5).orderBy(row_hash(docs)))
    return out.withColumn(rn, first).where((F.col(rn) == 1) | F.col(lone)).select(columns(docs))
