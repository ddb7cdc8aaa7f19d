"""Exact Jaccard self-join of word n-grams in size-banded tiles: bitmaps bound the overlap, sorted arrays give it.

All pairs of similar sizes would be too many to look at, so a size band is cut into small tiles without losing a link.
Within a band shingles are dealt to segments by their hashes. Sets that are similar enough differ in a bounded number of
shingles, so in no more segments than that; of the first so many segments and one more, one is equal. A tile has the sets
of a band that agree in a segment.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelith.graphs import forest, with_roots
from voxelith.llm.dart_minhash import U, mix
from voxelith.llm.heavy import SUPPORT, attach, bounded
from voxelith.llm.texts import with_columns
from voxelith.storage import discard, materialise

#: Words of a shingle, and the least similarity of linked sets in percent.
WIDTH, PERCENT = 4, 85
#: Bits of a signature.
BITS = 1024
#: Sets that meet one set, or as many others, in one group.
PART_ROWS = 500
#: Numbers of nodes that are broadcast at most; more are joined by a shuffle.
NODES = 1_000_000
#: A segment of fewer shingles says little; it only counts in sets that have too few others.
THIN = 2


class _Words(dict):
    """Hashes of words, forgotten when there are many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_words = _Words()


def shingle_set(text: str, width: int) -> np.ndarray:
    """Sorted hashes of the text's runs of `width` words; of all words if they are fewer. ASCII white space separates words, A-Z are lower-cased."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    h = np.fromiter(map(_words.__getitem__, words), U, len(words))
    n = max(1, len(h) - width + 1) if len(h) else 0
    acc = np.full(n, min(len(h), width), U)
    for j in range(min(width, len(h))):
        acc = mix(acc * U(3) + h[j : j + n] + U(j + 1))
    return np.unique(acc)


def most_apart(n: int, m: int, percent: int) -> int:
    """How many shingles are at most in one of two linked sets of `n` and `m`."""
    return (n + m) * (100 - percent) // (100 + percent)


class Bands:
    """Bands of sizes, each from its `low` to its `high`, such that a linked pair is in one band or in adjacent ones."""

    def __init__(self, percent: int):
        self.percent = percent
        self.ratio = (100 / percent) ** 2

    def of(self, n: int) -> int:
        b = int(log(n) / log(self.ratio))
        while self.low(b) > n:
            b -= 1
        while self.low(b + 1) <= n:
            b += 1
        return b

    def low(self, b: int) -> int:
        return ceil(self.ratio**b)

    def segments(self, b: int) -> int:
        """One more than linked sets can differ in within the band, and some for segments that are thin."""
        high = self.low(b + 1) - 1
        return most_apart(high, high * 100 // self.percent, self.percent) * 27 // 25 + 2

    def homes(self, n: int) -> list[int]:
        """The band of a set of `n` shingles, and the next one if sets in it can be linked with it."""
        b = self.of(n)
        return [b] + [b + 1] * (self.low(b + 1) * self.percent <= n * 100)


def tile_keys(s: np.ndarray, bands: Bands) -> np.ndarray:
    """The tiles of a set: in each of its bands the first segments that aren't thin, one more than it can differ in.

    If x and y are linked, they differ in d shingles, so in d segments at most. Each has one more than that among its first
    segments that aren't thin; up to where the first of them has so many, one is equal, and thin in neither. A set with
    fewer such segments takes all of them, thin and empty ones too.
    """
    n = len(s)
    need = most_apart(n, n * 100 // bands.percent, bands.percent) + 1 if n else 0
    if need < 2:  # linked with equal sets only
        return np.empty(0, U)
    out = []
    for b in bands.homes(n):
        m = bands.segments(b)
        at = (s % U(m)).astype(np.int64)
        total = np.zeros(m, U)
        np.add.at(total, at, mix(s + U(1)))
        full = np.flatnonzero(np.bincount(at, minlength=m) >= THIN)[:need]
        chosen = full if len(full) == need else np.arange(m)
        out.append(mix(total[chosen] ^ mix(chosen.astype(U) + (U(b) << U(40)))))
    return np.concatenate(out)


def bitmap(s: np.ndarray) -> np.ndarray:
    """For each of BITS classes of hashes the parity of the shingles in it."""
    odd = np.bincount(((s >> U(20)) & U(BITS - 1)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _signed(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """`doc_id, text_md5, same, n, bits, tiles` from `doc_id, text_md5, text`; `same` is equal for equal sets and null for empty ones."""
    bands = Bands(percent)

    def work(texts: list[str]) -> list[list]:
        sets = [shingle_set(t, width) for t in texts]
        same = [xxhash.xxh3_128_hexdigest(s.tobytes()) if len(s) else None for s in sets]
        return [same, [len(s) for s in sets], [bitmap(s) for s in sets], [tile_keys(s, bands).view(np.int64) for s in sets]]

    new = [("same", "string", pa.string()), ("n", "bigint", pa.int64()), ("bits", "array<bigint>", pa.list_(pa.int64())), ("tiles", "array<bigint>", pa.list_(pa.int64()))]
    return with_columns(docs, F.col("text"), lambda: work, new, ["doc_id", "text_md5"])


def may_link(percent: int) -> Column:
    """Whether sets of `n` and `n2` shingles with the bitmaps `bits` and `bits2` can be linked.

    Bitmaps differ in no more bits than the sets in shingles, which bounds the overlap from above.
    """
    apart = sum((F.bit_count(F.col("bits")[i].bitwiseXOR(F.col("bits2")[i])) for i in range(BITS // 64)), F.lit(0))
    sizes = F.least("n", "n2") * 100 >= F.greatest("n", "n2") * percent
    return sizes & ((F.col("n") + F.col("n2") - apart) * (100 + percent) >= (F.col("n") + F.col("n2")) * (2 * percent))


def _reaching(pairs: DataFrame, sketches: DataFrame, percent: int, name: str) -> DataFrame:
    """Those of `pairs` (`a, b`) that their bitmaps let be linked, written."""
    a = sketches.select(F.col("node").alias("a"), "n", "bits")
    b = sketches.select(F.col("node").alias("b"), F.col("n").alias("n2"), F.col("bits").alias("bits2"))
    return materialise(pairs.join(a, "a").join(b, "b").where(may_link(percent)).select("a", "b"), name)


def _compared(percent: int):
    """Links `a, b` from rows `a, part, side, node, sh` in that order: the set of side 0 is compared with those behind it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, lead = None, None
        for batch in batches:
            a, part, side, node = (batch.column(i).to_numpy() for i in range(4))
            flat, ends = batch.column(4).flatten().to_numpy(), np.r_[0, np.cumsum(batch.column(4).value_lengths().to_numpy())]
            keep = np.zeros(len(batch), bool)
            for k in range(len(batch)):
                s = flat[ends[k] : ends[k + 1]]
                if side[k] == 0:
                    tile, lead = (a[k], part[k]), s
                elif tile == (a[k], part[k]):
                    common = len(np.intersect1d(lead, s, assume_unique=True))
                    keep[k] = 100 * common >= percent * (len(lead) + len(s) - common)
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(node[keep])], names=["a", "b"])

    return run


def _linked(pairs: DataFrame, given: DataFrame, nodes: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of `pairs`, a written table, whose sets are linked, written.

    The sets that meet one set `a` are dealt to parts of about PART_ROWS, and `a` goes to each, so no set has to be in one
    place with all its partners. Sets are made from the texts when they are needed, and kept nowhere.
    """
    parts = materialise(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PART_ROWS).cast("int").alias("parts")), "ngram-parts")
    leads = parts.select(F.col("a").alias("node"), "a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("side"))
    others = pairs.join(bounded(parts), "a").select(F.col("b").alias("node"), "a", F.pmod(F.hash("b"), F.col("parts")).alias("part"), F.lit(1).alias("side"))
    wanted = leads.unionByName(others).join(nodes.select("node", F.col("doc_id").alias("w_id"), F.col("text_md5").alias("w_md5")), "node")
    wanted = materialise(wanted, "ngram-wanted")
    met = given.join(bounded(wanted), given.text_md5.eqNullSafe(F.col("w_md5")) & given.doc_id.eqNullSafe(F.col("w_id")))
    work = lambda texts: [[np.sort(shingle_set(t, width).view(np.int64)) for t in texts]]
    rows = with_columns(met, F.col("text"), lambda: work, [("sh", "array<bigint>", pa.list_(pa.int64()))], ["a", "part", "side", "node"])
    rows = rows.repartition("a", "part").sortWithinPartitions("a", "part", "side")
    out = materialise(rows.mapInArrow(_compared(percent), "a bigint, b bigint"), "ngram-links")
    discard(parts, wanted)
    return out


def _mixed_pairs(tiles: DataFrame, below: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """`a, b`: pairs of different classes in one tile, neither its lead, that their bitmaps let be linked.

    Sets outside the class of most of a tile's sets meet all others of it, dealt to groups of about PART_ROWS.
    """
    classed = tiles.join(below, "node", "left").select("tile", "node", "lead", F.coalesce("label", "node").alias("label"))
    classed = materialise(classed, "ngram-classed")
    each = classed.groupBy("tile", "label").agg(F.count(F.lit(1)).alias("c"))
    each = each.groupBy("tile").agg(F.sum("c").alias("m"), F.max(F.struct("c", "label")).alias("top"), F.count(F.lit(1)).alias("classes")).where("classes > 1 AND m > 2")
    groups = lambda n: F.ceil(n / PART_ROWS).cast("int")
    mixed = materialise(each.select("tile", F.col("top.label").alias("major"), groups(F.col("m")).alias("parts"), groups(F.col("m") - F.col("top.c")).alias("chunks")), "ngram-mixed")
    slots = materialise(classed.where("node <> lead").join(mixed, "tile").join(sketches, "node"), "ngram-slots")
    one = slots.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumn("part", F.pmod(F.hash("node"), F.col("parts")))
    other = slots.where("label <> major").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("chunk", F.pmod(F.hash("node"), F.col("chunks")))
    other = other.select("tile", "part", "chunk", *(F.col(c).alias(c + "2") for c in ("node", "label", "n", "bits")))
    once = (F.col("label") == F.col("major")) | (F.col("node") < F.col("node2"))
    met = one.join(other.hint("merge"), ["tile", "part", "chunk"]).where((F.col("label") != F.col("label2")) & once & may_link(percent))
    out = materialise(met.select(F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b")).distinct(), "ngram-mixed-pairs")
    discard(classed, mixed, slots)
    return out


def _joined(below: DataFrame, pairs: DataFrame, given: DataFrame, nodes: DataFrame, width: int, percent: int, n: int) -> DataFrame:
    """The classes `below` with those of `pairs` that are linked."""
    if pairs.isEmpty():
        return below
    stars = below.select(F.col("node").alias("a"), F.col("label").alias("b"))
    return forest(stars.unionByName(_linked(pairs, given, nodes, width, percent)), "ngram-forest", n)


def join_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """`doc_id, n_shingles, component_id` per row of `docs`.

    A text's set has its distinct runs of `width` words, or all its words as one run if they are fewer. Two rows are linked
    when 100 times their sets' intersection is at least `percent` (51 to 99) times the union. `component_id` is the least
    id that links lead to, the row's own included.

    Rows of equal sets are one node. Nodes are first compared with the least node of the tiles where they meet it most
    often, then with the least nodes of their other tiles that are of other classes, then with all nodes of other classes
    in tiles that still have several. Classes are found after each step, since nodes of one class needn't be compared. So
    all links that join classes are found; links within a class aren't all listed.

    Null and empty texts and those without words have no shingles and are linked with nothing. Null ids lose to others; a
    component of null ids only has none. Repeated rows are linked with each other. Texts of any length are read whole.
    Other columns play no part. An empty table gives no rows. 64 bits of each shingle are compared.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    given = docs.select(F.col(id_col).alias("doc_id"), F.md5(F.encode(text, "UTF-8")).alias("text_md5"), text.alias("text"))
    signed = materialise(_signed(given, width, percent).withColumn("rid", F.monotonically_increasing_id()), "ngram-signed")
    n = signed.count()  # bounds the rows of what follows

    # A node is the row of least id (null ids last) among those of equal sets. Partial minima are taken before the shuffle.
    best = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_md5", "rid")).alias("best")
    nodes = signed.where("same IS NOT NULL").groupBy("same").agg(best, F.count(F.lit(1)).alias("copies"))
    nodes = materialise(nodes.select("same", "copies", F.col("best.rid").alias("node"), "best.doc_id", "best.text_md5"), "ngram-nodes", n)
    own = signed.select(F.col("rid").alias("node"), "n", "bits", "tiles").join(bounded(nodes.select("node"), NODES), "node", "left_semi")
    sketches = own.select("node", "n", "bits")

    # Both sides of the join are written tables, so that Spark can split a tile that very many nodes are in.
    slots = own.select(F.explode("tiles").alias("tile"), "node")
    leads = slots.groupBy("tile").agg(F.min("node").alias("lead"), F.max("node").alias("last")).where("lead < last")
    leads = materialise(leads.drop("last"), "ngram-leads")
    tiles = materialise(slots.join(leads, "tile"), "ngram-tiles")
    votes = materialise(tiles.where("node <> lead").groupBy("node", "lead").agg(F.count(F.lit(1)).alias("c")), "ngram-votes")

    first = votes.groupBy(F.col("node").alias("b")).agg(F.max_by("lead", F.struct("c", -F.col("lead"))).alias("a"))
    first = _reaching(first, sketches, percent, "ngram-first")
    links = _linked(first, given, nodes, width, percent)
    below = forest(links, "ngram-forest", n)

    label = lambda side: below.select(F.col("node").alias(side), F.col("label").alias(f"{side}_label"))
    rest = votes.join(label("node"), "node", "left").join(label("lead"), "lead", "left")
    rest = rest.where(F.coalesce("node_label", "node") != F.coalesce("lead_label", "lead")).select(F.col("lead").alias("a"), F.col("node").alias("b"))
    rest = _reaching(rest, sketches, percent, "ngram-rest")
    below = _joined(below, rest, given, nodes, width, percent, n)
    mixed = _mixed_pairs(tiles, below, sketches, percent)
    below = _joined(below, mixed, given, nodes, width, percent, n)
    discard(leads, tiles, votes, first, links, rest, mixed)

    named = nodes.select("same", "copies", "node", "doc_id").join(with_roots(below), "node", "left")
    named = materialise(named, "ngram-named", n)
    several = named.where("label IS NOT NULL")
    total = several.groupBy("label").agg(F.min("doc_id").alias("best"), F.count(F.lit(1)).alias("group_size"))
    total = materialise(total, "ngram-totals", n)
    common = F.col("group_size") > several.count() * SUPPORT  # so 1 / SUPPORT labels at most
    found = attach(several, total.where(common), total.where(~common), "label").select("same", "best", F.col("copies").alias("group_size"))
    found = found.unionByName(named.where("label IS NULL").select("same", F.col("doc_id").alias("best"), F.col("copies").alias("group_size")))
    found = materialise(found, "ngram-verdicts", n)
    common = F.col("group_size") > n * SUPPORT  # so 1 / SUPPORT sets at most
    keyed = signed.where("same IS NOT NULL").select("doc_id", "n", "same")
    out = attach(keyed, found.where(common), found.where(~common), "same").select("doc_id", F.col("n").alias("n_shingles"), F.col("best").alias("component_id"))
    none = signed.where("same IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return out.unionByName(none)
