"""Chunked levels of detail: a cloud is split into octree chunks, and each chunk's levels are made by merging Gaussians."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelith.operators.clouds import LEVELS, XYZ, merge_gaussians, morton, octree_chunks
from voxelith.ordering import in_order
from voxelith.storage import materialise

#: Levels of the finest cells, and of the cells that chunks are made of.
FINEST, CELLS = 20, 12
#: Merged Gaussians below this opacity are dropped. 1 / 255 drops those that 8-bit colours don't show, at a loss of opacity
#: with each level; by default all stay.
FAINT = 0.0
BODY = [*XYZ, "sx", "sy", "sz", "qx", "qy", "qz", "qw", "r", "g", "b", "a"]


def _codes(splats: DataFrame) -> DataFrame:
    """`splats` with `code`, the Morton code of the finest cell of a cube around the cloud; rows without a finite place go."""
    placed = splats.where(" AND ".join(f"abs({c}) < double('infinity')" for c in XYZ))
    box = placed.agg(*(F.min(c).alias(f"{c}0") for c in XYZ), *(F.max(c).alias(f"{c}1") for c in XYZ)).first()
    low = [box[f"{c}0"] or 0.0 for c in XYZ]
    side = max((box[f"{c}1"] or 0.0) - v for c, v in zip(XYZ, low)) or 1.0
    cell = lambda c, v: F.least(F.floor((F.col(c) - v) / side * 2**FINEST), F.lit(2**FINEST - 1)).cast("bigint")
    return placed.withColumn("code", morton(*(cell(c, v) for c, v in zip(XYZ, low))))


def assign(coded: DataFrame, limit: int, cells: int = CELLS) -> tuple[DataFrame, DataFrame]:
    """(`coded` with `chunk_id`, the chunks as `chunk_id, n`); `coded` has `code`, a chunk has at most `limit` rows.

    Chunks are numbered in Morton order. Chunks are looked up by occupied cells of the level `cells`, each of which meets
    its ancestors by equality. Cells of that level with more rows are split further, by the codes of their rows alone.
    Only a finest cell is not split, so a chunk that is one may have more rows.
    """
    rows = coded.withColumn("cell", F.shiftright("code", 3 * (FINEST - cells)))
    nodes = materialise(octree_chunks(rows.select("cell"), limit, cells, "cell"), "chunk-nodes")
    crowded = nodes.where((F.col("level") == cells) & (F.col("n") > limit)).select(F.col("prefix").alias("cell"))
    within = materialise(rows.join(crowded, "cell", "left_semi").select("code"), "chunk-crowded")
    deeper = octree_chunks(within, limit, FINEST, "code").where(F.col("level") > cells)
    nodes = nodes.where((F.col("level") < cells) | (F.col("n") <= limit) | (cells == FINEST)).unionByName(deeper)
    first = F.call_function("shiftleft", F.col("prefix"), 3 * (F.lit(FINEST) - F.col("level")))
    numbered, _, _ = in_order(nodes.withColumn("first", first), [F.col("first")], name="chunks", unique=True)
    chunks = numbered.select(F.col("pos").alias("chunk_id"), "level", "prefix", "n")

    def looked_up(places: DataFrame, key: str, levels: range) -> DataFrame:
        up = places.distinct().select(key, F.explode(F.array(*map(F.lit, levels))).alias("level"))
        up = up.withColumn("prefix", F.call_function("shiftright", F.col(key), 3 * (F.lit(levels[-1]) - F.col("level"))))
        return materialise(up.join(chunks, ["level", "prefix"]).select(key, "chunk_id"), "chunk-cells")

    out = rows.join(looked_up(rows.select("cell"), "cell", range(cells + 1)), "cell").drop("cell")
    if not within.isEmpty():
        out = out.unionByName(rows.join(looked_up(within, "code", range(cells + 1, FINEST + 1)), "code").select(out.columns))
    return out, chunks.select("chunk_id", "n")


def prefix_bits(chunked: DataFrame, chunks: DataFrame, shares: list[float]) -> DataFrame:
    """`chunk_id, bits`: for each share the longest code prefix by which a chunk falls into at most that share of its rows
    (one group at least).

    Two neighbours in the order of a chunk's distinct codes are apart from the first bit that differs, so a prefix of k
    bits makes one group more than there are neighbours with such a bit among the first k. A chunk has at most its limit
    of codes, or one.
    """
    top = 3 * FINEST
    w = Window.partitionBy("chunk_id").orderBy("code")
    codes = chunked.select("chunk_id", "code").distinct()
    apart = codes.withColumn("differs", top + 1 - F.length(F.bin(F.col("code").bitwiseXOR(F.lag("code").over(w)))))
    found = apart.groupBy("chunk_id").agg(*(F.count_if(F.col("differs") <= k).alias(f"k{k}") for k in range(top + 1)))
    groups = F.array(*(F.col(f"k{k}") + 1 for k in range(top + 1)))
    sizes = found.select("chunk_id", groups.alias("groups")).join(chunks, "chunk_id")

    def longest(share: float) -> Column:
        target = F.greatest(F.floor(F.col("n") * share), F.lit(1))
        return F.size(F.filter("groups", lambda g: g <= target)) - 1

    return sizes.select("chunk_id", F.array(*(longest(s) for s in shares)).alias("bits"))


def build(splats: DataFrame, limit: int = 400_000, levels: list[tuple[float, float]] | None = None, faint: float = FAINT, cells: int = CELLS) -> DataFrame:
    """The cloud's chunks in levels of detail: `chunk_id, level`, the columns of Gaussians, and the cloud's own others.

    `levels` are (precision, scale boost): the most that a level keeps of a chunk's Gaussians, and the factor of its
    extents. A level of precision 1 is the cloud; the others are merged from the level before, cell by cell, where cells
    are halved along one axis after another. So a level keeps between about half of its target and all of it, and one
    Gaussian at least unless `faint` drops it. Columns that merging doesn't know are null. Rows whose place is null or not
    finite are in no chunk; an empty cloud has no chunks.
    """
    levels = LEVELS if levels is None else levels
    coded, chunks = assign(_codes(splats), limit, cells)
    level = coded = materialise(coded, "chunked")
    bits = materialise(prefix_bits(coded, chunks, [p for p, _ in levels]), "chunk-bits")
    out = None
    for i, (precision, boost) in enumerate(levels):
        if precision < 1:
            cut = F.lit(3 * FINEST) - F.col("bits")[i]
            keyed = level.join(bits, "chunk_id").withColumn("cut", cut).withColumn("part", F.call_function("shiftright", F.col("code"), F.col("cut")))
            merged = merge_gaussians(keyed, ["chunk_id", "cut", "part"]).where(F.col("a") >= faint)
            code = F.call_function("shiftleft", F.col("part"), F.col("cut"))
            level = materialise(merged.withColumn("code", code).select("chunk_id", "code", *BODY), "lod-level")
        rows = level.drop("code").withColumns({f"s{c}": F.col(f"s{c}") * boost for c in XYZ} | {"level": F.lit(i)})
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    if out is None:
        raise ValueError("no levels")
    return out.select("chunk_id", "level", *(c for c in out.columns if c not in ("chunk_id", "level")))
