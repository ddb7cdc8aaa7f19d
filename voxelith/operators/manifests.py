"""Level-of-detail manifests: validation, chunk tables, merging, packing, and scheduling under a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelith.ordering import in_groups

#: Fixed values of the manifest format.
MAGIC, KIND = 2500660, "lod-splat"
SCHEMA = (
    "magicCode bigint, type string, version string, counts bigint, shDegree int, levels int, files array<string>, "
    "forwardBox struct<min:array<double>,max:array<double>>, permanentFiles array<int>, "
    "tree array<struct<bound:struct<min:array<double>,max:array<double>>,lods:array<struct<file:int,offset:bigint,count:bigint>>>>"
)


def read_manifest(json: Column) -> Column:
    """The manifest as a struct; null if the text isn't JSON of that shape."""
    return F.from_json(json, SCHEMA)


def is_manifest(m: str, raw: Column | None = None, strict: int = 2) -> Column:
    """Whether the struct column `m` is a manifest. strict 0: magic number and type. 1: also numeric counts and levels
    and a list of files. 2: also at least one level and, seen in the JSON text `raw`, only strings as files."""
    f = lambda c: F.col(f"{m}.{c}")
    ok = (f("magicCode") == MAGIC) & (f("type") == KIND)
    if strict >= 1:
        ok = ok & f("counts").isNotNull() & f("levels").isNotNull() & f("files").isNotNull()
    if strict >= 2:
        ok = ok & (f("levels") > 0) & ~F.exists(f("files"), lambda x: x.isNull())
        if raw is not None:
            listed = F.regexp_extract(raw, r'(?s)"files"\s*:\s*\[(.*?)\]', 1)
            ok = ok & listed.rlike(r'(?s)^\s*("(\\.|[^"\\])*"\s*(,\s*"(\\.|[^"\\])*"\s*)*)?$')
    return F.coalesce(ok, F.lit(False))


def chunks(manifests: DataFrame, m: str = "m", key: str = "manifest_id") -> DataFrame:
    """`key, chunk_id, level, file, offset, count`: a row per chunk and level."""
    tree = manifests.select(key, F.posexplode(f"{m}.tree").alias("chunk_id", "node"))
    lods = tree.select(key, "chunk_id", F.posexplode("node.lods").alias("level", "lod"))
    return lods.select(key, "chunk_id", "level", "lod.file", "lod.offset", "lod.count")


def with_offsets(pieces: DataFrame, file: list[str], order: list[str], count: str = "count") -> DataFrame:
    """`pieces` with `offset`: the rows before each in its file."""
    got = in_groups(pieces, file, [F.col(c) for c in order], size=count, name="offsets")
    return got.withColumn("offset", F.col("before").cast("bigint")).drop("place", "before")


def merge(parts: DataFrame, files: DataFrame, key: str = "manifest_id") -> DataFrame:
    """`parts` (chunk rows of several manifests) with files renumbered for one list that has all manifests' files.

    `files`: `key, n_files`. Manifests follow each other in order of their key; there is one small row for each.
    """
    w = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    base = files.select(F.col(key).alias("k"), F.coalesce(F.sum("n_files").over(w), F.lit(0)).cast("bigint").alias("base"))
    return parts.join(base, parts[key] == base.k).withColumn("file", F.col("file") + F.col("base")).drop("k", "base")


def chunk_format(count: Column, wanted: Column | str, threshold: int = 0) -> Column:
    """The file format of a chunk: small ones are always spz."""
    return F.when(count < threshold, F.lit("spz")).otherwise(F.lit(wanted) if isinstance(wanted, str) else wanted)


def pack_low_levels(pieces: DataFrame, first_shared: int) -> DataFrame:
    """`pieces` (`chunk_id, level, count`) with `file_key`: levels from `first_shared` on share one file each."""
    own = F.concat_ws("/", F.col("level").cast("string"), F.col("chunk_id").cast("string"))
    return pieces.withColumn("file_key", F.when(F.col("level") >= first_shared, F.concat(F.lit("shared/"), F.col("level").cast("string"))).otherwise(own))


def score(chunk: dict[str, Column], camera: tuple[float, float, float], forward: tuple[float, float, float], penalty: dict[str, float] | None = None) -> Column:
    """Importance of a chunk for a camera: 1 / (1 + distance), times a penalty behind it or outside its view.

    Behind: the direction's cosine is under `tolerance`, unless nearer than `near`. Our own rule: the contract names only
    the penalties and tolerances, which are parameters.
    """
    p = {"behind": 0.1, "outside": 0.4, "tolerance": -0.2, "near": 2.0, "view": 0.5} | (penalty or {})
    d = [chunk[a] - o for a, o in zip("xyz", camera)]
    dist = F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])
    cos = (d[0] * forward[0] + d[1] * forward[1] + d[2] * forward[2]) / F.when(dist > 0, dist)
    factor = F.when((cos < p["tolerance"]) & (dist > p["near"]), F.lit(p["behind"])).when(cos < p["view"], F.lit(p["outside"])).otherwise(F.lit(1.0))
    return F.coalesce(factor, F.lit(1.0)) / (1 + dist)


def within_budget(lods: DataFrame, budget: int, score_col: str = "score") -> DataFrame:
    """`scene, chunk_id, level, count`: for each chunk the finest level that the budget of its scene still allows.

    `lods`: `scene, chunk_id, level, count, score`. Every chunk has its coarsest level; upgrades, finer levels by their
    extra rows, are taken in order of level from coarse to fine and of score until the budget is reached.
    """
    one = Window.partitionBy("scene", "chunk_id").orderBy(F.desc("level"))  # as many rows as levels
    steps = lods.withColumn("extra", F.col("count") - F.coalesce(F.lag("count").over(one), F.lit(0)))
    steps = steps.withColumn("coarse", F.lag("level").over(one).isNull())
    order = [F.desc("level"), F.desc(score_col), F.col("chunk_id")]
    taken = in_groups(steps, ["scene"], order, size="extra", name="upgrades", unique=True).withColumn("spent", F.col("before") + F.col("extra"))
    taken = taken.where((F.col("spent") <= budget) | F.col("coarse"))
    return taken.groupBy("scene", "chunk_id").agg(F.min(F.struct("level", "count")).alias("m")).select("scene", "chunk_id", "m.level", "m.count")


def bootstrap_level(levels: Column, capped: bool = False, min_level: int = 0) -> Column:
    """The level that is loaded first: the coarsest; with `capped`, at most 4 or `min_level`."""
    coarse = F.greatest(F.lit(0), levels - 1)
    return F.least(coarse, F.lit(max(4, min_level))) if capped else coarse
