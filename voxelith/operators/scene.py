"""Scene trees, cameras, presets, clips and records of imported files."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelith.functions.vectors import Vec, clamp, orbit_offset
from voxelith.ordering import with_neighbours

#: Axes of coordinate presets (up vector, camera position) and settings of render presets.
AXES = {"z-up": ((0.0, 0.0, 1.0), (0.0, -3.0, 1.2)), "opengl": ((0.0, 1.0, 0.0), (0.0, 1.2, 3.0)), "opencv": ((0.0, -1.0, 0.0), (0.0, -1.2, 3.0))}
DRAWN = ["mesh", "splat", "sprite", "points", "line"]
SURFACES = ["examples", "playground"]
#: Patterns of clips that are broadcast at most; more are joined by a shuffle.
PATTERNS = 100_000


def descendants(nodes: DataFrame, root: int, node: str = "node_id", parent: str = "parent_id") -> DataFrame:
    """`node_id, depth` of all nodes below `root`, by a recursive query."""
    return nodes.sparkSession.sql(
        f"""WITH RECURSIVE t(node_id, depth) AS (
          SELECT {node}, 1 FROM {{nodes}} WHERE {parent} = {int(root)}
          UNION ALL SELECT n.{node}, t.depth + 1 FROM t JOIN {{nodes}} n ON n.{parent} = t.node_id)
        SELECT node_id, depth FROM t""",
        nodes=nodes,
    )


def is_drawn(kind: Column) -> Column:
    return kind.isin(DRAWN)


def body_nodes(nodes: DataFrame, model: str, name: str) -> DataFrame:
    """The nodes that make a model's body: names with `surface`; if there are none, names without `joint`."""
    low = F.lower(name)
    tier = F.when(F.contains(low, F.lit("surface")), 1).when(~F.contains(low, F.lit("joint")), 2)
    tiered = nodes.withColumn("tier", tier)
    best = tiered.groupBy(F.col(model).alias("of_")).agg(F.min("tier").alias("best"))
    return tiered.join(best, F.col(model).eqNullSafe(F.col("of_")) & (F.col("tier") == F.col("best"))).select(nodes.columns)


def find_clips(clips: DataFrame, wanted: DataFrame) -> DataFrame:
    """`model, action, clip`: for each action the first clip whose name has its best pattern.

    `clips`: `model, ordinal, clip`; `wanted`: `action, rank, pattern`. Names are short: each is dealt to its parts of up
    to the longest pattern's length and joined by equality, so any number of patterns will do. Null names match nothing.

    Each name of a model is taken once, with its first ordinal. A name has many parts, which Spark's estimate doesn't know:
    they must not be broadcast. Patterns are, up to PATTERNS of them; more are joined by a shuffle.
    """
    known = wanted.agg(F.max(F.length("pattern")).alias("longest"), F.count(F.lit(1)).alias("n")).first()
    name = F.lower("clip")
    starts = F.sequence(F.lit(1), F.greatest(F.length(name), F.lit(1)))
    parts = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(known.longest or 0)), lambda n: F.transform(starts, lambda i: F.substring(name, i, n))))
    once = clips.where(F.col("clip").isNotNull()).groupBy("model", "clip").agg(F.min(F.struct("ordinal")).alias("o")).select("model", "o.ordinal", "clip")
    dealt = once.select("model", "ordinal", "clip", F.explode(F.array_distinct(parts)).alias("pattern"))
    first = F.min(F.struct("rank", "ordinal", "clip")).alias("m")
    wanted = F.broadcast(wanted) if known.n <= PATTERNS else wanted.hint("shuffle_hash")
    return dealt.join(wanted, "pattern").groupBy("model", "action").agg(first).select("model", "action", "m.clip")


def with_axes(rows: DataFrame, preset: str) -> DataFrame:
    """`rows` with `up` and `position` of their coordinate preset; those of opencv for names that aren't known."""
    vector = lambda p: F.struct(*(F.lit(v).alias(a) for a, v in zip("xyz", p)))
    pick = lambda k: F.coalesce(*(F.when(F.col(preset) == n, vector(p[k])) for n, p in AXES.items()), vector(AXES["opencv"][k]))
    return rows.withColumn("up", pick(0)).withColumn("position", pick(1))


def aspect(width: Column, height: Column) -> Column:
    """Width by height, 1 if that isn't positive."""
    return F.when((width > 0) & (height > 0), width / F.when(height > 0, height)).otherwise(F.lit(1.0))


def aspect_changes(frames: DataFrame, key: str, order: str) -> DataFrame:
    """Frames whose aspect is over 0.001 off that of the frame before, and first frames."""
    shaped = frames.withColumn("aspect", aspect(F.col("width"), F.col("height")))
    was = F.col("prev.aspect")
    return with_neighbours(shaped, [key], [F.col(order)], ["aspect"]).where(was.isNull() | (F.abs(F.col("aspect") - was) > 0.001)).drop("prev", "next")


def third_person(target: Vec, azimuth: Column, elevation: Column, distance: Column | float) -> Vec:
    return target + orbit_offset(azimuth, elevation, distance)


def pose_json(pose: Column) -> Column:
    return F.to_json(pose)


POSE = "position struct<x:double,y:double,z:double>, rotation struct<x:double,y:double,z:double,order:string>, up struct<x:double,y:double,z:double>, fov double, near double, far double"


def pose_of(text: Column) -> Column:
    """The pose in a JSON text; null if a part is missing."""
    p = F.from_json(text, POSE)
    return F.when(p.position.isNotNull() & p.rotation.isNotNull() & p.fov.isNotNull(), p)


def with_preset(rows: DataFrame, presets: DataFrame, key: str, settings: list[str]) -> DataFrame:
    """`rows` with the settings of their preset where it has one; Spark broadcasts presets if they are small."""
    p = presets.select(F.col(key).alias("_k"), *(F.col(s).alias(f"_{s}") for s in settings))
    out = rows.join(p, F.col(key) == F.col("_k"), "left")
    return out.withColumns({s: F.coalesce(F.col(f"_{s}"), F.col(s)) for s in settings}).drop("_k", *(f"_{s}" for s in settings))


def inside(root: Column, path: Column) -> Column:
    """Whether a path is the root or lies below it."""
    base = F.regexp_replace(root, r"/+$", "")
    return (path == base) | F.startswith(path, F.concat(base, F.lit("/")))


def example_problems(rows: DataFrame) -> DataFrame:
    """`rows` with `problems`, the rules that an example's metadata break.

    `order` from 0; `surfaces` not empty, unique and known; `tags` without empty ones; `accent` like #1a2b3c; the cover a
    root path or absolute URL; a title in each locale.
    """
    cover = F.trim("coverImageUrl")
    rules = {
        "order": F.coalesce(F.col("order") >= 0, F.lit(False)),
        "surfaces": (F.size("surfaces") > 0) & (F.size(F.array_distinct("surfaces")) == F.size("surfaces")) & F.forall("surfaces", lambda s: s.isin(SURFACES)),
        "tags": (F.size("tags") > 0) & F.forall("tags", lambda t: F.length(t) > 0),
        "accent": F.col("accent").rlike("^#[0-9a-fA-F]{6}$"),
        "cover": (cover != "") & (F.startswith(cover, F.lit("/")) | cover.rlike(r"^[A-Za-z][A-Za-z\d+.-]*://\S+$")),
        "title": F.col("title")["en-US"].isNotNull() & F.col("title")["zh-CN"].isNotNull(),
    }
    broken = F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()))
    return rows.withColumn("problems", F.array_compact(broken))


def import_all(sources: DataFrame, load: Callable[[str, bytes], int], name: str = "name", content: str = "content") -> DataFrame:
    """`name, status, items, error`: every source is loaded on its own; one that fails is marked and the others go on."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for n, c in zip(b[name], b[content]):
                try:
                    out.append((n, "ready", load(n, bytes(c)), None))
                except Exception as e:  # noqa: BLE001 - whatever a loader raises belongs to its record
                    out.append((n, "error", None, str(e)))
            yield pd.DataFrame(out, columns=["name", "status", "items", "error"])

    return sources.select(name, content).mapInPandas(run, "name string, status string, items bigint, error string")


def sphere_grid(spark, radius: float, rows: int, cols: int) -> DataFrame:
    """`vertex, x, y, z, u, v` of a sphere's grid."""
    n = spark.range((rows + 1) * (cols + 1))
    v, u = F.expr(f"id div {cols + 1}") / rows, (F.col("id") % (cols + 1)) / cols
    t, p = v * math.pi, u * (2 * math.pi)
    return n.select(F.col("id").alias("vertex"), (-radius * F.cos(p) * F.sin(t)).alias("x"), (radius * F.cos(t)).alias("y"), (radius * F.sin(p) * F.sin(t)).alias("z"), u.alias("u"), (1 - v).alias("v"))


def torus_grid(spark, radius: float, tube: float, rows: int, cols: int) -> DataFrame:
    n = spark.range((rows + 1) * (cols + 1))
    v, u = F.expr(f"id div {cols + 1}") / rows * (2 * math.pi), (F.col("id") % (cols + 1)) / cols * (2 * math.pi)
    ring = radius + tube * F.cos(v)
    return n.select(F.col("id").alias("vertex"), (ring * F.cos(u)).alias("x"), (ring * F.sin(u)).alias("y"), (tube * F.sin(v)).alias("z"))


def pinch(pointers: DataFrame, key: str, order: str) -> DataFrame:
    """`pan_x, pan_y, dolly` of two-finger gestures: the move of the middle, and the change of distance if over 0.001.

    `pointers`: `x0, y0, x1, y1` of both fingers per row.
    """
    got = with_neighbours(pointers, [key], [F.col(order)], ["x0", "y0", "x1", "y1"])
    mid = lambda a, at="": (F.col(f"{at}{a}0") + F.col(f"{at}{a}1")) / 2
    dist = lambda at="": F.hypot(F.col(f"{at}x1") - F.col(f"{at}x0"), F.col(f"{at}y1") - F.col(f"{at}y0"))
    change = dist() - dist("prev.")
    return got.select(key, order, (mid("x") - mid("x", "prev.")).alias("pan_x"), (mid("y") - mid("y", "prev.")).alias("pan_y"), F.when(F.abs(change) > 0.001, change).otherwise(F.when(change.isNotNull(), F.lit(0.0))).alias("dolly"))


def key_move(axis: Vec, speed: Column, dt: Column) -> Vec:
    """The move of held keys: no faster along diagonals."""
    n = F.greatest(F.lit(1.0), axis.length())
    return axis * (speed * dt / n)


def pitch(now: Column, delta: Column) -> Column:
    """A pitch after a turn, held just short of straight up and down."""
    end = math.pi / 2 - 0.001
    return clamp(now + delta, -end, end)
