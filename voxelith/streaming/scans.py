"""Prefix compositions of rows within groups, for any associative way to compose them, as column expressions.

A smoothed value is a composition of affine maps, an orientation a product of quaternions. Composition needn't commute, so
this is not a windowed sum; but it is associative, so runs of rows can be composed by themselves and then with each other.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelith.ordering import in_groups, with_neighbours
from voxelith.storage import clashless, columns, materialise

Compose = Callable[[Column, Column], Column]
#: Rows that are composed one after another in one array, and totals of such runs that are composed in one array at last.
RUN, LAST = 64, 4096


def _folded(rows: DataFrame, by: Column, compose: Compose) -> DataFrame:
    """`run, outs`: for each run of `rows` (`pos, start, value, row`) the compositions from its first row on, in order.

    `start` forgets what was before. A struct of `outs` has `start` if there was one up to it.
    """

    def step(acc: Column, r: Column) -> Column:
        fresh = r["start"] | (F.size(acc["outs"]) == 0)
        value = F.when(fresh, r["value"]).otherwise(compose(acc["value"], r["value"]))
        start = acc["start"] | r["start"]
        # The row is put in last, so that the next step reads its value from the struct and doesn't compute it again.
        return F.struct(start.alias("start"), value.alias("value"), F.array_append(acc["outs"], F.struct(r["pos"].alias("pos"), start.alias("start"), value.alias("value"), r["row"].alias("row"))).alias("outs"))

    runs = rows.groupBy(by.alias("run")).agg(F.array_sort(F.collect_list(F.struct("pos", "start", "value", "row"))).alias("rows_"))
    kind = rows.select(F.array(F.struct("pos", "start", "value", "row")).alias("a")).schema["a"].dataType.simpleString()
    value = rows.schema["value"].dataType.simpleString()
    empty = F.struct(F.lit(False).alias("start"), F.lit(None).cast(value).alias("value"), F.array().cast(kind).alias("outs"))
    return runs.select("run", F.aggregate("rows_", empty, step, lambda acc: acc["outs"]).alias("outs"))


def _before(totals: DataFrame, compose: Compose) -> DataFrame:
    """`run, carry`: for each of `totals` (`pos, start, value`) the composition of those ahead of it, null for the first."""
    rows = totals.withColumn("row", F.lit(0))
    if totals.count() <= LAST:
        outs = _folded(rows, F.lit(0), compose).select(F.explode("outs").alias("o")).select("o.*")
        return outs.select((F.col("pos") + 1).alias("run"), F.col("value").alias("carry"))
    each = materialise(_folded(rows, F.expr(f"pos div {RUN}"), compose), "scan-totals")
    last = F.element_at("outs", -1)
    ahead = _before(each.select(F.col("run").alias("pos"), last["start"].alias("start"), last["value"].alias("value")), compose)
    outs = each.select("run", F.explode("outs").alias("o")).join(ahead, "run", "left")
    whole = F.when(F.col("o.start") | F.col("carry").isNull(), F.col("o.value")).otherwise(compose(F.col("carry"), F.col("o.value")))
    return outs.select((F.col("o.pos") + 1).alias("run"), whole.alias("carry"))


def prefixes(rows: DataFrame, by: list[str], order: list[Column], element: Column, compose: Compose, out: str, name: str = "scan") -> DataFrame:
    """`rows` with `out`: the composition of `element` from the group's first row to this one, compose(earlier, later).

    `element` is a struct and `compose` gives a struct of the same type; it is associative. The order is total within a
    group. Null keys are groups too. Rows are put in one global order of all groups and composed in runs of RUN; the runs'
    totals are composed in the same way, level by level. So a group that holds most rows is many tasks' work, in rounds
    that are as few as the logarithm of the rows. A run's array is copied as it grows, which bounds RUN.
    """
    el = clashless(rows, "element_")
    given = in_groups(rows.withColumn(el, element), by, order, name=name, unique=True, pos=True)
    flat = given.select(F.col("pos").alias("pos"), (F.col("place") == 0).alias("start"), F.col(el).alias("value"), F.struct(columns(rows)).alias("row"))
    each = materialise(_folded(flat, F.expr(f"pos div {RUN}"), compose), f"{name}-runs")
    last = F.element_at("outs", -1)
    ahead = materialise(_before(each.select(F.col("run").alias("pos"), last["start"].alias("start"), last["value"].alias("value")), compose), f"{name}-carries")
    found = each.join(ahead, "run", "left").select("carry", F.explode("outs").alias("o"))
    whole = F.when(F.col("o.start") | F.col("carry").isNull(), F.col("o.value")).otherwise(compose(F.col("carry"), F.col("o.value")))
    return found.select(whole.alias(out), "o.row").select("row.*", out)


def affine(rows: DataFrame, by: list[str], order: list[Column], gain: Column, shift: Column, out: str) -> DataFrame:
    """`rows` with `out`: x = gain * (x of the row before) + shift; before the group's first row x is 0. A gain of 0 resets x.

    A null gain or shift makes x null until the next row with gain 0.
    """
    maps = F.struct(gain.cast("double").alias("a"), shift.cast("double").alias("b"))

    def compose(f: Column, g: Column) -> Column:
        reset = g["a"] == 0
        return F.struct(F.when(reset, F.lit(0.0)).otherwise(g["a"] * f["a"]).alias("a"), F.when(reset, g["b"]).otherwise(g["a"] * f["b"] + g["b"]).alias("b"))

    name = clashless(rows, "map_")
    return prefixes(rows, by, order, maps, compose, name).withColumn(out, F.col(f"{name}.b")).drop(name)


def follow(rows: DataFrame, by: list[str], order: list[Column], target: Column, dt: Column, rate: float, out: str) -> DataFrame:
    """`rows` with `out`, which follows `target` exponentially at one `rate`; `dt` is the time since the row before.

    The group's first target is taken at once. A null target gives null, and the next target is taken at once.
    """
    gone, t, d = (clashless(rows, c) for c in ("gone_", "target_", "dt_"))
    timed = with_last_target(rows.withColumns({t: target, d: dt}), by, order, t, gone)
    keep = F.when(F.col(gone), F.lit(0.0)).otherwise(F.exp(-F.greatest(F.lit(0.0), F.col(d)) * rate))
    got = affine(timed, by, order, keep, F.col(t) * (1 - keep), out)
    return got.withColumn(out, F.when(F.col(t).isNotNull(), F.col(out))).drop(gone, t, d)


def with_last_target(rows: DataFrame, by: list[str], order: list[Column], target: str, out: str) -> DataFrame:
    """`rows` with `out`: whether the row has no target before it, in the row just ahead."""
    got = with_neighbours(rows, by, order, [target], name="targets")
    return got.withColumn(out, F.col(f"prev.{target}").isNull() | F.col(target).isNull()).select(*columns(rows), out)


QUATERNION = ["qx", "qy", "qz", "qw"]


def orientations(turns: DataFrame, by: list[str], order: list[Column], out: str = "q") -> DataFrame:
    """`turns` (`qx, qy, qz, qw`: each a turn in the frame that the turns before it left) with `out`, the orientation.

    An orientation is the product of the turns so far, earlier ones on the left. Products of unit quaternions stay so up to
    rounding; a turn of length 0 is no turn.
    """
    size = F.sqrt(sum((F.col(c) * F.col(c) for c in QUATERNION), F.lit(0.0)))
    one = F.struct(*(F.when(size > 0, F.col(c) / F.when(size > 0, size)).otherwise(F.lit(1.0 if c == "qw" else 0.0)).alias(c[1]) for c in QUATERNION))
    return prefixes(turns, by, order, one, hamilton, out)


def hamilton(p: Column, q: Column) -> Column:
    """The product of two quaternions, structs of x, y, z and w."""
    return F.struct(
        (p["w"] * q["x"] + p["x"] * q["w"] + p["y"] * q["z"] - p["z"] * q["y"]).alias("x"),
        (p["w"] * q["y"] - p["x"] * q["z"] + p["y"] * q["w"] + p["z"] * q["x"]).alias("y"),
        (p["w"] * q["z"] + p["x"] * q["y"] - p["y"] * q["x"] + p["z"] * q["w"]).alias("z"),
        (p["w"] * q["w"] - p["x"] * q["x"] - p["y"] * q["y"] - p["z"] * q["z"]).alias("w"),
    )
