"""Windowed operators that work on batches and on streams alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelith.ordering import in_groups, with_neighbours
from voxelith.storage import clashless, columns, discard, materialise


#: Rounds of links that are twice as long each time: enough for any table.
ROUNDS = 64


def _late(rows: DataFrame, ts: str, watermark: str | None) -> DataFrame:
    return rows.withWatermark(ts, watermark) if watermark and rows.isStreaming else rows


def throttle(rows: DataFrame, key: str, ts: str, every: str, value: str, order: list[str], watermark: str | None = None) -> DataFrame:
    """`key, at, n, value`: the latest value of each key in every window in which it had one.

    Windows are aligned to the clock, so that they don't depend on each other; a throttle whose windows begin with the first
    row after the last one's end fires at other times, as often at most.
    """
    got = _late(rows, ts, watermark).groupBy(F.window(ts, every).alias("w"), key)
    return got.agg(F.count(F.lit(1)).alias("n"), F.max_by(value, F.struct(*order)).alias(value)).select(key, F.col("w.start").alias("at"), "n", value)


def chain(rows: DataFrame, key: str, at: str, gap: int, order: list[str]) -> DataFrame:
    """`rows` with `starts`: whether a window starts with the row. A key's first window starts with its first row, the next
    with the first row `gap` or more after that, and so on; `at` is a number, and rows are in order of it and `order`.

    Each start decides the next, but every row knows which start would follow it: the first row `gap` later, found by
    putting rows and the times they wait for in one order. Starts are then reached from the first rows by links that
    become twice as long in each round (pointer doubling), so rounds are few and no key's rows are one task's work.
    """
    real, pos, own = (clashless(rows, c) for c in ("real_", "pos_", "own_"))
    placed = in_groups(rows, [key], [F.col(c) for c in (at, *order)], name="chain-rows", unique=True, pos=True)
    placed = materialise(placed.withColumnsRenamed({"pos": pos, "place": own}), "chain-rows")
    asked = placed.select(key, F.col(at).alias("t_"), F.lit(1).alias(real), pos, own).unionByName(placed.select(key, (F.col(at) + gap).alias("t_"), F.lit(0).alias(real), pos, own))
    # Behind what a row waits for come the rows that may start the next window; `before` counts the real ones ahead.
    ranked = in_groups(asked, [key], [F.col("t_"), F.col(real), F.col(pos)], size=real, name="chain-order", unique=True)
    last = placed.groupBy(F.col(key).alias("k_")).agg(F.max(own).alias("last_"))
    links = ranked.where(F.col(real) == 0).join(last, F.col(key).eqNullSafe(F.col("k_")))
    state = links.select(pos, F.when(F.col("before") <= F.col("last_"), F.col(pos) - F.col(own) + F.col("before")).alias("next"), (F.col(own) == 0).alias("starts"))
    state = materialise(state, "chain-links")
    for _ in range(ROUNDS):
        if state.where("next IS NOT NULL").isEmpty():
            break
        ahead = state.select(F.col(pos).alias("p_"), F.col("next").alias("next2_"))
        reached = state.where("starts AND next IS NOT NULL").select(F.col("next").alias("r_")).distinct()
        new = state.join(ahead, F.col("next") == F.col("p_"), "left").join(reached, F.col(pos) == F.col("r_"), "left")
        new = materialise(new.select(pos, F.col("next2_").alias("next"), (F.col("starts") | F.col("r_").isNotNull()).alias("starts")), "chain-links")
        discard(state)
        state = new
    return placed.join(state.select(pos, "starts"), pos).select(*columns(rows), "starts")


def throttle_from_first(rows: DataFrame, key: str, at: str, gap: int, value: str, order: list[str]) -> DataFrame:
    """`key, start, n, value`: windows of `gap` that begin with the first row after the last one's end, see chain(): how many
    rows each has and the value of its last one, which is told when the window ends.
    """
    flag = clashless(rows, "flag_")
    marked = chain(rows.select(key, at, value, *(c for c in order if c not in (key, at, value))), key, at, gap, order).withColumn(flag, F.col("starts").cast("int"))
    numbered = in_groups(marked, [key], [F.col(c) for c in (at, *order)], size=flag, name="throttle", unique=True)
    window = (F.col("before") + F.col(flag)).alias("window_")
    got = numbered.groupBy(key, window).agg(F.min(at).alias("start"), F.count(F.lit(1)).alias("n"), F.max_by(value, "place").alias(value))
    return got.select(key, "start", "n", value)


def debounce(rows: DataFrame, key: str, ts: str, quiet: str, watermark: str | None = None) -> DataFrame:
    """`key, first, last, n`: bursts of rows, each ended by `quiet` time without one."""
    got = _late(rows, ts, watermark).groupBy(F.session_window(ts, quiet).alias("w"), key)
    return got.agg(F.min(ts).alias("first"), F.max(ts).alias("last"), F.count(F.lit(1)).alias("n")).select(key, "first", "last", "n")


def rate(rows: DataFrame, ts: str, every: str, watermark: str | None = None, per_ms: float = 1000.0) -> DataFrame:
    """`at, frames, rate`: rows per second in each window, rounded half up."""
    got = _late(rows, ts, watermark).groupBy(F.window(ts, every).alias("w")).agg(F.count(F.lit(1)).alias("frames"))
    us = F.unix_micros(F.col("w.end").cast("timestamp")) - F.unix_micros(F.col("w.start").cast("timestamp"))
    return got.select(F.col("w.start").alias("at"), "frames", F.floor(F.col("frames") * per_ms * 1000 / us + 0.5).cast("bigint").alias("rate"))


def current_generation(rows: DataFrame, scope: str, generation: str) -> DataFrame:
    """Rows of each scope's latest generation; earlier work is superseded. The maximum is joined, so no scope is sorted."""
    top = rows.groupBy(F.col(scope).alias("_s")).agg(F.max(generation).alias("_g"))
    return rows.join(top, (F.col(scope) == F.col("_s")) & (F.col(generation) == F.col("_g"))).drop("_s", "_g")


def rendered(frames: DataFrame, dirty: list[Column]) -> DataFrame:
    """Frames in which some callback reports a change."""
    any_ = F.lit(False)
    for d in dirty:
        any_ = any_ | F.coalesce(d, F.lit(False))
    return frames.where(any_)


def resorts(poses: DataFrame, key: str, order: list[str], moved: float = 0.1, turned: float = 0.99999) -> DataFrame:
    """`poses` (`x, y, z` and a direction `fx, fy, fz`) with `resort`: whether a pose is so far from the one before, in
    place or direction, that its splats are sorted anew; the first always is."""
    got = with_neighbours(poses, [key], [F.col(c) for c in order], ["x", "y", "z", "fx", "fy", "fz"])
    d2 = sum(((F.col(c) - F.col(f"prev.{c}")) ** 2 for c in "xyz"), F.lit(0.0))
    cos = sum((F.col(f"f{c}") * F.col(f"prev.f{c}") for c in "xyz"), F.lit(0.0))
    return got.withColumn("resort", F.coalesce((d2 > moved**2) | (cos < turned), F.lit(True))).drop("prev", "next")


def cached(wanted: DataFrame, cache: DataFrame, key: str, version: str | None = None) -> DataFrame:
    """`wanted` with `hit` and the cached `value`: a record is used if no version is asked for or it has that version."""
    c = cache.select(F.col(key).alias("_k"), F.col("value").alias("_v"), F.col("version").alias("_ver"))
    ok = F.col("_ver").isNotNull() & ((F.col(version).isNull() | (F.col(version) == F.col("_ver"))) if version else F.lit(True))
    out = wanted.join(c, F.col(key) == F.col("_k"), "left")
    return out.withColumn("hit", F.coalesce(ok, F.lit(False))).withColumn("value", F.when(F.col("hit"), F.col("_v"))).drop("_k", "_v", "_ver")
