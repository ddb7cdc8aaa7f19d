"""Exact top-k search of binary codes by incremental multi-index hashing."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelith.storage import materialise

#: Probes of a batch, and numbers that are looked through for masks at once.
MASKS, NUMBERS = 1 << 15, 1 << 20


def sign_code(embedding: Column) -> Column:
    """A code of up to 64 bits: for each number, in order, whether it's positive. Null numbers count as not positive.

    A null embedding has a null code, an empty one the code 0. More than 64 numbers are an error.
    """
    embedding = F.when(F.size(embedding) > 64, F.raise_error(F.lit("a code has 64 bits at most"))).otherwise(embedding)
    return F.aggregate(embedding, F.lit(0).cast("bigint"), lambda acc, x: F.shiftleft(acc, 1).bitwiseOR(F.when(x > 0, F.lit(1)).otherwise(F.lit(0)).cast("bigint")))


def _segments(bits: int, codes: int) -> list[tuple[int, int]]:
    """(shift, width) of each segment: about as many values as codes, so that a probe finds about one code."""
    m = min(8, max(2, math.ceil(bits / max(1.0, math.log2(max(2, codes))))))
    cuts = [bits * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _part(code: Column, shift: int, width: int) -> Column:
    return F.shiftrightunsigned(code, shift).bitwiseAND(F.lit((1 << width) - 1).cast("bigint"))


def _masks(width: int, radius: int) -> Iterator[np.ndarray]:
    """All numbers of `width` bits with `radius` of them set, in arrays of bounded size."""
    for start in range(0, 1 << width, NUMBERS):
        some = np.arange(start, min(start + NUMBERS, 1 << width), dtype=np.int64)
        some = some[np.bitwise_count(some) == radius]
        for k in range(0, len(some), MASKS):
            yield some[k : k + MASKS]


def _probes(active: DataFrame, segments: list[tuple[int, int]], radius: int) -> DataFrame:
    """`seg, value, q, kth`: the segment values at this Hamming distance from each query's. Tasks make them, batch by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q, kth = b.column(0).to_numpy(), b.column(1)
            for i, (shift, width) in enumerate(segments):
                own = (q.view(np.uint64) >> np.uint64(shift)).view(np.int64) & ((1 << width) - 1)
                for masks in _masks(width, radius):
                    step = max(1, MASKS // len(masks))
                    for k in range(0, len(q), step):
                        n = len(own[k : k + step])
                        at = np.repeat(np.arange(k, k + n), len(masks))
                        value = (own[k : k + step, None] ^ masks).ravel()
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), i, np.int32)), pa.array(value), pa.array(q[at]), kth.take(pa.array(at))], names=["seg", "value", "q", "kth"])

    return active.select("q", "kth").mapInArrow(run, "seg int, value bigint, q bigint, kth int")


def top_k(rows: DataFrame, queries: DataFrame, k: int = 10, bits: int = 64, id_col: str = "id", code_col: str = "code") -> DataFrame:
    """`query_id, rank, id, distance`: for each row of `queries` the `k` rows of `rows` nearest by Hamming distance, ties by id.

    Both have an id and a bigint code of `bits` bits. Null codes are neither found nor searched; a query finds itself if
    it's among `rows`. Equal codes are one entry of the index, and equal queries are searched once. Repeated rows are
    found as often as they are there. Fewer than `k` rows are all found; an empty table gives no rows.

    The codes are cut into m segments. Round r probes each segment's table with all values at distance r from the
    query's; a code is verified where its lowest segment of least distance meets it, so once. After the round every code
    within m * (r + 1) - 1 has been verified. A query ends when its k-th best distance is within that.
    """
    members = materialise(rows.where(F.col(code_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(code_col).alias("code")), "mih-rows")
    asked = materialise(queries.where(F.col(code_col).isNotNull()).select(F.col(id_col).alias("query_id"), F.col(code_col).alias("q")), "mih-queries")
    index = materialise(members.groupBy("code").agg(F.min("id").alias("first_id")), "mih-codes")
    segments = _segments(bits, index.count())
    m, widest = len(segments), max(w for _, w in segments)
    slots = F.explode(F.array(*(F.struct(F.lit(i).alias("seg"), _part(F.col("code"), *s).alias("value")) for i, s in enumerate(segments))))
    slots = materialise(index.select(slots.alias("s"), "code", "first_id").select("s.seg", "s.value", "code", "first_id"), "mih-slots")

    order = Window.partitionBy("q").orderBy("distance", F.col("first_id").asc_nulls_last(), "code")
    best = None
    active = materialise(asked.select("q").distinct().withColumn("kth", F.lit(None).cast("int")), "mih-active")
    done: list[DataFrame] = []
    for r in range(widest + 1):
        away = [F.bit_count(_part(F.col("q").bitwiseXOR(F.col("code")), *s)) for s in segments]
        once = F.lit(True)
        for i in range(m):  # met here first: lower segments are farther than r, higher ones as far at least
            once = once & F.when(F.col("seg") > i, away[i] > r).when(F.col("seg") < i, away[i] >= r).otherwise(F.lit(True))
        distance = F.bit_count(F.col("q").bitwiseXOR(F.col("code"))).cast("int")
        # Probes are many for each query, which Spark's estimate doesn't know: they must not be broadcast.
        near = _probes(active, segments, r).hint("merge").join(slots, ["seg", "value"]).withColumn("distance", distance)
        near = near.where((F.col("kth").isNull() | (F.col("distance") <= F.col("kth"))) & once).select("q", "code", "first_id", "distance")
        if best is not None:
            near = near.unionByName(best)
        best = materialise(near.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k), "mih-best")
        covered = m * (r + 1) - 1
        state = best.groupBy("q").agg(F.max(F.when(F.col("nth") == k, F.col("distance"))).alias("kth"))
        active = materialise(active.select("q").join(state, "q", "left").where(F.col("kth").isNull() | (F.col("kth") > covered)), "mih-active")
        settled = best.drop("nth").join(active.select("q"), "q", "left_anti")
        done.append(settled)
        if active.isEmpty():
            break
        best = best.drop("nth").join(active.select("q"), "q", "left_semi")
    else:
        done.append(best)
    found = done[0]
    for d in done[1:]:
        found = found.unionByName(d.select(found.columns))

    # Of a code's rows only its k least ids can be among the k nearest.
    by_id = Window.partitionBy("code").orderBy(F.col("id").asc_nulls_last())
    few = members.withColumn("nth", F.row_number().over(by_id)).where(F.col("nth") <= k).drop("nth")
    rank = Window.partitionBy("q").orderBy("distance", F.col("id").asc_nulls_last())
    ranked = found.join(few, "code").withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)
    return asked.join(ranked, "q").select("query_id", "rank", "id", "distance")
