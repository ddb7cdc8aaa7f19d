"""Contiguous shards of near-equal bytes: global prefix sums of sizes, cut at equal targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelith.ordering import in_order
from voxelith.storage import clashless, columns, materialise, row_hash

#: Bytes that a document takes besides its text.
OVERHEAD = 16


def assign_shards(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", overhead: int = OVERHEAD) -> DataFrame:
    """`doc_id, size, text_crc32, law, shard, slot, grown_shard` per row; the law is `bytes`.

    Rows stand in order of id, nulls first, then of CRC and size; each shard is a run of that order. A row goes to the
    shard in which the middle of its byte range lies, so a shard's bytes are off its share by a row's size at most. `slot`
    counts from 0 in each shard. A null text has no bytes and a CRC of 0; repeated rows are dealt as other rows are. A
    text larger than a share leaves shards empty. `grown_shard` is null: with one more shard all cuts move. Equal texts
    needn't share a shard: one group of copies may be larger than a share.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text).cast("bigint") + overhead).alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )
    order = [F.col("doc_id").asc_nulls_first(), F.col("text_crc32"), F.col("size")]
    placed, _, total = in_order(rows, order, "size", "shard-order")  # rows equal in the order are equal in all that counts
    middle = F.expr(f"(2 * before + size) * {shards} div {max(1, 2 * total)}")
    placed = materialise(placed.withColumn("shard", F.least(F.lit(shards - 1), middle).cast("int")), "shards")
    first = placed.groupBy("shard").agg(F.min("pos").alias("first"))  # one row a shard
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("pos") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def write_shards(docs: DataFrame, path: str, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", max_rows: int = 1_000_000) -> None:
    """Writes `docs` as Parquet under `path`, one folder `shard=N` each.

    The rows of the assignment find their documents by id, CRC and size; of rows that agree in these, copies take their
    places in order of row_hash(). A shard is written by as many tasks as its slots need, `max_rows` to each. All columns
    of `docs` are kept, under their own names: one that is called `shard` already (names compare without case) makes
    the folders `shard_=N`. An empty table gives no shards. Cases as in assign_shards().
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    crc, size, copy, p_id, p_crc, p_size, p_copy, slot, shard = (clashless(docs, c) for c in ("crc", "size", "copy", "p_id", "p_crc", "p_size", "p_copy", "slot", "shard"))
    placed = assign_shards(docs, shards, id_col, text_col)
    nth = F.row_number().over(Window.partitionBy("doc_id", "text_crc32", "size").orderBy("shard", "slot"))
    placed = placed.select(F.col("doc_id").alias(p_id), F.col("text_crc32").alias(p_crc), F.col("size").alias(p_size), nth.alias(p_copy), F.col("shard").alias(shard), F.col("slot").alias(slot))
    keyed = docs.withColumn(crc, F.crc32(F.encode(text, "UTF-8"))).withColumn(size, F.octet_length(text).cast("bigint") + OVERHEAD)
    keyed = keyed.withColumn(copy, F.row_number().over(Window.partitionBy(id_col, crc, size).orderBy(row_hash(docs))))
    on = F.col(id_col).eqNullSafe(F.col(p_id)) & (F.col(crc) == F.col(p_crc)) & (F.col(size) == F.col(p_size)) & (F.col(copy) == F.col(p_copy))
    part = (F.col(slot) / max_rows).cast("bigint")
    out = keyed.join(placed, on).repartition(F.col(shard), part).sortWithinPartitions(shard, slot)
    out.select(*columns(docs), shard).write.partitionBy(shard).parquet(path)
