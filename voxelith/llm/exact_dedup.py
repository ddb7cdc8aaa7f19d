"""Exact dedup by a heavy-hitter split: frequent texts are settled map-side, the others by an ordinary shuffle."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelith.llm.heavy import SUPPORT, attach, winners
from voxelith.storage import clashless, columns, materialise, row_hash


def normalised(text: Column) -> Column:
    """`text` with A-Z lower-cased and nothing else changed; null becomes empty.

    lower() does the same to a text of ASCII only (as many bytes as characters) and is much faster than translate().
    """
    t = F.coalesce(text, F.lit(""))
    plain = F.octet_length(t) == F.char_length(t)
    return F.when(plain, F.lower(t)).otherwise(F.translate(t, string.ascii_uppercase, string.ascii_lowercase))


def text_digest(text: Column) -> Column:
    """SHA-256 of the normalised text in UTF-8, lowercase hex."""
    return F.sha2(F.encode(normalised(text), "UTF-8"), 256)


def dedup_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """A verdict per row: `doc_id, keep_id, group_size, kept, text_sha256`. Other columns of `docs` play no part.

    Of equal normalised texts the row with the largest id stays. Null texts count as empty; empty texts are equal. A
    null id loses to any other; a group of null ids only has a null keep_id and keeps its rows. Rows that repeat an id
    within a group are one document and share a verdict. An empty table gives an empty report.
    """
    keys = materialise(docs.select(F.col(id_col).alias("doc_id"), text_digest(F.col(text_col)).alias("text_sha256")), "dedup-keys")
    heavy, light = winners(keys, "text_sha256", F.max("doc_id"), support)
    out = attach(keys, heavy, light, "text_sha256")
    kept = F.col("doc_id").eqNullSafe(F.col("best"))
    return out.select("doc_id", F.col("best").alias("keep_id"), "group_size", kept.alias("kept"), "text_sha256")


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """The rows of `docs` that stay, one per normalised text, with the columns of `docs`.

    Cases as in dedup_report, but repeated rows of the winning id collapse into the one of least row_hash(). Frequent texts lose their copies
    before any text is shuffled; each other text meets its copies, fewer than a `support` share of all rows, in a window.
    """
    dig = clashless(docs, "text_sha256")
    rn = clashless(docs, "rn")
    keyed = docs.withColumn(dig, text_digest(F.col(text_col)))
    keys = materialise(keyed.select(F.col(id_col).alias("doc_id"), F.col(dig).alias("k")), "dedup-keys")
    heavy = winners(keys, "k", F.max("doc_id"), support)[0].select(F.col("k").alias(dig), F.col("best").alias(rn))
    won = keyed.join(F.broadcast(heavy), dig).where(F.col(id_col).eqNullSafe(F.col(rn)))
    won = won.groupBy(dig).agg(F.min_by(F.struct(columns(docs)), row_hash(docs)).alias(rn)).select(*(F.col(rn).getField(c).alias(c) for c in docs.columns))
    rest = keyed.join(F.broadcast(heavy.select(dig)), dig, "left_anti")
    first = F.row_number().over(Window.partitionBy(dig).orderBy(F.col(id_col).desc_nulls_last(), row_hash(docs)))
    rest = rest.withColumn(rn, first).where(F.col(rn) == 1)
    return won.unionByName(rest.select(columns(docs)))
