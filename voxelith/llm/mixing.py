"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelith.ordering import in_order
from voxelith.storage import clashless, columns, materialise, row_hash

#: A source gives its documents this many times at most.
EPOCHS = 3
WEIGHTS = (1, 2, 3)
#: Sources that are broadcast at most; more are joined by a shuffle.
BROADCAST_ROWS = 100_000
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words, runs of anything but ASCII white space; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def share(sources: DataFrame, budget: int) -> DataFrame:
    """`sources` (`size, weight`) with `target`: shares of `budget` by weight, none above EPOCHS times its size.

    A level L of words per weight is raised until the targets min(weight * L, EPOCHS * size) sum to the budget; each
    round is one aggregate of one row.
    """
    level = 0.0
    while budget:
        full = F.col("weight") * F.lit(level) > F.col("size") * EPOCHS
        spent, weights = sources.agg(F.coalesce(F.sum(F.when(full, F.col("size") * EPOCHS)), F.lit(0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0))).first()
        new = (budget - spent) / weights if weights else level
        if new == level:
            break
        level = new
    full = F.col("weight") * F.lit(level) > F.col("size") * EPOCHS
    return sources.withColumn("target", F.when(full, (F.col("size") * EPOCHS).cast("double")).otherwise(F.col("weight") * F.lit(level)))


def schedule(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """(one row per document: `doc_id, text_md5, size, source_no, source_size, target, upto`; the mix in its order).

    Documents are shuffled in their source by the MD5 of their id; `upto` is the source's running sum of words. Copy e
    (from 0) of a document ends at the virtual time (e * source_size + upto) / target. The mix is the copies of all
    sources range-sorted by that time and truncated where their words reach the budget, the words of all documents. Its
    rows are `source_no, upto, epoch, finish, size, pos`. Documents without words are not in the mix.

    Null sources are one source, the last in order. Null texts have no words. Rows that repeat an id are shuffled by
    their text's MD5. All sources without words, or an empty table: every target is 0 and the mix is empty.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        word_count(F.col(text_col)).alias("size"),
        F.md5(F.encode(F.coalesce(F.col(id_col).cast("string"), F.lit("")), "UTF-8")).alias("place"),
        F.md5(F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")).alias("text_md5"),
    )
    rows = materialise(rows, "mix-sizes")
    sources = rows.groupBy("source").agg(F.sum("size").alias("size"))
    sources, n_sources, budget = in_order(sources, [F.col("source").asc_nulls_last()], "size", "mix-sources", unique=True)
    weights = F.array(*map(F.lit, WEIGHTS))
    sources = sources.withColumn("weight", F.get(weights, (F.col("pos") % len(WEIGHTS)).cast("int"))).withColumnRenamed("pos", "source_no")
    sources = share(materialise(sources, "mix-weights"), budget)

    # Prefix sums of one order of all rows, less what lies before the source: no task sums a whole source.
    s = sources.select(F.col("source").alias("s"), "source_no", F.col("size").alias("source_size"), "target", F.col("before").alias("source_before"))
    s = F.broadcast(s) if n_sources <= BROADCAST_ROWS else s  # beyond, Spark splits a large source's rows in the join
    rows = rows.join(s, rows.source.eqNullSafe(s.s)).drop("s", "source")
    rows, _, _ = in_order(rows, [F.col("source_no"), F.col("place"), F.col("doc_id"), F.col("text_md5")], "size", "mix-shuffled")
    rows = rows.withColumn("upto", F.col("before") + F.col("size") - F.col("source_before"))
    rows = materialise(rows.drop("pos", "before", "source_before", "place"), "mix-rows")

    copies = rows.where("size > 0 AND target > 0").select(
        "source_no", "upto", "size", F.explode(F.transform(F.sequence(F.lit(0), F.lit(EPOCHS - 1)), lambda e: F.struct(e.alias("epoch"), ((e * F.col("source_size") + F.col("upto")) / F.col("target")).alias("finish")))).alias("c")
    )
    copies = copies.select("source_no", "upto", "size", "c.epoch", "c.finish")
    mixed, _, _ = in_order(copies, [F.col("finish"), F.col("source_no"), F.col("upto")], "size", "mix-order", unique=True)
    return rows, mixed.where(F.col("before") + F.col("size") <= budget).drop("before")


def mix_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """`doc_id, size, source_size, target, taken` per row; `taken` is `size` times the copies in the mix."""
    rows, mixed = schedule(docs, id_col, text_col, source_col)
    copies = mixed.groupBy("source_no", "upto").agg(F.count(F.lit(1)).alias("copies"), F.first("size").alias("words"))
    # Documents without words share `upto` with the one before them, whose copies are not theirs.
    out = rows.join(copies, ["source_no", "upto"], "left")
    taken = F.when(F.col("size") > 0, F.coalesce(F.col("copies") * F.col("size"), F.lit(0))).otherwise(F.lit(0)).cast("bigint")
    return out.select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of `docs` as often as the mix takes them, with the columns of `docs`. Cases as in schedule()."""
    rows, mixed = schedule(docs, id_col, text_col, source_col)
    key, md5, copies, rn = (clashless(docs, c) for c in ("mix_id", "mix_md5", "copies", "rn"))
    taken = mixed.groupBy("source_no", "upto").agg(F.count(F.lit(1)).alias("c"))
    taken = rows.where("size > 0").join(taken, ["source_no", "upto"]).groupBy(F.col("doc_id").alias(key), F.col("text_md5").alias(md5)).agg(F.sum("c").cast("int").alias(copies))
    same = Window.partitionBy(id_col, rn).orderBy(row_hash(docs))
    # Rows with the same id and text stand for each other: the one of least row_hash() gets the copies of all.
    left = docs.withColumn(rn, F.md5(F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")))
    on = F.col(id_col).eqNullSafe(F.col(key)) & (F.col(rn) == F.col(md5))
    out = left.join(taken, on).withColumn(key, F.row_number().over(same)).where(F.col(key) == 1)
    return out.withColumn(key, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(columns(docs))
