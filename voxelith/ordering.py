"""A global order without one task that sees all rows: range partitions, and prefix sums from per-partition totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelith.storage import clashless, columns, materialise

#: Rows of per-group figures that are broadcast at most; more of them are joined by a shuffle.
GROUP_ROWS = 200_000


def in_order(
    df: DataFrame, order: list[Column], size: str | None = None, name: str = "ordered", unique: bool = False, beside: list[str] | None = None
) -> tuple[DataFrame, int, int]:
    """(`df` with `pos` and, for a `size` column, `before`; number of rows; sum of `size`).

    With `beside`, rows have these columns of the row before and of the row behind them, as the structs `prev` and `next`.
    Partitions get the last row of the one before and the first of the next one, so there's no window over all rows.

    `pos` is the row's place from 0 in the order, `before` the sum of the sizes of the rows before it. Unless the keys are
    `unique`, rows with equal keys are dealt over partitions by their place in the input, so a key that many rows share
    is no hot spot; make the order total if such rows differ, and let the input be a scan, whose rows keep their places
    when a lost task runs again. The range-sorted table is written first, since range bounds come from a sample and
    could differ when computed again. Beside it only one row of totals per partition is gathered.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    part, seq, tie, rows0, size0 = (clashless(df, c) for c in ("part_", "seq_", "tie_", "rows0_", "size0_"))
    keys = order
    if not unique:
        df = df.withColumn(tie, F.monotonically_increasing_id())
        keys = [*order, F.col(tie)]
    t = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).drop(tie)
    t = materialise(t.withColumn(part, F.spark_partition_id()).withColumn(seq, F.monotonically_increasing_id()), name)
    value = F.coalesce(F.col(size), F.lit(0)).cast("bigint") if size else F.lit(0).cast("bigint")
    near = F.struct(*(F.col(c) for c in beside)) if beside else None
    edge0, edge1 = clashless(df, "edge0_"), clashless(df, "edge1_")
    ends = [f(near, F.col(seq)).alias(e) for f, e in ((F.min_by, edge0), (F.max_by, edge1))] if beside else []
    totals = t.groupBy(part).agg(F.count(F.lit(1)).alias(rows0), F.sum(value).alias(size0), *ends)
    all_rows, all_size = totals.agg(F.coalesce(F.sum(rows0), F.lit(0)), F.coalesce(F.sum(size0), F.lit(0))).first()
    ahead = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # as many rows as partitions
    row = Window.orderBy(part)
    halo = [F.lag(edge1).over(row).alias(edge1), F.lead(edge0).over(row).alias(edge0)] if beside else []
    offsets = totals.select(part, *(F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(c) for c in (rows0, size0)), *halo)
    inside = Window.partitionBy(part).orderBy(seq)
    out = t.join(F.broadcast(offsets), part).withColumn("pos", F.col(rows0) + F.row_number().over(inside) - 1)
    if size:
        out = out.withColumn("before", F.col(size0) + F.sum(value).over(inside.rowsBetween(Window.unboundedPreceding, 0)) - value)
    if beside:
        out = out.withColumns({"prev": F.coalesce(F.lag(near).over(inside), F.col(edge1)), "next": F.coalesce(F.lead(near).over(inside), F.col(edge0))})
    return out.drop(part, seq, rows0, size0, edge0, edge1), all_rows, all_size


def in_groups(df: DataFrame, by: list[str], order: list[Column], size: str | None = None, name: str = "grouped", unique: bool = False, pos: bool = False) -> DataFrame:
    """`df` with `place`, the row's place from 0 in its group, and for a `size` column `before`, the sum ahead of it there.

    Groups are runs of one global order, so a group that holds most rows lies in many partitions. Each group's first place
    is a minimum, and so is its first sum (kept with the place, as sizes may be negative). Null keys are groups too. The
    figures of up to GROUP_ROWS groups are broadcast; more are joined by a shuffle, in which AQE splits large keys. With
    `pos`, rows keep their places in the global order too.
    """
    first, base = (clashless(df, c) for c in ("first_", "base_"))
    keys = [clashless(df, f"key{i}_") for i in range(len(by))]
    ordered, _, _ = in_order(df, [*(F.col(c) for c in by), *order], size=size, name=name, unique=unique)
    starts = ordered.groupBy(*(F.col(c).alias(k) for c, k in zip(by, keys))).agg(F.min("pos").alias(first), *([F.min_by("before", "pos").alias(base)] if size else []))
    starts = materialise(starts, f"{name}-starts")
    if starts.count() <= GROUP_ROWS:
        starts = F.broadcast(starts)
    same = F.lit(True)
    for c, k in zip(by, keys):
        same = same & F.col(c).eqNullSafe(F.col(k))
    got = ordered.join(starts, same).withColumn("place", F.col("pos") - F.col(first))
    if size:
        got = got.withColumn("before", F.col("before") - F.col(base))
    return got.select(*columns(df), "place", *(["before"] if size else []), *(["pos"] if pos else []))


def with_neighbours(df: DataFrame, by: list[str], order: list[Column], beside: list[str], name: str = "beside", pos: bool = False) -> DataFrame:
    """`df` with `prev` and `next`: structs of the columns `beside` of the rows before and behind in the group, or null.

    Groups are runs of one global order, see in_order(), so a group that holds most rows is many tasks' work. Null keys are
    groups too. Make the order total if rows of equal keys differ. With `pos`, rows have their places in the global order.
    """
    keys = [clashless(df, f"key{i}_") for i in range(len(by))]
    given = df.withColumns({k: F.col(c) for k, c in zip(keys, by)})
    got, _, _ = in_order(given, [*(F.col(c) for c in by), *order], name=name, unique=True, beside=list(dict.fromkeys([*keys, *beside])))

    def held(side: str) -> Column:
        same = F.col(side).isNotNull()
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(side)[k])
        return F.when(same, F.struct(*(F.col(side)[c].alias(c) for c in beside)))

    return got.select(*columns(df), held("prev").alias("prev"), held("next").alias("next"), *(["pos"] if pos else []))


def group_quantiles(df: DataFrame, by: list[str], column: str, shares: dict[str, float]) -> DataFrame:
    """`by` and, by name, the interpolated quantiles of a column in each group; nulls are left out, groups of nulls too.

    The column is put in order within the groups over all partitions and only the rows at the wanted ranks are looked up,
    by their place, so no group's values are gathered.
    """
    rows = df.select(*by, F.col(column).alias("value_")).where("value_ IS NOT NULL")
    ordered, _, _ = in_order(rows, [F.col(k) for k in [*by, "value_"]], name="quantiles")
    span = ordered.groupBy(*by).agg(F.min("pos").alias("first_"), F.count(F.lit(1)).alias("n_")).where("n_ > 0")
    asked = []
    for name, q in shares.items():
        at = (F.col("n_") - 1) * F.lit(float(q))
        for end in (0, 1):
            pos = F.col("first_") + F.least(F.floor(at) + end, F.col("n_") - 1)
            asked.append(F.struct(F.lit(name).alias("name_"), F.lit(end).alias("end_"), pos.alias("pos"), (at - F.floor(at)).alias("part_")))
    found = span.select(*by, F.explode(F.array(*asked)).alias("w_")).select(*by, "w_.*").join(ordered.select("pos", "value_"), "pos")

    def quantile(name: str) -> Column:
        low, high = (F.max(F.when((F.col("name_") == name) & (F.col("end_") == e), F.col("value_"))) for e in (0, 1))
        return low + (high - low) * F.max(F.when(F.col("name_") == name, F.col("part_")))

    return found.groupBy(*by).agg(*(quantile(n).alias(n) for n in shares))
