"""Heavy-hitter split: one row per key wins, and keys that hold many rows never meet in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelith.storage import materialise

#: A key is frequent when it holds more than this share of the rows; at most 1 / SUPPORT keys can.
SUPPORT = 1e-3


def frequent(keys: DataFrame, key: str, support: float = SUPPORT) -> DataFrame:
    """Misra-Gries candidates: every value of the string column `key` on more than `support` of the rows.

    Spark's freqItems keeps ceil(1 / support) decrementing counters per task and merges them, so no frequent key is
    missed; infrequent ones may be among the candidates. One column `key`, at most about 1 / support rows.
    """
    return keys.select(key).freqItems([key], support).select(F.explode(f"{key}_freqItems").alias(key)).where(F.col(key).isNotNull())


def winners(keys: DataFrame, key: str, best: Column, support: float = SUPPORT) -> tuple[DataFrame, DataFrame]:
    """(heavy, light): `key, best, group_size` per key, exact in both.

    heavy: the verified frequent keys, at most 1 / support rows, so it may be broadcast. light: all other keys, grouped
    by an ordinary shuffle with map-side partial aggregation. Read `keys` from a written table: it's scanned three times.
    `heavy` is written too: which infrequent keys are among the candidates may differ when they are found again.
    """
    found = F.broadcast(frequent(keys, key, support))
    total = lambda df: df.groupBy(key).agg(best.alias("best"), F.count(F.lit(1)).alias("group_size"))
    heavy = materialise(total(keys.join(found, key, "left_semi")).where("group_size > 1"), "heavy-keys")
    return heavy, total(keys.join(F.broadcast(heavy.select(key)), key, "left_anti"))


def attach(rows: DataFrame, heavy: DataFrame, light: DataFrame, key: str) -> DataFrame:
    """`rows` with `best` and `group_size` of their key: map-side for heavy keys, by a shuffle join for the others."""
    small = F.broadcast(heavy)
    on_heavy = rows.join(small, key, "inner")
    rest = rows.join(F.broadcast(heavy.select(key)), key, "left_anti")
    return on_heavy.unionByName(rest.join(light, key, "inner"))


def bounded(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """`df`, a written table, to be broadcast if it's counted to have `rows` rows at most; else it's joined by a shuffle."""
    return F.broadcast(df) if df.count() <= rows else df
