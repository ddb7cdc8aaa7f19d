"""Trees given by parent links: what lies on the way from the root to each node, in rounds as few as the depth's logarithm."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelith.storage import columns, discard, materialise

#: Rounds after which links must be a circle: a way of 2^40 nodes has more of them than any table.
ROUNDS = 40


def from_root(nodes: DataFrame, tree: list[str], node: str, parent: str, value: Column, compose: Callable[[Column, Column], Column], out: str) -> DataFrame:
    """`nodes` with `root`, `depth` (0 for roots) and `out`: the values from the root down to the node, compose(above, own).

    Nodes are told apart by the columns `tree` and `node`. In each round a node takes over what its ancestor has
    gathered and that one's ancestor (pointer doubling), so ways get twice as long; each round is written. `compose` is
    associative. A node whose parent is null or isn't there is a root. Links that go in a circle are an error.
    """
    key = [f"t{i}_" for i in range(len(tree))]
    kept = nodes.select(*(F.col(c).alias(k) for c, k in zip(tree, key)), F.col(node).alias("node_"), F.struct(columns(nodes)).alias("row_"), F.col(parent).alias("up_"), value.alias("value_"))
    there = kept.select(*(F.col(k).alias(f"{k}p") for k in key), F.col("node_").alias("p_"), F.lit(True).alias("there_"))
    at = _all([*(F.col(k).eqNullSafe(F.col(f"{k}p")) for k in key), F.col("up_") == F.col("p_")])
    state = kept.join(there, at, "left").withColumn("up_", F.when(F.col("there_"), F.col("up_")))
    state = materialise(state.select(*key, "node_", "row_", "up_", "value_", F.col("node_").alias("root_"), F.lit(0).cast("bigint").alias("depth_")), "tree")
    for _ in range(ROUNDS):
        if state.where("up_ IS NOT NULL").isEmpty():
            return state.select("row_.*", F.col("root_").alias("root"), F.col("depth_").alias("depth"), F.col("value_").alias(out))
        above = state.select(*(F.col(k).alias(f"{k}p") for k in key), F.col("node_").alias("p_"), F.col("up_").alias("up2_"), F.col("value_").alias("value2_"), F.col("root_").alias("root2_"), F.col("depth_").alias("depth2_"))
        on = F.col("p_").isNotNull()
        new = {"value_": F.when(on, compose(F.col("value2_"), F.col("value_"))).otherwise(F.col("value_")), "root_": F.coalesce("root2_", "root_")}
        # `depth_` counts the links that are behind; the one to the ancestor is one more, and its own come on top.
        joined = state.join(above, at, "left").withColumns(new | {"depth_": F.when(on, F.col("depth_") + F.col("depth2_") + 1).otherwise(F.col("depth_")), "up_": F.col("up2_")})
        after = materialise(joined.select(*key, "node_", "row_", "up_", "value_", "root_", "depth_"), "tree")
        discard(state)
        state = after
    raise ValueError("parent links go in a circle")


def _all(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out & p
    return out
