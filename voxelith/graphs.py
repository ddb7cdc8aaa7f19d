"""Connected components of a link table, without gathering links or components anywhere."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelith.storage import discard, materialise

#: Links that a task contracts together.
CHUNK = 1 << 20


def contract(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of all nodes of these links but the roots, the least nodes of their components."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    up = np.arange(len(nodes))
    while True:
        px, py = up[x], up[y]
        if (px == py).all():
            child = np.flatnonzero(up != np.arange(len(up)))
            return nodes[child], nodes[up[child]]
        low = np.minimum(px, py)
        np.minimum.at(up, px, low)
        np.minimum.at(up, py, low)
        while (up != (jumped := up[up])).any():
            up = jumped


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0

    def told() -> pa.RecordBatch:
        child, root = contract(*(np.concatenate([b.column(i).to_numpy() for b in held]) for i in (0, 1)))
        return pa.RecordBatch.from_arrays([pa.array(child), pa.array(root)], names=["node", "root"])

    for b in batches:
        held.append(b)
        n += len(b)
        if n >= CHUNK:
            yield told()
            held, n = [], 0
    if n:
        yield told()


def forest(links: DataFrame, name: str = "components", nodes: int | None = None) -> DataFrame:
    """`node, label` of each node of `links` (`a, b` bigint, either order) that isn't the least of its component, written.

    In a round each task contracts its links to stars, from all nodes to the least one; a node then has as many roots as
    there were tasks and chunks at most. The roots of a node are linked with the least of them, and each node's root is
    replaced by the root's own root. The latter is a left join whose right side is unique, so Spark may split a root with
    very many nodes. Rounds end when no root has a root. Each round's links are written to the shared folder. Links with a
    null end or equal ends say nothing. No links give no rows. `nodes` bounds the nodes from above, if that's known.
    """
    edges = links.where("a <> b").select("a", "b")
    last = None
    while True:
        stars = edges.mapInArrow(_stars, "node bigint, root bigint")
        told = materialise(stars.groupBy("node").agg(F.min("root").alias("root"), F.collect_set("root").alias("roots")), name, nodes)
        above = told.select(F.col("node").alias("root"), F.col("root").alias("top"))
        jumped = told.select("node", "root").join(above, "root", "left").select(F.col("node").alias("a"), F.coalesce("top", "root").alias("b"), F.col("top").isNotNull().alias("moved"))
        met = told.where("size(roots) > 1").select("root", F.explode("roots").alias("a")).where("a <> root").select("a", F.col("root").alias("b"), F.lit(True).alias("moved"))
        new = materialise(jumped.unionByName(met), name, nodes)
        discard(told, *([last] if last is not None else []))
        if new.where("moved").isEmpty():
            return new.select(F.col("a").alias("node"), F.col("b").alias("label"))
        last, edges = new, new.select("a", "b")


def with_roots(below: DataFrame) -> DataFrame:
    """`node, label` of what forest() returned and of the roots, which label themselves."""
    roots = below.select("label").distinct()
    return below.unionByName(roots.select(F.col("label").alias("node"), "label"))


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """`node, label` for each node that `links` link with another; the label is the component's least node. See forest()."""
    return with_roots(forest(links, name))
