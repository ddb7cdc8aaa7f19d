"""The packed voxel octree: breadth-first words from leaf masks, back to voxels, and the pair of files."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelith.operators.clouds import morton
from voxelith.operators.voxels import BLOCK
from voxelith.ordering import in_order
from voxelith.sources.files import opened

#: Fixed values of the format: the word of a solid leaf, and the bits of an index.
SOLID, INDEX_BITS = 0xFF000000, 24


def build(masks: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
    """(`idx, word` of the nodes, `leaf, lo, hi` of the mixed leaves) for blocks from 0 up to but without 2**depth.

    Nodes stand breadth first. In a level that is the order of their Morton prefixes, so one global order by level and
    prefix numbers them all, and a node's first child is the least number with its prefix.
    """
    if not 1 <= depth <= 20:
        raise ValueError("depth must be from 1 to 20")
    code = morton(*(F.col(b) for b in BLOCK))
    blocks = masks.select(code.alias("code"), "lo", "hi", "solid")
    nodes = blocks.select(F.lit(depth).alias("level"), F.col("code").alias("prefix"), "solid", "lo", "hi", F.lit(0).alias("mask"))
    below = blocks.select("code")
    for level in range(depth):
        bit = F.shiftright("code", 3 * (depth - level - 1)).bitwiseAND(F.lit(7)).cast("int")
        up = below.groupBy(F.shiftright("code", 3 * (depth - level)).alias("prefix")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1), bit)).alias("mask"))
        nodes = nodes.unionByName(up.select(F.lit(level).alias("level"), "prefix", F.lit(None).cast("boolean").alias("solid"), F.lit(None).cast("bigint").alias("lo"), F.lit(None).cast("bigint").alias("hi"), "mask"))
    numbered, n, _ = in_order(nodes, [F.col("level"), F.col("prefix")], name="octree-nodes", unique=True)
    if n > 2**INDEX_BITS:
        raise ValueError(f"{n} nodes don't fit in indices of {INDEX_BITS} bits")
    first = numbered.where("level > 0").groupBy((F.col("level") - 1).alias("level"), F.shiftright("prefix", 3).alias("prefix")).agg(F.min("pos").alias("first"))
    leaves, _, _ = in_order(numbered.where("NOT solid").select(F.col("pos").alias("node"), "lo", "hi"), [F.col("node")], name="octree-leaves", unique=True)
    word = (
        F.when(F.col("solid"), F.lit(SOLID))
        .when(F.col("solid").isNotNull(), F.col("leaf"))
        .otherwise(F.shiftleft(F.col("mask").cast("bigint"), INDEX_BITS).bitwiseOR(F.col("first")))
    )
    leaves = leaves.select("node", F.col("pos").alias("leaf"), "lo", "hi")
    out = numbered.join(first, ["level", "prefix"], "left").join(leaves.select("node", "leaf"), F.col("pos") == F.col("node"), "left")
    return out.select(F.col("pos").alias("idx"), word.cast("bigint").alias("word")), leaves.select("leaf", "lo", "hi")


def flatten(nodes: DataFrame, leaves: DataFrame, depth: int) -> DataFrame:
    """The leaf masks (`kx, ky, kz, lo, hi, solid`) of an octree: a join per level, from the root down.

    A solid word above the last level stands for all blocks below it.
    """
    full = F.lit(2**32 - 1).cast("bigint")
    at = nodes.where("idx = 0").select(F.lit(0).cast("bigint").alias("code"), "word")
    found = None
    for level in range(depth + 1):
        solid, mask = F.col("word") == SOLID, F.shiftright("word", INDEX_BITS)
        span = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(8 ** (depth - level) - 1).cast("bigint")))
        done = at.where(solid).select(F.shiftleft("code", 3 * (depth - level)).alias("base"), span.alias("i")).select((F.col("base") + F.col("i")).alias("code"), full.alias("lo"), full.alias("hi"))
        if level == depth:
            mixed = at.where(~solid).join(leaves, F.col("word") == F.col("leaf")).select("code", "lo", "hi")
            done = done.unionByName(mixed)
        found = done if found is None else found.unionByName(done)
        if level < depth:
            octants = F.explode(F.sequence(F.lit(0), F.lit(7)))
            kids = at.where(~solid & (mask > 0)).select("code", "word", mask.alias("mask"), octants.alias("o")).where(F.call_function("shiftright", F.col("mask"), F.col("o")).bitwiseAND(F.lit(1)) == 1)
            before = F.bit_count(F.col("mask").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("o")) - 1))
            kids = kids.select((F.shiftleft("code", 3) + F.col("o")).alias("code"), (F.col("word").bitwiseAND(F.lit(2**INDEX_BITS - 1)) + before).alias("idx"))
            at = kids.join(nodes, "idx").select("code", "word")
    return found.select(*(_gather(F.col("code"), k, depth).alias(b) for k, b in enumerate(BLOCK)), "lo", "hi", ((F.col("lo") == full) & (F.col("hi") == full)).alias("solid"))


def _gather(code: Column, axis: int, bits: int) -> Column:
    """The coordinate of one axis in a Morton code."""
    out = F.lit(0).cast("bigint")
    for i in range(bits):
        out = out.bitwiseOR(F.shiftleft(F.shiftright(code, 3 * i + axis).bitwiseAND(F.lit(1).cast("bigint")), i))
    return out


def write_pair(nodes: DataFrame, leaves: DataFrame, meta: dict, path: str) -> dict:
    """Writes `voxel-meta.json` and `voxel.bin` under `path`; returns the metadata.

    The format's 24-bit indices bound both tables, so the words go through one task, in order.
    """
    words = nodes.select(F.lit(0).alias("part"), F.col("idx").alias("at"), F.array("word").alias("w")).unionByName(leaves.select(F.lit(1).alias("part"), F.col("leaf").alias("at"), F.array("lo", "hi").alias("w")))

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = opened(path)
        fs.create_dir(root, recursive=True)
        count = [0, 0]
        with fs.open_output_stream(f"{root}/voxel.bin.part", compression=None) as f:
            for b in batches:
                for part, w in zip(b["part"], b["w"]):
                    count[part] += len(w)
                if len(b):
                    f.write(np.concatenate(b["w"].tolist()).astype("<u4").tobytes())
        fs.move(f"{root}/voxel.bin.part", f"{root}/voxel.bin")
        yield pd.DataFrame([count], columns=["nodes", "words"])

    n = words.orderBy("part", "at").coalesce(1).mapInPandas(put, "nodes bigint, words bigint").first()
    meta = meta | {"nodeCount": n.nodes, "leafDataCount": n.words}
    fs, root = opened(path)
    with fs.open_output_stream(f"{root}/voxel-meta.json", compression=None) as f:
        f.write(json.dumps(meta).encode())
    return meta


def read_pair(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, dict]:
    """(nodes, leaves, metadata) of a pair of files; a blob shorter than its metadata says is an error."""
    fs, root = opened(path)
    with fs.open_input_file(f"{root}/voxel-meta.json") as f:
        meta = json.loads(f.read())
    n, words = meta["nodeCount"], meta["leafDataCount"]
    size = fs.get_file_info(f"{root}/voxel.bin").size // 4
    if n + words > size:
        raise ValueError(f"voxel.bin has {size} words, not {n + words}")
    step = 1 << 20

    def get(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, base = opened(path)
        with own.open_input_file(f"{base}/voxel.bin") as f:
            for b in batches:
                for i in b["id"]:
                    k = min(step, n + words - i * step)
                    w = np.frombuffer(f.read_at(4 * k, 4 * step * i), "<u4").astype(np.int64)
                    yield pd.DataFrame({"at": np.arange(i * step, i * step + k), "word": w})

    blob = spark.range(-(-(n + words) // step)).mapInPandas(get, "at bigint, word bigint")
    leaf = F.expr(f"(at - {n}) div 2")
    pick = lambda k: F.max(F.when((F.col("at") - n) % 2 == k, F.col("word")))
    leaves = blob.where(F.col("at") >= n).groupBy(leaf.alias("leaf")).agg(pick(0).alias("lo"), pick(1).alias("hi"))
    return blob.where(F.col("at") < n).select(F.col("at").alias("idx"), "word"), leaves, meta
