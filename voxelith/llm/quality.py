"""Quality by ordinal regression: one set of hashed-text weights, ordered thresholds between grades (cumulative logit)."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelith.llm.fitting import minimise, summed
from voxelith.llm.texts import with_columns
from voxelith.llm.toxicity import held_out
from voxelith.storage import discard, materialise

#: Labelled documents that the model is fitted on at most (the first in order of their id's hash).
TRAIN_DOCS = 8_000
#: Buckets of token hashes.
BUCKETS = 1 << 18
TOKEN = re.compile(r"\w+|[^\w\s]+")


@dataclass
class Model:
    """P(grade > j) = sigmoid(w . x - cut[j]); `grades` are the ratings in order."""

    weights: np.ndarray
    cuts: np.ndarray
    grades: list[float]


def _bucket(token: str) -> int:
    return xxhash.xxh3_64_intdigest(token) & (BUCKETS - 1)


class _Buckets(dict):
    def __missing__(self, token: str) -> int:
        if len(self) > 150_000:
            self.clear()
        b = self[token] = _bucket(token)
        return b


def _vector(buckets: _Buckets, text: str) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, values): square roots of the shares of tokens of the lower-cased text, a unit vector."""
    count = Counter(map(buckets.__getitem__, TOKEN.findall(text.lower())))
    at = np.fromiter(count, np.int64, len(count))
    n = np.fromiter(count.values(), np.float64, len(count))
    return at, np.sqrt(n / n.sum()) if len(n) else n


def loss(p: np.ndarray, used: np.ndarray, grade: np.ndarray, vectors: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """[negative log-likelihood, its gradient], summed over documents of grades 0..K-1.

    `p` has a weight for each of the buckets `used`, the first cut and the logarithms of the gaps to each next cut, so
    that the cuts stay in order.
    """
    n, k = len(grade), len(p) - len(used) + 1
    rows = np.repeat(np.arange(n), [len(at) for at, _ in vectors])
    at = np.concatenate([*(a for a, _ in vectors), np.empty(0, np.int64)]).astype(np.int64)
    value = np.concatenate([*(v for _, v in vectors), np.empty(0)]).astype(np.float64)
    column = np.searchsorted(used, at)
    gap = np.exp(p[len(used) + 1 :])
    cuts = p[len(used)] + np.concatenate([[0.0], np.cumsum(gap)])
    z = np.bincount(rows, p[: len(used)][column] * value, n)
    low, high = np.eye(k + 1)[grade], np.eye(k + 1)[grade + 1]
    over = np.column_stack([np.ones(n), 1 / (1 + np.exp(np.minimum(cuts - z[:, None], 500))), np.zeros(n)])  # P(grade > j), j = -1..K-1
    like = np.maximum((over * low).sum(1) - (over * high).sum(1), 1e-9)
    slope = over * (1 - over)
    d = (slope * low - slope * high) / like[:, None]  # of the log-likelihood by z, per cut
    dz = -d.sum(1)
    dcut = d[:, 1:k].sum(0)
    weights = np.bincount(column, dz[rows] * value, len(used))
    return np.concatenate([[-np.log(like).sum()], weights, [dcut.sum()], gap * np.cumsum(dcut[::-1])[::-1][1:]])


def train(docs: DataFrame, ratings: DataFrame, rating_col: str = "rating", id_col: str = "doc_id", text_col: str = "text", l2: float = 1e-5) -> Model:
    """Fits a model on at most TRAIN_DOCS rated documents that are not held out (see toxicity.held_out()), each whole.

    Null ratings and ids are left out; of an id's ratings the largest counts, and of rows that repeat an id the one of
    least text. With one rating or none there is nothing to learn; every document gets it (or 0). The likelihood with an
    L2 penalty is made large by L-BFGS, whose gradients tasks sum up: what comes to the driver is one number for each
    bucket from each task, whatever the texts' lengths.
    """
    known = ratings.where(F.col(rating_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).alias("l_id")).agg(F.max(rating_col).cast("double").alias("rating"))
    known = known.orderBy(F.xxhash64("l_id"), "l_id").limit(TRAIN_DOCS)
    text = F.coalesce(F.col(text_col), F.lit("")).alias("text")
    rows = docs.select(F.col(id_col).alias("d_id"), text).join(F.broadcast(known), F.col("d_id") == F.col("l_id"))
    rows = rows.groupBy("l_id").agg(F.min(F.struct("rating", "text")).alias("row")).select("row.rating", "row.text")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = _Buckets()
        for b in batches:
            got = [_vector(buckets, t) for t in b.column(1).to_pylist()]
            arrays = [b.column(0), pa.array([a.astype(np.int32) for a, _ in got], pa.list_(pa.int32())), pa.array([v for _, v in got], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["rating", "at", "value"])

    rows = materialise(rows.mapInArrow(vectors, "rating double, at array<int>, value array<double>"), "quality-sample")
    shares = {r.rating: r["n"] for r in rows.groupBy("rating").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each grade
    grades, n = sorted(shares), sum(shares.values())
    if len(grades) < 2:
        discard(rows)
        return Model(np.zeros(BUCKETS, np.float32), np.zeros(0), [float(g) for g in grades] or [0.0])
    used = np.sort(np.array([r[0] for r in rows.select(F.explode("at").alias("b")).distinct().collect()], np.int64))  # BUCKETS at most

    def work(p: np.ndarray, batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        out = np.zeros(len(p) + 1)
        for b in batches:
            grade = np.searchsorted(grades, b.column(0).to_numpy())
            out += loss(p, used, grade, list(zip(*([x.values.to_numpy() for x in b.column(i)] for i in (1, 2)))))
        return out

    def penalised(p: np.ndarray) -> tuple[float, np.ndarray]:
        got, slopes = summed(rows, work, p) / n, np.where(np.arange(len(p)) < len(used), p, 0.0)
        return got[0] + l2 / 2 * float(slopes @ slopes), got[1:] + l2 * slopes

    over = np.array([sum(shares[g] for g in grades[j + 1 :]) / n for j in range(len(grades) - 1)])
    cuts = -np.log(over / (1 - over))
    p = minimise(penalised, np.concatenate([np.zeros(len(used)), [cuts[0]], np.log(np.maximum(np.diff(cuts), 1e-3))]))
    discard(rows)
    weights = np.zeros(BUCKETS, np.float32)
    weights[used] = p[: len(used)]
    return Model(weights, p[len(used)] + np.concatenate([[0.0], np.cumsum(np.exp(p[len(used) + 1 :]))]), grades)


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """`docs` with `expected_grade` and `tails`: P(rating >= grade) for each grade but the lowest.

    Only the whole text is looked at. Null and empty texts have the zero vector, so the grades' own shares. Columns of
    `docs` with the new names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS floats

    def make():
        m, buckets, steps = shared.value, _Buckets(), np.diff(shared.value.grades)

        def work(texts: list[str]) -> list[list]:
            z = np.zeros(len(texts))
            for i, t in enumerate(texts):
                at, value = _vector(buckets, t)
                z[i] = m.weights[at] @ value
            tails = 1 / (1 + np.exp(m.cuts - z[:, None]))
            return [(m.grades[0] + tails @ steps).tolist(), tails.tolist()]

        return work

    return with_columns(docs, F.col(text_col), make, [("expected_grade", "double", pa.float64()), ("tails", "array<double>", pa.list_(pa.float64()))])


def rating(quality: Column, toxic: Column) -> Column:
    """Graded rating of a label: 0 for low quality, 1 for good but toxic, 2 for good and clean; null if one is null."""
    return F.when(quality == 0, 0).when((quality == 1) & (toxic == 1), 1).when((quality == 1) & (toxic == 0), 2)


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`doc_id, held_out, expected_grade, p_good, selected` per row; selected where a grade of 1 or more is likelier than not."""
    model = train(docs, labels.select("doc_id", rating(F.col("quality"), F.col("toxic")).alias("rating")))
    got = score(docs.select("doc_id", "text"), model)
    good = F.coalesce(F.get("tails", F.lit(0)), F.lit(1.0))
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "expected_grade", good.alias("p_good"), (good >= 0.5).alias("selected"))
