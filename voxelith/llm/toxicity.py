"""Toxicity by multiple-instance learning: documents are labelled, sentences are scored, noisy-or joins the two."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelith.llm import grams
from voxelith.llm.fitting import minimise, summed
from voxelith.llm.texts import with_columns
from voxelith.storage import clashless, columns, discard, materialise

#: Labelled documents that the model is fitted on at most (the first in order of their id's hash).
TRAIN_DOCS = 12_000
#: Buckets of features get a weight if they are in so many documents whose share of toxic ones is so many standard errors off.
LEAST_DOCS, EVIDENCE = 4, 4.0
THRESHOLD = 0.7
SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))


@dataclass
class Model:
    """Bias of a sentence's logit, and weights of feature buckets (see grams)."""

    bias: float
    buckets: np.ndarray
    weights: np.ndarray

    def table(self) -> np.ndarray:
        out = np.zeros(1 << grams.BITS, np.float32)
        out[self.buckets] = self.weights
        return out


def held_out(doc_id: Column) -> Column:
    """Whether labels of this id must not be learned from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.maximum(z, 0) + np.log1p(np.exp(-np.abs(z)))


def loss(w: np.ndarray, labels: list[int], sentences: list[int], hits: list[np.ndarray], places: list[np.ndarray]) -> np.ndarray:
    """[negative log-likelihood, its gradient] of `w`, weights and last the bias, summed over documents.

    P(document) = 1 - prod(1 - p) over its sentences; p is the logistic function of the bias and the weights of the
    sentence's features: hits are these, places the sentence of each.
    """
    y, n = np.array(labels, bool), np.array(sentences, np.int64)
    first = np.cumsum(n) - n
    feature = np.concatenate([*hits, np.empty(0, np.int64)]).astype(np.int64)
    place = np.concatenate([*(p + k for p, k in zip(places, first)), np.empty(0, np.int64)]).astype(np.int64)
    doc = np.repeat(np.arange(len(y)), n)
    z = np.bincount(place, w[feature], len(doc)) + w[-1]
    total = np.maximum(np.bincount(doc, _softplus(z), len(y)), 1e-6)  # -log(1 - P)
    pull = np.where(y, -1 / np.expm1(np.minimum(total, 50)), 1.0)
    g = pull[doc] / (1 + np.exp(-np.maximum(z, -500)))
    value = np.where(y, -np.log(-np.expm1(-total)), total).sum()
    return np.concatenate([[value], np.bincount(feature, g[place], len(w) - 1), [g.sum()]])


def _words_only(told: list[tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
    """The new numbers of sentences, counting only those with words."""
    has = np.zeros(n, bool)
    has[told[-1][1]] = True
    return np.where(has, np.cumsum(has) - 1, -1)


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", l2: float = 1e-5) -> Model:
    """Fits a model on at most TRAIN_DOCS labelled documents that are not held out (see held_out()), each of them whole.

    Labels other than 0 and 1 and null labels or ids are left out; of an id's labels the larger counts, and of rows that
    repeat an id the one of least text. Feature buckets
    are screened first, by LEAST_DOCS and EVIDENCE; then the likelihood with an L2 penalty is made large by L-BFGS, whose
    gradients tasks sum up. What comes to the driver is the list of screened buckets and a number for each from each
    task, whatever the texts' lengths. Without a toxic and a clean label there is nothing to learn; every score is 0.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).alias("l_id")).agg(F.max(label_col).cast("int").alias("label"))
    known = known.orderBy(F.xxhash64("l_id"), "l_id").limit(TRAIN_DOCS)
    text = F.coalesce(F.col(text_col), F.lit("")).alias("text")
    rows = docs.select(F.col(id_col).alias("d_id"), text).join(F.broadcast(known), F.col("d_id") == F.col("l_id"))
    rows = rows.groupBy("l_id").agg(F.min(F.struct("label", "text")).alias("row")).select("row.label", "row.text")
    rows = materialise(rows, "toxicity-sample")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, bad = (np.zeros(1 << grams.BITS, np.int32) for _ in range(2))
        n = toxic = 0
        for b in batches:
            label, texts = b.column(0).to_pylist(), b.column(1)
            for i, _, told in grams.by_sentence(texts.to_pylist()):
                distinct = np.unique(np.concatenate([f for f, _ in told]))
                seen[distinct] += 1
                bad[distinct] += label[i]
                n, toxic = n + 1, toxic + label[i]
        found = np.flatnonzero(seen)
        arrays = [np.append(found, -1), np.append(seen[found], n), np.append(bad[found], toxic)]
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()) for a in arrays], names=["f", "n", "bad"])

    found = rows.mapInArrow(counted, "f bigint, n bigint, bad bigint").groupBy("f").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    found = materialise(found, "toxicity-features")
    total = found.where("f = -1").first()
    if not total or not 0 < total.bad < total.n:
        discard(rows, found)
        return Model(float("-inf"), np.empty(0, np.int64), np.empty(0, np.float32))
    p = total.bad / total.n
    z = F.abs(F.col("bad") - F.col("n") * p) / F.sqrt(F.col("n") * p * (1 - p))
    kept = np.sort(np.array([r.f for r in found.where(F.col("f") >= 0).where(F.col("n") >= LEAST_DOCS).where(z > EVIDENCE).select("f").collect()], np.int64))
    shared = docs.sparkSession.sparkContext.broadcast(kept)  # 2 ** grams.BITS numbers at most

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        column = np.full(1 << grams.BITS, -1, np.int32)
        column[shared.value] = np.arange(len(shared.value))
        for b in batches:
            label, out = b.column(0).to_pylist(), ([], [], [], [])
            for i, n, told in grams.by_sentence(b.column(1).to_pylist()):
                nth = _words_only(told, n)
                hit, place = (np.concatenate(x) for x in zip(*((column[f], nth[of]) for f, of in told)))
                some = hit >= 0
                for held, v in zip(out, (label[i], int(nth.max(initial=-1)) + 1, hit[some], place[some].astype(np.int32))):
                    held.append(v)
            kinds = (pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds)], names=["label", "told", "hit", "place"])

    bag = materialise(rows.mapInArrow(bags, "label int, told int, hit array<int>, place array<int>"), "toxicity-bags")
    sentences = bag.agg(F.sum("told")).first()[0]

    def work(w: np.ndarray, batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        out = np.zeros(len(w) + 1)
        for b in batches:
            arrays = [[x.values.to_numpy() for x in b.column(i)] for i in (2, 3)]
            out += loss(w, b.column(0).to_pylist(), b.column(1).to_pylist(), *arrays)
        return out

    def penalised(w: np.ndarray) -> tuple[float, np.ndarray]:
        got = summed(bag, work, w) / total.n
        slopes = np.append(w[:-1], 0.0)
        return got[0] + l2 / 2 * float(slopes @ slopes), got[1:] + l2 * slopes

    w = minimise(penalised, np.append(np.zeros(len(kept)), np.log(total.bad / max(1, sentences))))
    discard(rows, found, bag)
    return Model(float(w[-1]), kept, w[:-1].astype(np.float32))


def score(docs: DataFrame, model: Model, text_col: str = "text", locate: bool = False, score_col: str = "score") -> DataFrame:
    """`docs` with a score, and with `sentences` if they are to be located: `start, end, score` of those of 0.5 or more.

    The score is 1 - prod(1 - p) over all sentences of the whole text; null and empty texts and texts without words have
    0. `start` and `end` count characters. Only the text is looked at. Columns of `docs` with the new names are replaced.
    """
    new = [(score_col, "double", pa.float64())]
    if locate:
        new.append(("sentences", "array<struct<start:int,end:int,score:double>>", SPANS))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 ** grams.BITS numbers at most

    def make():
        table, bias = shared.value.table(), shared.value.bias

        def work(texts: list[str]) -> list[list]:
            scores, spans = [], []
            for i, z, has in grams.sums(texts, table):
                bad = np.where(has, _softplus(z + bias), 0.0)
                scores.append(float(-np.expm1(-bad.sum())))
                if locate:
                    spans.append(_located(texts[i], -np.expm1(-bad)) if scores[-1] >= 0.5 else [])
            return [scores, spans] if locate else [scores]

        return work

    return with_columns(docs, F.col(text_col), make, new)


def _located(text: str, p: np.ndarray) -> list[dict]:
    stops = [m.start() for m in re.finditer(f"[{re.escape(grams.ENDS)}]", text)]
    return [{"start": stops[k - 1] + 1 if k else 0, "end": stops[k] if k < len(stops) else len(text), "score": float(p[k])} for k in np.flatnonzero(p >= 0.5).tolist()]


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`doc_id, held_out, score, predicted, offending` per row; `offending` are the sentences of 0.5 or more."""
    got = score(docs.select("doc_id", "text"), train(docs, labels), locate=True)
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), F.col("sentences").alias("offending"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that score under THRESHOLD, with the columns of `docs`. Cases as in train() and score()."""
    s = clashless(docs, "toxicity")
    return score(docs, train(docs, labels), score_col=s).where(F.col(s) < THRESHOLD).select(columns(docs))
