import math
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from voxelith.llm import grams
from voxelith.llm.fitting import minimise
from voxelith.llm.toxicity import drop_toxic, held_out, loss, score, toxicity_report, train

DOCS = "doc_id bigint, text string, score int, sentences int"
LABELS = "doc_id bigint, toxic int"


def corpus():
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    docs, labels = [], []
    for i in range(500):
        told = [[word() for _ in range(8)] for _ in range(rnd.randint(1, 12))]
        toxic = i % 5 == 0
        if toxic:
            rnd.choice(told).insert(3, rnd.choice(["zounds", "quuxish", "Quuxer"]))
        docs.append((i, ". ".join(" ".join(s) for s in told) + ".", 1, 1))
        labels.append((i, int(toxic)))
    return docs, labels


def test_held_out_documents_are_told_apart_and_sentences_found(spark):
    docs, labels = corpus()
    d, la = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)
    got = {r.doc_id: r for r in toxicity_report(d, la).collect()}
    assert len(got) == len(docs)
    tested = [i for i in got if got[i].held_out]
    assert set(tested) == {i for i in got if zlib.crc32(str(i).encode()) % 3 == 1}
    right = sum(got[i].predicted == labels[i][1] for i in tested)
    assert right >= 0.97 * len(tested)
    for i in tested:
        if labels[i][1] and got[i].predicted:
            found = [docs[i][1][s.start : s.end].lower() for s in got[i].offending]
            assert any("quux" in s or "zounds" in s for s in found)


def test_edge_cases(spark):
    docs, labels = corpus()
    d, la = spark.createDataFrame(docs, DOCS), spark.createDataFrame([*labels, (None, 1), (3, None), (4, 7)], LABELS)
    model = train(d, la)
    odd = spark.createDataFrame([(1, None, 0, 0), (2, "", 0, 0), (3, "?!", 0, 0), (3, "?!", 0, 0), (4, "abcd " * 60_000 + "zounds", 0, 0)], DOCS)
    got = score(odd, model, locate=True).collect()
    assert [r.score for r in got if r.doc_id < 4] == [0.0] * 4
    assert next(r for r in got if r.doc_id == 4).score > 0.5
    assert score(odd.where("false"), model).count() == 0
    left = drop_toxic(d, la)
    assert left.columns == d.columns
    ids = {r.doc_id for r in left.collect()}
    assert sum(i in ids for i, y in labels if not y) >= 395 and sum(i in ids for i, y in labels if y) <= 5
    for some in ([], [(1, 0), (2, 0)]):  # nothing to learn
        assert {r.score for r in score(odd, train(d, spark.createDataFrame(some, LABELS))).collect()} == {0.0}


def test_held_out_of_null_is_false(spark):
    assert not spark.createDataFrame([(None,)], "i bigint").select(held_out(F.col("i"))).first()[0]


def plain_loss(w, labels, sentences, hits, places):
    """The loss of a document at a time, by its definition."""
    out = 0.0
    for y, n, hit, place in zip(labels, sentences, hits, places):
        clean = 1.0
        for s in range(n):
            z = w[-1] + sum(w[h] for h, p in zip(hit, place) if p == s)
            clean *= 1 - 1 / (1 + math.exp(-z))
        out -= math.log(1 - clean if y else clean)
    return out


def bags(seed):
    rng = np.random.default_rng(seed)
    labels, sentences, hits, places = [], [], [], []
    for i in range(40):
        n = int(rng.integers(1, 6))
        place = np.sort(rng.integers(0, n, rng.integers(1, 12)))
        hit = rng.integers(0, 5, len(place))
        labels.append(int((hit == 0).any()) if i % 7 else 1 - int((hit == 0).any()))
        sentences.append(n)
        hits.append(hit)
        places.append(place)
    return labels, sentences, hits, places


def test_loss_and_gradient_equal_plain_ones():
    told = bags(0)
    w = np.random.default_rng(1).normal(size=6)
    got = loss(w, *told)
    assert math.isclose(got[0], plain_loss(w, *told), rel_tol=1e-9)
    for k in range(6):
        step = np.eye(6)[k] * 1e-5
        slope = (plain_loss(w + step, *told) - plain_loss(w - step, *told)) / 2e-5
        assert math.isclose(got[1 + k], slope, rel_tol=1e-4, abs_tol=1e-6)


def test_minimum_equals_that_of_plain_descent():
    told = bags(2)
    f = lambda w: (plain_loss(w, *told) / 40 + 0.005 * w[:-1] @ w[:-1])
    g = lambda w: loss(w, *told)[1:] / 40 + 0.01 * np.append(w[:-1], 0)
    slow = np.zeros(6)
    for _ in range(4000):
        slow -= 0.5 * g(slow)
    fast = minimise(lambda w: (f(w), g(w)), np.zeros(6), 100)
    assert np.allclose(fast, slow, atol=0.02) and f(fast) <= f(slow) + 1e-6


def test_long_labelled_documents_are_learned_from(spark):
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdefghijkl") for _ in range(6))
    docs = []
    for i in range(60):
        told = [[word() for _ in range(10)] for _ in range(600)]
        if i % 2:
            rnd.choice(told)[4] = "quuxish"
        docs.append((i, ". ".join(" ".join(s) for s in told)))
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    model = train(d, spark.createDataFrame([(i, i % 2) for i, _ in docs], LABELS))
    assert len(model.buckets) and np.isfinite(model.bias)
    got = {r.doc_id: r.score for r in score(spark.createDataFrame([(1, "here is quuxish talk"), (2, "here is plain talk")], "doc_id bigint, text string"), model).collect()}
    assert got[1] > 0.5 > got[2]


def test_grams_by_sentence():
    long = "abc defg. " * 30_000 + "x" * 200_000 + " tail! end"
    texts = ["One word. Two", "", long, "?!\n", "\U0001f600 é_1 ab"]
    weights = np.random.default_rng(3).random(1 << grams.BITS).astype(np.float32)
    whole = {i: (n, told) for i, n, told in grams.by_sentence(texts)}
    assert [whole[i][0] for i in range(5)] == [1 + len(re.findall(r"[.!?\n]", t)) for t in texts]
    for i, z, has in grams.sums(texts, weights):
        n, told = whole[i]
        assert np.allclose(z, sum(np.bincount(of, weights[b], n) for b, of in told))
        assert has.tolist() == [bool(re.search(r"\w", s)) for s in re.split(r"[.!?\n]", texts[i])]
    of = lambda t: sorted(np.concatenate([b for b, _ in next(grams.by_sentence([t]))[2]]).tolist())
    assert of("abcd") == of("ABCD,") and len(of("abcd")) == 3 + 2 + 1  # ^abc abcd bcd$, ^abcd abcd$, the word
    assert set(of("ab abcd")) == set(of("ab")) | set(of("abcd"))


def test_features_of_a_long_word_do_not_depend_on_its_place():
    words = lambda t: set(np.concatenate([told[-1][0] for _, _, told in grams.by_sentence([t])]).tolist())
    for size in (3000, grams.PIECE - 5, 2 * grams.PIECE + 77):
        long = "".join(random.Random(size).choices("abcdefgh", k=size))
        told = [words("ab " * n + long + " cd") for n in (1, 40_000, 43_600, 44_000, 65_000, 90_001)]
        assert all(t == told[0] for t in told) and len(told[0]) == 3 + (size - 1) // grams.PIECE
