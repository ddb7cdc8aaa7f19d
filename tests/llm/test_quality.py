import math
import random

import numpy as np
from pyspark.sql import functions as F

from voxelith.llm.quality import Model, loss, quality_report, rating, score, train


def corpus():
    rnd = random.Random(8)
    docs, labels = [], []
    for i in range(900):
        grade = i % 3
        words = [rnd.choice(["fair", "plain", "calm", "text"]) for _ in range(60)]
        for _ in range(12 * (2 - grade)):  # the worse, the more junk
            words[rnd.randrange(60)] = "###"
        docs.append((i, " ".join(words), 0.5))
        labels.append((i, int(grade > 0), int(grade == 1)))
    return docs, labels


def test_grades_of_held_out_documents(spark):
    docs, labels = corpus()
    d = spark.createDataFrame(docs, "doc_id bigint, text string, expected_grade double")
    got = [r for r in quality_report(d, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")).collect()]
    assert len(got) == len(docs)
    tested = [r for r in got if r.held_out]
    means = [np.mean([r.expected_grade for r in tested if r.doc_id % 3 == g]) for g in range(3)]
    assert means[0] < 0.5 < means[1] < 1.5 < means[2]
    assert sum(r.selected == (r.doc_id % 3 > 0) for r in tested) >= 0.95 * len(tested)


def test_edge_cases(spark):
    docs, _ = corpus()
    d = spark.createDataFrame(docs[:30], "doc_id bigint, text string, tails double")
    none = train(d, spark.createDataFrame([(1, None), (None, 2.0)], "doc_id bigint, rating double"))
    assert {r.expected_grade for r in score(d, none).collect()} == {0.0}
    one = train(d, spark.createDataFrame([(0, 4.0), (2, 4.0), (3, 4.0), (5, 4.0)], "doc_id bigint, rating double"))
    assert {r.expected_grade for r in score(d, one).collect()} == {4.0}
    m = Model(np.zeros(1 << 18, np.float32), np.array([-1.0, 1.0]), [0.0, 1.0, 3.0])
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "x " * 100_000)], "doc_id bigint, text string")
    for r in score(odd, m).collect():
        assert list(r.tails) == sorted(r.tails, reverse=True) and 0 < r.expected_grade < 3
    assert score(odd.where("false"), m).count() == 0


def test_rating(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 0), (None, 0), (1, None)], "q int, t int")
    assert [r[0] for r in df.select(rating(F.col("q"), F.col("t"))).collect()] == [0, 0, 1, 2, None, None]


def plain_loss(p, used, grade, vectors):
    """The loss of a document at a time, by its definition."""
    cuts = [p[len(used)]]
    for g in p[len(used) + 1 :]:
        cuts.append(cuts[-1] + math.exp(g))
    at_least = lambda j, z: 1.0 if j == 0 else 0.0 if j > len(cuts) else 1 / (1 + math.exp(cuts[j - 1] - z))
    out = 0.0
    for y, (at, value) in zip(grade, vectors):
        z = sum(p[list(used).index(a)] * v for a, v in zip(at, value))
        out -= math.log(at_least(y, z) - at_least(y + 1, z))
    return out


def test_loss_and_gradient_equal_plain_ones():
    rng = np.random.default_rng(4)
    used = np.array([3, 5, 8, 9])
    vectors = [(rng.choice(used, n, replace=False), rng.random(n)) for n in rng.integers(0, 5, 30)]
    grade, p = rng.integers(0, 3, 30), rng.normal(size=6)
    got = loss(p, used, grade, vectors)
    assert math.isclose(got[0], plain_loss(p, used, grade, vectors), rel_tol=1e-9)
    for k in range(6):
        step = np.eye(6)[k] * 1e-5
        slope = (plain_loss(p + step, used, grade, vectors) - plain_loss(p - step, used, grade, vectors)) / 2e-5
        assert math.isclose(got[1 + k], slope, rel_tol=1e-4, abs_tol=1e-6)


def test_long_rated_documents_are_learned_from(spark):
    rnd = random.Random(2)
    docs = [(i, " ".join([*(str(rnd.random()) for _ in range(4000)), *["good" if i % 2 else "bad"] * 400])) for i in range(40)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    model = train(d, spark.createDataFrame([(i, float(i % 2)) for i, _ in docs], "doc_id bigint, rating double"))
    got = {r.doc_id: r.expected_grade for r in score(spark.createDataFrame([(1, "good"), (2, "bad")], "doc_id bigint, text string"), model).collect()}
    assert got[1] > 0.7 > 0.3 > got[2]
