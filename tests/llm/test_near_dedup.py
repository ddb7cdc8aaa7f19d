import random
import re
from collections import Counter

import numpy as np
import pytest

from voxelith.graphs import components
from voxelith.llm import near_dedup
from voxelith.llm.dart_minhash import signatures
from voxelith.llm.near_dedup import drop_near_duplicates, near_report

SCHEMA = "doc_id bigint, text string, node int, `label` string, `x.y` int"


@pytest.mark.parametrize(("n", "share"), [(1, 1.0), (3, 0.5), (300, 0.8), (5000, 0.6)])
def test_signatures_agree_as_often_as_sets_are_similar(n, share):
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**63, n).astype(np.uint64)
    c = round(2 * n * share / (1 + share))
    b = np.concatenate([a[:c], rng.integers(0, 2**63, n - c).astype(np.uint64)])
    s = signatures(np.concatenate([a, b]), np.repeat([0, 1], n), 2, 4000)
    assert abs((s[0] == s[1]).mean() - c / (2 * n - c)) < 0.04


def test_weighted_signatures():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 100).astype(np.uint64)
    w, x = rng.uniform(0.1, 9, 100), rng.uniform(0.1, 9, 100)
    s = signatures(np.concatenate([a, a]), np.repeat([0, 1], 100), 2, 4000, np.concatenate([w, x]))
    assert abs((s[0] == s[1]).mean() - np.minimum(w, x).sum() / np.maximum(w, x).sum()) < 0.04


def corpus():
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(4))
    out, base = [], [[word() for _ in range(n)] for n in (60, 150, 400)]
    for b in base:
        for _ in range(25):  # from near copies to loosely similar ones
            t, edits = list(b), rnd.choice([0, 1, 2, 4, 8, 16])
            for _ in range(edits):
                t[rnd.randrange(len(t))] = word()
            out.append(" ".join(t))
    out += [" ".join(word() for _ in range(50)) for _ in range(40)]
    out += [out[0]] * 30 + [out[0].upper().replace(" ", ", ")] + ["one two", "One, two!", "one two three", "", None, "...", "w " * 30_000, "w " * 30_000 + "v"]
    return [(i * 2, t, 1, "clash", 1) for i, t in enumerate(out)] + [(4, out[2], 1, "repeated", 1), (None, "nameless text here", 1, None, 1)]


def brute(data):
    sets = []
    for r in data:
        w = re.findall(r"\w+", (r[1] or "").lower())
        sets.append(Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter())
    up = list(range(len(data)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(data)):
        for j in range(i):
            if sets[i] and sets[j] and (sets[i] & sets[j]).total() >= 0.8 * (sets[i] | sets[j]).total():
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    groups = {}
    for i in range(len(data)):
        groups.setdefault(root(i), []).append(data[i][0])
    return sorted((str(i), str(min((x for x in g if x is not None), default=None)), len(g)) for g in groups.values() for i in g)


def test_classes_equal_brute_force(spark):
    data = corpus()
    got = near_report(spark.createDataFrame(data, SCHEMA).repartition(4)).collect()
    assert sorted((str(r.doc_id), str(r.class_id), r.class_size) for r in got) == brute(data)
    assert sum(r.kept for r in got) == len({(str(r.class_id), r.class_size if r.class_id is None else 0) for r in got})


def test_one_row_of_each_class_stays(spark):
    data = corpus()
    df = spark.createDataFrame(data, SCHEMA)
    got = drop_near_duplicates(df)
    assert got.columns == df.columns
    assert sorted(str(r.doc_id) for r in got.collect()) == sorted({c for _, c, _ in brute(data)})


def test_empty_table_and_texts_without_words(spark):
    assert near_report(spark.createDataFrame([], SCHEMA)).count() == 0
    none = spark.createDataFrame([(1, "", 1, "", 1), (2, None, 1, "", 1), (3, "?", 1, "", 1)], SCHEMA)
    assert {(r.doc_id, r.class_id, r.class_size, r.kept) for r in near_report(none).collect()} == {(i, i, 1, True) for i in (1, 2, 3)}


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_small_groups_and_shuffled_ids_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "PART_ROWS", 2)
    monkeypatch.setattr(near_dedup, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(near_dedup, "SUPPORT", 0.02)
    data = corpus()
    got = near_report(spark.createDataFrame(data, SCHEMA).repartition(3), bands=40, rows=3).collect()
    assert sorted((str(r.doc_id), str(r.class_id), r.class_size) for r in got) == brute(data)


def test_repeats_weigh(spark):
    once, twice = "a b c d e f g h i j", "k l m n o p q r s t"
    docs = [(1, f"{once} {twice} {twice}"), (2, f"{once} {twice}"), (3, f"{once} {twice} {twice} u"), (4, "w " * 500), (5, "w " * 500 + "v")]
    got = {r.doc_id: r.class_id for r in near_report(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 4, 5: 4}


def test_report_and_rows_agree_on_odd_characters(spark):
    rnd = random.Random(8)
    odd = ["́", "²", "١", "Ⅷ", "_", "‍", "ͅ", "ั", "ª", "a", "?", " ", "Ⓐ", "ʼ"]
    data = [(rnd.randrange(40), "".join(rnd.choice(odd) for _ in range(rnd.randrange(5))), 1, "clash", 1) for _ in range(250)]
    data += [(1, "²", 1, "", 1)] * 2 + [(4, "́", 1, "", 1)] * 2
    df = spark.createDataFrame(data, SCHEMA)
    report = near_dedup.near_classes(df).where("kept").groupBy("doc_id", "text_md5").count()
    rows = drop_near_duplicates(df).selectExpr("doc_id", "md5(text) AS text_md5").groupBy("doc_id", "text_md5").count()
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, report.collect()))
