import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from voxelith.llm import mixing
from voxelith.llm.mixing import mix, mix_report

SCHEMA = "doc_id bigint, text string, source string, copies int, `x.y` int"


def rows():
    out = [(i, "w " * (1 + i * 7 % 40), f"s{i % 4}" if i % 3 else "hot", 1, i) for i in range(240)]
    return [*out, (900, None, "s1", 0, 0), (901, "", None, 0, 0), (902, "a\x0bb\x1cc", None, 0, 0), (903, "z " * 5000, "s2", 0, 0), (7, "w " * 10, "hot", 0, 0), *((None, "n " * (i % 3), "s3", 0, 0) for i in range(30))]


def brute(data):
    """The same mix, written with loops."""
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    size = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    by = defaultdict(list)
    for r in data:
        by[r[2]].append(r)
    names = sorted(by, key=lambda s: (s is None, s or ""))
    sizes = {s: sum(map(size, by[s])) for s in names}
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    budget, full = sum(sizes.values()), set()
    while True:
        level = (budget - sum(3 * sizes[s] for s in full)) / max(1, sum(weight[s] for s in names if s not in full))
        more = {s for s in names if s not in full and weight[s] * level > 3 * sizes[s]}
        if not more:
            break
        full |= more
    target = {s: 3.0 * sizes[s] if s in full else weight[s] * level for s in names}
    events, out = [], []
    for n, s in enumerate(names):
        upto = 0
        for r in sorted(by[s], key=lambda r: (md5("" if r[0] is None else str(r[0])), r[0] is not None, r[0] or 0, md5(r[1] or ""))):
            upto += size(r)
            out.append([r[0], size(r), sizes[s], target[s], 0])
            if size(r) and target[s]:
                events += [((e * sizes[s] + upto) / target[s], n, upto, len(out) - 1) for e in range(3)]
    taken = 0
    for *_, i in sorted(events):
        taken += out[i][1]
        if taken > budget:
            break
        out[i][4] += out[i][1]
    return sorted(map(tuple, out), key=str)


@pytest.mark.parametrize("bound", [100, 0])
def test_report_equals_brute_force(spark, monkeypatch, bound):
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", bound)
    got = [tuple(r) for r in mix_report(spark.createDataFrame(rows(), SCHEMA).repartition(5)).collect()]
    want = brute(rows())
    assert [g[:3] + g[4:] for g in sorted(got, key=str)] == [w[:3] + w[4:] for w in want]
    assert [g[3] for g in sorted(got, key=str)] == pytest.approx([w[3] for w in want])


def test_each_source_comes_near_its_target(spark):
    got = mix_report(spark.createDataFrame(rows(), SCHEMA)).collect()
    assert all(r.taken <= 3 * r["size"] for r in got)
    by = defaultdict(lambda: [0, 0.0, 0])
    for r in got:
        by[r.target] = [by[r.target][0] + r.taken, r.target, max(by[r.target][2], r["size"])]
    assert all(abs(taken - target) <= longest for taken, target, longest in by.values())


def test_rows_come_as_often_as_they_are_taken(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    got = mix(df)
    assert got.columns == df.columns
    words = sum(len((r.text or "").split()) for r in got.collect() if r.doc_id != 902)
    report = [r for r in mix_report(df).collect() if r.doc_id != 902]
    assert words == sum(r.taken for r in report)


def test_no_words_and_no_rows(spark):
    none = spark.createDataFrame([(1, "", "a", 0, 0), (2, None, None, 0, 0)], SCHEMA)
    assert {(r.target, r.taken) for r in mix_report(none).collect()} == {(0.0, 0)}
    assert mix(none).count() == 0
    assert mix_report(none.where("false")).count() == 0


def test_sources_are_off_their_targets_by_one_document_at_most(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = mix_report(docs).join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("size").alias("longest")).collect()
    assert len(got) > 5
    for r in got:
        assert abs(r.taken - r.target) <= r.longest + 1
