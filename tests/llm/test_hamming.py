import random

import pytest
from pyspark.sql import functions as F

from voxelith.llm import hamming
from voxelith.llm.hamming import sign_code, top_k


def brute(rows, queries, k):
    out = []
    for q, c in queries:
        if c is not None:
            near = sorted((bin((c ^ x) & (2**64 - 1)).count("1"), i) for i, x in rows if x is not None)[:k]
            out += [(q, n + 1, i, d) for n, (d, i) in enumerate(near)]
    return sorted(out)


def signed(x):
    return x - 2**64 if x >= 2**63 else x


@pytest.mark.parametrize("n", [1, 7, 400])
def test_equals_brute_force(spark, n):
    rnd = random.Random(n)
    rows = [(i, signed(rnd.getrandbits(64))) for i in range(n)]
    rows += [(1000 + i, rows[0][1]) for i in range(25)]  # one very common code
    rows += [(2000 + i, rows[-1][1] ^ (1 << i)) for i in range(20)] + [(3000, None), (5, rows[0][1])]
    queries = [r for r in rows if r[0] % 5 == 0]
    df = spark.createDataFrame(rows, "id bigint, code bigint")
    got = top_k(df, df.where("id % 5 = 0"), 10)
    assert got.columns == ["query_id", "rank", "id", "distance"]
    assert sorted(map(tuple, got.collect())) == brute(rows, queries, 10)


def test_short_codes_and_empty_tables(spark):
    rows = [(i, i * 37 % 4096) for i in range(200)]
    df = spark.createDataFrame(rows, "id bigint, code bigint")
    assert sorted(map(tuple, top_k(df, df.limit(20), 5, bits=12).collect())) == brute(rows, rows[:20], 5)
    assert top_k(df.where("false"), df).count() == 0
    assert top_k(df, df.where("false")).count() == 0


def test_sign_code(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([([1.0, -1.0, None, 0.5],), ([],), (None,)], "e array<float>")
    assert [r[0] for r in df.select(sign_code(F.col("e"))).collect()] == [0b1001, 0, None]


def test_codes_of_odd_embeddings(spark):
    df = spark.createDataFrame([(1, None), (2, []), (3, [1.0, None, -1.0]), (4, [0.5] * 64)], "id bigint, e array<double>")
    assert [r[0] for r in df.orderBy("id").select(sign_code(F.col("e"))).collect()] == [None, 0, 4, -1]
    with pytest.raises(Exception, match="64 bits"):
        spark.createDataFrame([([1.0] * 65,)], "e array<double>").select(sign_code(F.col("e"))).collect()


def test_null_codes_and_other_columns_through_the_search(spark):
    rows = spark.createDataFrame([(1, 5, "a"), (2, None, "b"), (None, 5, "c"), (3, 4, "d"), (3, 4, "d")], "id bigint, code bigint, q string")
    got = top_k(rows, rows, 3).collect()
    of = lambda q: sorted((r["rank"], str(r.id), r.distance) for r in got if r.query_id == q)
    assert of(1) == of(None) == [(1, "1", 0), (2, "None", 0), (3, "3", 1)] and of(2) == []
    assert of(3) == sorted([(1, "3", 0), (2, "3", 0), (3, "1", 1)] * 2)


def test_probes_are_all_masks_of_a_distance(spark, monkeypatch):
    monkeypatch.setattr(hamming, "MASKS", 7)
    monkeypatch.setattr(hamming, "NUMBERS", 16)
    active = spark.createDataFrame([(-5, None), (77, 3)], "q bigint, kth int")
    for radius in (0, 1, 3):
        got = hamming._probes(active, [(0, 6), (58, 6)], radius).collect()
        want = {(i, q >> shift & 63 ^ m, q, kth) for i, shift in ((0, 0), (1, 58)) for q, kth in ((-5, None), (77, 3)) for m in range(64) if bin(m).count("1") == radius}
        assert {tuple(r) for r in got} == want and len(got) == len(want)
