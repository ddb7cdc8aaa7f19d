import random
import re

import numpy as np
import pytest

from voxelith.llm import ngram_join as N

SCHEMA = "doc_id bigint, text string, node int, `label` string, `x.y` int"


def corpus(seed=3, sizes=(6, 12, 30, 60, 150, 400)):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(3))
    passage = [word() for _ in range(55)]
    out = []
    for n in sizes:
        b = [word() for _ in range(n)]
        for _ in range(22):  # from near copies to loosely similar ones
            t = list(b)
            for _ in range(rnd.choice([0, 1, 1, 2, 4, 8])):
                t[rnd.randrange(len(t))] = word()
            cut = rnd.randrange(1 + n // 8)
            out.append(" ".join(t[cut:] if rnd.random() < 0.5 else t + [word() for _ in range(cut)]))
    out += [" ".join([word() for _ in range(rnd.randrange(40))] + passage + [word() for _ in range(rnd.randrange(40))]) for _ in range(40)]
    out += [" ".join(word() for _ in range(50)) for _ in range(20)]
    out += [out[0]] * 30 + [out[0].upper().replace(" ", "\t\n"), "one two", "One\x0btwo", "one, two", "one two three", "one two three four", "", None, "  \n", "w " * 30_000, "w " * 30_000 + "v", "ÀB ²", "àb ²", "́", "x y", "x y"]
    return [(i * 2, t, 1, "clash", 1) for i, t in enumerate(out)] + [(4, out[2], 1, "repeated", 1), (4, "another text of that id", 1, "", 1), (None, out[9], 1, None, 1), (None, "nameless text here", 1, None, 1)] * 2


def brute(data, width=4, percent=85):
    sets = []
    for r in data:
        w = [x for x in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or "")) if x]
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    up = list(range(len(data)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                up[root(i)] = root(j)
    least = {}
    for i, r in enumerate(data):
        ids = [x for x in (least.get(root(i)), r[0]) if x is not None]
        least[root(i)] = min(ids) if ids else None
    return sorted([(r[0], len(s), least[root(i)]) for i, (r, s) in enumerate(zip(data, sets))], key=repr)


@pytest.mark.parametrize(("part", "seed"), [(500, 3), (2, 4)])
def test_equals_all_pairs(spark, monkeypatch, part, seed):
    monkeypatch.setattr(N, "PART_ROWS", part)
    if part == 2:
        monkeypatch.setattr(N, "bounded", lambda df, rows=0: df)
    data = corpus(seed)
    got = N.join_report(spark.createDataFrame(data, SCHEMA).repartition(5))
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(data)


@pytest.mark.parametrize(("width", "percent"), [(1, 60), (2, 95)])
def test_other_parameters(spark, width, percent):
    data = corpus(5, (12, 60))
    got = N.join_report(spark.createDataFrame(data, SCHEMA).repartition(3), width=width, percent=percent)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(data, width, percent)


@pytest.mark.parametrize("percent", [60, 85, 95])
def test_linked_sets_share_a_tile_and_bitmaps_let_them_be(percent):
    rng = np.random.default_rng(1)
    bands = N.Bands(percent)
    for _ in range(1500):
        n = int(rng.integers(1, rng.choice([12, 60, 900])))
        s = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        gone = int(rng.integers(0, 1 + N.most_apart(n, n, percent)))
        new = int(rng.integers(0, 1 + N.most_apart(n, n, percent)))
        t = np.unique(np.concatenate([rng.permutation(s)[: n - gone], rng.integers(0, 2**63, new).astype(np.uint64)]))
        common = len(np.intersect1d(s, t))
        if len(t) and 100 * common >= percent * (len(s) + len(t) - common) and (len(s) != len(t) or (s != t).any()):
            assert len(np.intersect1d(N.tile_keys(s, bands), N.tile_keys(t, bands)))
            differ = int(np.bitwise_count((N.bitmap(s) ^ N.bitmap(t)).view(np.uint64)).sum())
            assert differ <= len(s) + len(t) - 2 * common


def test_bands_meet():
    bands = N.Bands(85)
    for n in range(1, 3000):
        b = bands.of(n)
        assert bands.low(b) <= n < bands.low(b + 1)
        assert bands.of(n * 100 // 85) in bands.homes(n) + [b]


def test_no_rows(spark):
    assert N.join_report(spark.createDataFrame([], SCHEMA)).count() == 0
    assert N.join_report(spark.createDataFrame([(1, None, 1, "", 1)], SCHEMA)).collect() == [(1, 0, 1)]
