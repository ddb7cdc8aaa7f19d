import random
import re
from collections import Counter, defaultdict

import pytest

from voxelith.llm import divergence as D

SCHEMA = "doc_id bigint, text string, lang string, source string, n int, term string, value int, gid int"


def corpus():
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcde") for _ in range(rnd.choice([1, 2, 2, 3, 4]))) for _ in range(300)] + ["Ä", "日本", "été", "x́", "B"]
    out = []
    for i in range(240):
        k = min(len(words), int(rnd.paretovariate(0.8) * 20))
        own = words[(i % 7) * 30 :] + words
        t = rnd.choice([" ", "\n", "-", "1", "_"]).join(rnd.choice(own[:k]) for _ in range(rnd.randrange(60)))
        out.append((i, t.upper() if i % 9 == 0 else t, ["en", "fr", "de"][i % 11 % 3], "s0" if i % 3 == 0 else f"s{i % 7}"))
    out += [(1, None, "en", "silent"), (2, "", None, "s1"), (3, "a b c", None, None), (4, "a b c", None, None), (5, "c b", "", ""), (6, "...", "xx", "s0"), (7, "only", "xx", None)]
    out += [(None, "a ab abc", "en", "s3")] * 4 + [(9, "de " * 3000, "en", "s0")] * 2
    return [(*r, 7, "clash", 8, 9) for r in out]


def brute(data, min_docs, top):
    term_of = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    docs, count, groups = Counter(), defaultdict(Counter), {}
    for _, text, lang, source, *_ in data:
        lang, source = lang or "", source or ""
        groups.setdefault(lang, set()).add(source)
        ts = term_of(text)
        docs.update((lang, t) for t in set(ts))
        count[lang, source].update(ts)
    out = []
    for lang, sources in groups.items():
        kept = [t for la, t in docs if la == lang and docs[la, t] >= min_docs]
        whole = sum((count[lang, s] for s in sources), Counter())
        prob = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[t] for t in kept) + len(kept)) for t in kept}
        p, q = {s: prob(count[lang, s]) for s in sources}, prob(whole)
        f = lambda a, b: (a - b) * (a - b) // b
        for s in sources:
            found = [(t, f(p[s][t], q[t])) for t in kept if count[lang, s][t] and p[s][t] > q[t]]
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s]
            for part, rows, n in (("term", found, top), ("pair", pairs, None)):
                rows.sort(key=lambda r: (-r[1], r[0].encode()))
                out += [(lang, s, part, item, v, i) for i, (item, v) in enumerate(rows[:n], 1)]
    return sorted(out)


@pytest.mark.parametrize(("min_docs", "top"), [(3, 200), (1, 5), (3, 1)])
def test_equals_brute_force(spark, monkeypatch, min_docs, top):
    monkeypatch.setattr(D, "ENTRIES", 50)
    monkeypatch.setattr(D, "PAIRS", 40)
    monkeypatch.setattr(D, "PIECE", 100)
    data = corpus()
    got = D.divergence(spark.createDataFrame(data, SCHEMA).repartition(5), min_docs=min_docs, top=top)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == brute(data, min_docs, top)


def test_groups_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(D, "bounded", lambda df: df)
    data = corpus()
    assert sorted(map(tuple, D.divergence(spark.createDataFrame(data, SCHEMA)).collect())) == brute(data, 3, 200)


def test_pieces_of_a_long_text_keep_its_terms_whole(monkeypatch):
    monkeypatch.setattr(D, "PIECE", 10)
    text = "Aé" * 40 + " bc" * 50 + "\x00d"
    assert [t.decode() for some in D.terms(text.encode()) for t in some] == ["aé" * 40, *["bc"] * 50, "d"]


def test_counts_of_any_size_are_exact(spark):
    row = spark.createDataFrame([(9 * 10**17, 9 * 10**17 + 7)], "c bigint, t bigint").select(D.share("c", "t")).first()[0]
    assert row == 1 + 10**9 * (9 * 10**17 + 1) // (9 * 10**17 + 7)


def test_no_rows(spark):
    assert D.divergence(spark.createDataFrame([], SCHEMA)).count() == 0
    lone = D.divergence(spark.createDataFrame([(1, "a", "en", "s")], "doc_id int, text string, lang string, source string"))
    assert lone.count() == 0
