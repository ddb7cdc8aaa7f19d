import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest

from voxelith.llm import alignment as A

BPE, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id bigint, text string, keys int, `n` string, `x.y` int"
ODD = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "a\n b", "a \n b\n\n  c", "\n", "x  y", "x　　 y", "tab\t two\x0b \x1c z", "don't we'll 'S it's", "▁", "a ▁b", "▁▁ c",
    "<|endoftext|> <s> </s> <0x41> <unk>", "naïve Straße 日本語 текст", "🙂🙂 👩‍👩‍👧 é", "\x00 \x7f\x85 ​ ﻿", "1234567890 3.14 -- ... !!!", "a" * 3000, "ab " * 2000, "́́ ‍",
]


def corpus():
    rnd = random.Random(2)
    letters = "abcdeéßñ日本🙂'.,-1 23 \n\t   "
    out = ODD + ["".join(rnd.choice(letters) for _ in range(rnd.randrange(80))) for _ in range(300)]
    out += ["the quick brown fox jumps over " + rnd.choice(["it", "the dog", "us all"]) for _ in range(60)]
    return [(i, t, 1, "clash", 2) for i, t in enumerate(out)] + [(None, "the fox", 1, None, 2)] * 3


def whole(data):
    """Each text encoded whole by the libraries, grouped and linked token by token."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(BPE), sentencepiece.SentencePieceProcessor(model_file=PIECE)
    a.encode_special_tokens = True
    alphabet = A.byte_alphabet()
    rows = []
    for doc_id, text, *_ in data:
        given = (" " + (text or "")).encode()
        x = a.encode(given.decode(), add_special_tokens=False).ids
        y = b.encode(text or "")
        ax = [bytes(alphabet[c] for c in a.id_to_token(i)) for i in x]
        by = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
        if not text or not b"".join(ax) == given == b"".join(by):
            rows.append((doc_id, None))
            continue
        ends = lambda parts: [sum(map(len, parts[: i + 1])) for i in range(len(parts))] if len(parts) < 500 else list(__import__("itertools").accumulate(map(len, parts)))
        ea, eb = ends(ax), ends(by)
        cuts = sorted(set(ea) & set(eb))
        groups = {c: ([], []) for c in cuts}
        for side, ids, es in ((0, x, ea), (1, y, eb)):
            it = iter(cuts)
            c = next(it)
            for i, e in zip(ids, es):
                while e > c:
                    c = next(it)
                groups[c][side].append(i)
        rows.append((doc_id, [groups[c] for c in cuts]))
    held, highest = Counter(), defaultdict(int)
    for _, gs in rows:
        held.update({(i, j) for p, q in gs or [] for i in p for j in q})
    for (i, _), n in held.items():
        highest[i] = max(highest[i], n)
    out = []
    for doc_id, gs in rows:
        links = [(i, j) for p, q in gs or [] for i in p for j in q]
        shown = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in gs or [])
        digest = hashlib.sha256(shown.encode()).hexdigest() if gs else ""
        best = sum(held[k] == highest[k[0]] for k in links)
        out.append((doc_id, sum(len(p) for p, _ in gs or []), sum(len(q) for _, q in gs or []), len(gs or []), len(links), best, sum(held[k] for k in links), digest))
    return out


def order(rows):
    return sorted(map(tuple, rows), key=repr)


@pytest.mark.parametrize(("common", "cache", "links"), [(1 << 20, 150_000, 1 << 16), (40, 20, 3), (0, 0, 1)])
def test_equals_whole_texts_aligned_link_by_link(spark, monkeypatch, common, cache, links):
    monkeypatch.setattr(A, "CACHE", cache)
    monkeypatch.setattr(A, "GROUP_LINKS", links)
    data = corpus()
    docs = spark.createDataFrame(data, SCHEMA).repartition(3)
    got = A.align_report(docs, BPE, PIECE, common=common)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert order(got.collect()) == order(whole(data))


def test_stretches_are_encoded_as_in_their_text(monkeypatch):
    monkeypatch.setattr(A, "GROUP_LINKS", 2)
    model = A.Aligner(BPE, PIECE)
    rnd = random.Random(7)
    for _ in range(3000):
        text = "".join(rnd.choice("ab zé'\n\t   \x1c\x85​1.s日🙂") for _ in range(rnd.randrange(1, 14)))
        stretches = model.stretches(text)
        assert " " + " ".join(stretches) == " " + text
        a, b = model._encoded(stretches)
        assert sum(a, []) == model.a.encode(" " + text, add_special_tokens=False).ids, text
        assert sum(b, []) == model.b.encode(text), text


def test_a_very_large_group_is_not_expanded_token_by_token(monkeypatch):
    monkeypatch.setattr(A, "GROUP_LINKS", 10)
    model = A.Aligner(BPE, PIECE)
    text = "🙂" * 20_000
    n_a, n_b, n_groups, n_links, _, keys, many = (c[0] for c in model.texts([text]))
    assert n_links == many.sum() and len(keys) < 100 and n_a and n_b and n_groups


def test_no_rows(spark):
    assert A.align_report(spark.createDataFrame([], SCHEMA), BPE, PIECE).count() == 0
    assert A.align_report(spark.createDataFrame([(1, None, 1, "", 1)], SCHEMA), BPE, PIECE).collect() == [(1, 0, 0, 0, 0, 0, 0, "")]
