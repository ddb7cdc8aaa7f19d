import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece

from voxelith.llm.pieces import Pieces, decode, encode

PATH = public_tokenizers.path("piece_bpe_32k.model")
ALPHABET = "ab theing éè ▁ \n\t0123.,-<>s/ü中😀éé́ﬁ  x\x00　"


def test_equals_the_library_on_random_texts():
    own, lib = Pieces(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH)
    rnd = random.Random(1)
    for _ in range(3000):
        t = "".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 30)))
        ids = lib.encode(t)
        assert own.encode(t) == ids
        assert own.decode(ids) == own.decode_utf8(own.encode_joined(t)[1]).decode() == lib.decode(ids)


def test_decodes_any_ids_as_the_library_does():
    own, lib = Pieces(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH)
    rnd = random.Random(2)
    for _ in range(3000):
        ids = [rnd.randint(0, 31_999 if rnd.random() < 0.5 else 262) for _ in range(rnd.randint(0, 8))]
        assert own.decode(ids) == lib.decode(ids)


def test_one_span_without_a_cut():
    """Long runs are encoded whole, with backtracking."""
    own, lib = Pieces(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH)
    rnd = random.Random(3)
    for t in ("ab" * 2000, " " * 301, "thethethe" * 300, "".join(rnd.choice("abcdefghinorst") for _ in range(50_000))):
        assert own.encode(t) == lib.encode(t)


def test_rows(spark):
    lib = sentencepiece.SentencePieceProcessor(model_file=PATH)
    big = 2**60 + 1
    texts = ["The thing", None, "", "The thing", "word " * 40_000]
    df = spark.createDataFrame([(big + i, t, 7, i) for i, t in enumerate(texts)], "doc_id bigint, text string, N_TOKENS int, text_in int")
    got = {r.doc_id: r for r in decode(encode(df, PATH, digests=True), PATH).collect()}
    for i, t in enumerate(texts):
        ids, r = lib.encode(t or ""), got[big + i]
        assert (r.n_tokens, list(r.ids), r.text_in) == (len(ids), ids, i)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()
        assert r.decoded == lib.decode(ids)
    assert encode(df.where("false"), PATH).count() == 0


def test_models_that_change_texts_are_refused(monkeypatch):
    class Other(sentencepiece.SentencePieceProcessor):
        def normalize(self, text):
            return text.lower()

    monkeypatch.setattr(sentencepiece, "SentencePieceProcessor", Other)
    with pytest.raises(ValueError, match="changes texts"):
        Pieces(PATH)
