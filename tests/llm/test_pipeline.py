"""The pipeline on a small fixture against plain loops, and the registered queries' SQL on a small table."""

import random
import re

import duckdb
import pytest
import sentencepiece

import corpus_pipeline
from voxelith.llm.queries import QUERIES, SQL, public_tokenizer


def fixture(path, spark):
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    docs, labels = [], []
    for i in range(300):
        words = [word() for _ in range(40)]
        if i % 6 == 0:
            words[9] = words[20] = "zoundish"
        docs.append((i, " ".join(words) + ".", "en", f"s{i % 5}", len(words)))
        labels.append((i, 1, int(i % 6 == 0)))
    near = docs[7][1].split()
    near[-1] = "changed"
    docs += [(400, docs[7][1].upper(), "en", "s1", 1), (401, " ".join(near), "en", "s1", 1), (402, docs[8][1], "en", None, 1), (403, None, "en", "s0", 0), (404, "", "en", "s0", 0)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return docs


def test_stages_take_effect(spark, tmp_path):
    docs = fixture(tmp_path, spark)
    d, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    columns = d.columns
    for name, stage in corpus_pipeline.STAGES:
        d = stage(spark, d, str(tmp_path))
        d.write.parquet(f"{tmp_path}/{name.replace(' ', '_')}")
        d = spark.read.parquet(f"{tmp_path}/{name.replace(' ', '_')}")
        seen.append(d)
        assert d.columns == columns or name == "encoding"
    ids = [{r.doc_id for r in s.select("doc_id").collect()} for s in seen]
    toxic = {i for i in range(300) if i % 6 == 0}
    assert len(ids[0] & toxic) <= 2 and len({x[0] for x in docs} - toxic - ids[0]) <= 2
    # 400 is an upper-case copy of 7 and 402 a copy of 8; of the empty texts 404 stays.
    assert ids[0] - ids[1] == {7, 8, 403}
    assert ids[1] - ids[2] == {401}  # near 400
    words = lambda s: sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in s.collect())
    assert 0 <= words(seen[2]) - words(seen[3]) <= 40
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizer("piece_bpe_32k.model"))
    want = sorted((r.doc_id, tuple(lib.encode(r.text or ""))) for r in seen[3].collect())
    assert sorted((r.doc_id, tuple(r.ids)) for r in seen[4].collect()) == want


CLASHING = "doc_id bigint, text string, source string, toxicity int, rn int, text_sha256 string, text_md5 string, k_id int, copies string, mix_id int, `a.b` int, text_in int"


def test_stages_of_odd_and_empty_tables(spark, tmp_path):
    """Null ids, texts and sources, repeated rows, columns with the stages' own names; then no rows at all."""
    fixture(tmp_path, spark)
    text = "an odd text of some seven words"
    rows = [(None, text, None), (None, text, None), (1, None, "s"), (2, "", "s"), (3, text.upper(), None), (4, "word " * 50_000, "s"), (5, "other words, said but once", "s")]
    odd = spark.createDataFrame([(*r, 1, 2, "x", "y", 3, "z", 4, 5, 6) for r in rows], CLASHING)
    ids = []
    for d in (odd, odd.where("false")):
        for name, stage in corpus_pipeline.STAGES:
            path = f"{tmp_path}/{len(ids)}"
            stage(spark, d, str(tmp_path)).write.parquet(path)
            d = spark.read.parquet(path)
            assert name == "encoding" or d.columns == odd.columns
            ids.append(sorted((str(r.doc_id) for r in d.select("doc_id").collect())))
    assert ids[0] == sorted(["None", "None", "1", "2", "3", "4", "5"])
    assert ids[1] == ids[2] == ["2", "3", "4", "5"]  # of the empty texts 2 stays, of the odd ones 3
    assert ids[3] and set(ids[3]) <= {"3", "4", "5"}  # 4 alone is longer than the share of its source
    assert ids[4] == ids[3] and ids[5:] == [[]] * 5


def test_run_gives_the_last_stage(spark, tmp_path):
    fixture(tmp_path, spark)
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.count() > 200 and {"doc_id", "ids", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(got.columns)


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql_gives_the_same_rows(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    got = QUERIES[name](spark, sf)
    want = con.sql(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    text = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    assert sorted([text(r[c]) for c in order] for r in got.collect()) == sorted([text(v) for v in r] for r in want.select(*order).fetchall())
