"""The registered queries of this package: name to function of (spark, sf_dir), and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelith.llm.alignment import align_report
from voxelith.llm.divergence import divergence
from voxelith.llm.exact_dedup import dedup_report
from voxelith.llm.hamming import sign_code, top_k
from voxelith.llm.mixing import mix_report
from voxelith.llm.near_dedup import near_report
from voxelith.llm.ngram_join import join_report
from voxelith.llm.pieces import encode
from voxelith.llm.preference import format_preferences, pair_records, reply_pairs
from voxelith.llm.quality import quality_report
from voxelith.llm.sharding import assign_shards
from voxelith.llm.toxicity import toxicity_report
from voxelith.llm.warc import read_records, write_archives


def public_tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_hamming_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), sign_code(F.col("embedding")).alias("code"))
    return top_k(rows, rows.where(F.col("id") % 20 == 0), 10)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_report(table(spark, sf_dir, "documents"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_report(table(spark, sf_dir, "documents"))


def op4_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, public_tokenizer("piece_bpe_32k.model"), ids=False, digests=True, keep_text=False)


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(table(spark, sf_dir, "documents"))


def op6_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per pair: its prompt, and both completions with the spans of them that are trained on, as from:to in order."""
    pairs = pair_records(format_preferences(*reply_pairs(table(spark, sf_dir, "conversations"))))
    told = lambda c: F.array_join(F.transform(c, lambda m: F.concat_ws(":", m["from"].cast("string"), m["to"].cast("string"))), ",")
    return pairs.withColumns({c: told(c) for c in ("chosen_masks", "rejected_masks")})


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_records(write_archives(table(spark, sf_dir, "pages")), payload=False)


def op9_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"), 40)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_report(table(spark, sf_dir, "documents"), public_tokenizer("byte_bpe_50k.json"), public_tokenizer("piece_bpe_32k.model"))


def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_report(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_hamming_top_k": op1_hamming_top_k,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_near_dedup": op3_near_dedup,
    "op4_piece_encoding": op4_piece_encoding,
    "op5_source_mix": op5_source_mix,
    "op6_ordinal_quality": op6_ordinal_quality,
    "op7_preference_pairs": op7_preference_pairs,
    "op8_warc": op8_warc,
    "op9_byte_shards": op9_byte_shards,
    "op10_toxicity": op10_toxicity,
    "op11_source_divergence": op11_source_divergence,
    "op12_token_alignment": op12_token_alignment,
    "op13_ngram_join": op13_ngram_join,
}

SQL: dict[str, str] = {
    "op1_hamming_top_k": """
WITH c AS (
  SELECT vec_id, array_to_string(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), '')::BIT AS b
  FROM embeddings WHERE embedding IS NOT NULL
), d AS (SELECT q.vec_id AS query_id, c.vec_id AS id, bit_count(xor(q.b, c.b))::INT AS distance FROM c q, c WHERE q.vec_id % 20 = 0
), r AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY distance, id))::INT AS rank, id, distance FROM d)
SELECT query_id, rank, id, distance FROM r WHERE rank <= 10
""",
    "op2_exact_dedup": """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents
), g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
""",
    "op5_source_mix": r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    md5(coalesce(doc_id::VARCHAR, '')) AS place, md5(coalesce(text, '')) AS text_md5
  FROM documents
), s0 AS (SELECT source, sum(size)::BIGINT AS s FROM d GROUP BY source
), s1 AS (SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w, row_number() OVER (ORDER BY source NULLS LAST) AS source_no FROM s0
), s2 AS (
  SELECT *, (sum(s) OVER ())::BIGINT AS budget, (sum(w) OVER ())::BIGINT AS weights,
    coalesce(sum(3 * s) OVER lower, 0)::BIGINT AS full_below, coalesce(sum(w) OVER lower, 0)::BIGINT AS w_below
  FROM s1 WINDOW lower AS (ORDER BY s / w, source_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), s3 AS (
  SELECT *, (budget - full_below)::DOUBLE / (weights - w_below) AS level, w * ((budget - full_below)::DOUBLE / (weights - w_below)) > 3 * s AS is_full FROM s2
), lv AS (SELECT first(level ORDER BY s / w, source_no) FILTER (NOT is_full) AS level FROM s3
), src AS (
  SELECT source, source_no, s AS source_size, budget, CASE WHEN is_full THEN (3 * s)::DOUBLE ELSE w * lv.level END AS target FROM s3, lv
), r AS (
  SELECT doc_id, size, source_no, source_size, budget, target, row_number() OVER o AS rid, (sum(size) OVER o)::BIGINT AS upto
  FROM d JOIN src ON d.source IS NOT DISTINCT FROM src.source
  WINDOW o AS (PARTITION BY source_no ORDER BY place, doc_id, text_md5 ROWS UNBOUNDED PRECEDING)
), c AS (
  SELECT source_no, rid, size, budget, sum(size) OVER (ORDER BY (e * source_size + upto) / target, source_no, upto ROWS UNBOUNDED PRECEDING) AS running
  FROM r, (VALUES (0), (1), (2)) v(e) WHERE size > 0 AND target > 0
), t AS (SELECT source_no, rid, sum(size)::BIGINT AS taken FROM c WHERE running <= budget GROUP BY ALL)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM r LEFT JOIN t USING (source_no, rid)
""",
    "op7_preference_pairs": r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS txt FROM conversations
), e AS (
  SELECT conv_id, max(turn) FILTER (role = 'assistant') AS last_turn, min(turn) FILTER (role = 'assistant') AS first_turn,
    arg_min(txt, turn) FILTER (role = 'assistant') AS first_text, arg_min(txt, turn) AS opening
  FROM t GROUP BY conv_id HAVING max(turn) FILTER (role = 'assistant') IS NOT NULL
), b AS (
  SELECT t.conv_id AS pair_id, turn, role, txt AS chosen,
    CASE WHEN turn = last_turn AND role = 'assistant' THEN CASE WHEN first_turn < last_turn THEN first_text ELSE opening END ELSE txt END AS rejected
  FROM t LEFT JOIN e ON t.conv_id IS NOT DISTINCT FROM e.conv_id 
), s AS (SELECT pair_id, min(turn) FILTER (chosen <> rejected) AS split FROM b GROUP BY pair_id
), u AS (
  SELECT pair_id, CASE WHEN split IS NULL OR coalesce(turn < split, true) THEN 'prompt' ELSE side END AS part, turn, role, txt
  FROM b JOIN s USING (pair_id), LATERAL (VALUES ('chosen', chosen), ('rejected', rejected)) v(side, txt)
  WHERE side = 'chosen' OR coalesce(turn >= split, false)
), o AS (SELECT *, '<|' || role || '|>' || chr(10) || txt || '<|end|>' || chr(10) AS rendered, part <> 'prompt' AND role = 'assistant' AS trained FROM u)
SELECT pair_id, 0::BIGINT AS piece, coalesce(string_agg(rendered, '' ORDER BY turn NULLS FIRST) FILTER (part = 'prompt'), '') AS prompt,
  coalesce(string_agg(rendered, '' ORDER BY turn NULLS FIRST) FILTER (part = 'chosen'), '') AS chosen, coalesce(string_agg(rendered, '' ORDER BY turn NULLS FIRST) FILTER (part = 'rejected'), '') AS rejected,
  coalesce(string_agg(span, ',' ORDER BY turn NULLS FIRST) FILTER (part = 'chosen' AND trained), '') AS chosen_masks, coalesce(string_agg(span, ',' ORDER BY turn NULLS FIRST) FILTER (part = 'rejected' AND trained), '') AS rejected_masks
FROM (SELECT *, (upto - length(rendered) + 5 + length(role))::BIGINT || ':' || upto::BIGINT AS span
  FROM (SELECT *, sum(length(rendered)) OVER (PARTITION BY pair_id, part ORDER BY turn NULLS FIRST ROWS UNBOUNDED PRECEDING) AS upto FROM o)) GROUP BY pair_id
""",
    "op8_warc": """
WITH d AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages
), g AS (SELECT h, min(page_id) AS first_id FROM d GROUP BY h)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (((('0x' || substr(h, i * 5 // 4 + 1, 2))::INT >> (3 - i * 5 % 4)::INT) & 31) + 1)::BIGINT, 1)), '') AS payload_digest,
  CASE WHEN page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM d JOIN g USING (h)
""",
    "op9_byte_shards": """
WITH RECURSIVE steps(i, k, c) AS (
  SELECT range, 0, range::BIGINT FROM range(256)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END FROM steps WHERE k < 8
), crc AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8
), d AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 16 AS size, CASE WHEN coalesce(text, '') = '' THEN 0 ELSE xor(4294967295, list_reduce(
    list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::BIGINT), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1]), 4294967295::BIGINT)) END AS text_crc32
  FROM documents, crc
), p AS (
  SELECT *, row_number() OVER o AS n, (sum(size) OVER o)::BIGINT - size AS before, (sum(size) OVER ())::BIGINT AS total
  FROM d WINDOW o AS (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS UNBOUNDED PRECEDING)
), q AS (SELECT *, least(39, (2 * before + size) * 40 // (2 * total))::INT AS shard FROM p)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY n) - 1 AS slot, NULL::INT AS grown_shard FROM q
""",
    "op11_source_divergence": r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS txt FROM documents
), o AS (
  SELECT id, lang, source, unnest(regexp_extract_all(translate(txt, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), k AS (SELECT lang, term, count(*) AS total FROM o GROUP BY ALL HAVING count(DISTINCT id) >= 3
), lv AS (SELECT lang, count(*) AS v, sum(total)::BIGINT AS n_lang FROM k GROUP BY ALL
), c AS (SELECT lang, source, term, count(*) AS n FROM o SEMI JOIN k USING (lang, term) GROUP BY ALL
), g AS (
  SELECT lang, source, coalesce(v, 0) AS v, coalesce(n_lang, 0) AS n_lang, coalesce(n_group, 0) AS n_group FROM (SELECT DISTINCT lang, source FROM d)
  LEFT JOIN lv USING (lang) LEFT JOIN (SELECT lang, source, sum(n)::BIGINT AS n_group FROM c GROUP BY ALL) USING (lang, source)
), p AS (
  SELECT lang, source, term, total, n_lang, v, coalesce(n, 0) AS n, 1 + 1000000000 * (coalesce(n, 0) + 1) // (n_group + v) AS p FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)
), t AS (
  SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value
  FROM (SELECT *, 1 + 1000000000 * (total + 1) // (n_lang + v) AS q FROM p WHERE n > 0) WHERE p > q
), s AS (
  SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p)::BIGINT AS value
  FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL
), r AS (
  SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN s ON s.lang = x.lang AND s.source = x.source AND s.item = y.source
  UNION ALL SELECT * FROM t
), f AS (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM r)
SELECT lang, source, part, item, value, rank FROM f WHERE part = 'pair' OR rank <= 200
""",
}
