"""From raw documents to token ids: toxic documents, copies and near copies go, sources are mixed, texts are encoded."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from voxelith.llm.exact_dedup import drop_duplicates
from voxelith.llm.mixing import mix
from voxelith.llm.near_dedup import drop_near_duplicates
from voxelith.llm.pieces import encode
from voxelith.llm.queries import public_tokenizer, table
from voxelith.llm.toxicity import drop_toxic
from voxelith.storage import materialise, sweep, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that score under the toxicity threshold; the model is fitted on those of `labels` in `docs`.

    Null and empty texts score 0 and stay, and so do all documents where `labels` has nothing to learn from. Repeated
    rows and null ids are scored like others. All columns stay, whatever their names. An empty table stays empty.
    """
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, but for the case of A-Z: the one of largest id.

    Null texts count as empty, and one empty text stays. A null id loses to others; rows with the same id and text are one
    document. All columns stay, whatever their names. An empty table stays empty.
    """
    return drop_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: the one of least id.

    Texts without words, null ones too, all stay. A null id loses to others; rows with the same id and text are one
    document. All columns stay, whatever their names. An empty table stays empty.
    """
    return drop_near_duplicates(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, up to three times; as many words as there were.

    Documents without words are in no mix. Null sources are one source. Rows with the same id and text stand for each
    other. All columns stay, whatever their names. An empty table stays empty.
    """
    return mix(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token ids, and digests of the ids and of the text that they decode to.

    Null texts count as empty. Each row is encoded, so ids may be null and rows may repeat. The text is left out; other
    columns stay but for those with the names of the new ones. An empty table stays empty.
    """
    return encode(docs, public_tokenizer("piece_bpe_32k.model"), ids=True, digests=True, keep_text=False)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("exact dedup", exact_dedup),
    ("near dedup", near_dedup),
    ("mixing", mixing),
    ("encoding", encoding),
]

#: SQL can't express the trained classifier, the signatures or the encoder; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents; each stage's rows are written and read again by the next.

    What a stage wrote for itself is deleted when its rows are written, and these when the next stage's are.
    """
    docs, since = table(spark, sf_dir, "documents"), written()
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs, f"stage-{name.replace(' ', '-')}")
            sweep(docs, since)
    return docs
