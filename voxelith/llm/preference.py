"""Preference formatting: the common turns of a chosen and a rejected conversation once as prompt, the rest as completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelith.ordering import in_groups
from voxelith.storage import materialise

#: Marks of a rendered turn; the text stands between HEAD and TAIL.
HEAD, TAIL = "<|{role}|>\n", "<|end|>\n"
#: Characters of a pair that fit into one record, and of a longer pair's pieces.
MAX_CHARS = 4 << 20


def render(role: Column, text: Column) -> Column:
    before, after = HEAD.split("{role}")
    return F.concat(F.lit(before), F.coalesce(role, F.lit("")), F.lit(after), F.coalesce(text, F.lit("")), F.lit(TAIL))


def format_preferences(chosen: DataFrame, rejected: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """Segments of preference pairs from two tables of turns, `pair_id, turn, role, text` each.

    `pair_id, part, turn, place, role, rendered, mask_from, mask_to, n_chars`, a row per rendered turn. `part` is `prompt` for
    the longest common prefix of the two conversations (equal turn numbers, roles and texts, in order), which is rendered
    once, then `chosen` and `rejected` for what follows. Characters from `mask_from` to `mask_to` of a segment are trained
    on: text and end mark of the `trained_role` in completions, none (0 to 0) in prompts and of other roles. A pair's
    prompt or completion is its segments in order of (turn, place); it's left as rows so that no conversation, however
    long, has to fit into one.

    Null roles and texts count as empty and null turns come first. Rows that repeat a turn are in order of role and text,
    numbered by `place`; repeats of the same row count once each. A pair on one side only has no prompt; null pair_ids
    are one pair. Other columns play no part.
    """
    both = None
    for side, df in (("chosen", chosen), ("rejected", rejected)):
        rows = df.select("pair_id", F.lit(side).alias("side"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
        both = rows if both is None else both.unionByName(rows)
    # Places within a turn: a turn is one row, but for repeated ones.
    both = both.withColumn("md5", F.md5(F.encode(F.concat_ws("\0", "role", "text"), "UTF-8")))
    both = both.withColumn("place", F.row_number().over(Window.partitionBy("pair_id", "side", "turn").orderBy("role", "md5")) - 1)
    at = F.struct(F.col("turn").isNotNull().alias("known"), "turn", "place")
    keys = both.groupBy("pair_id", "turn", "place").agg(F.count(F.lit(1)).alias("n"), F.min("md5").alias("m0"), F.max("md5").alias("m1"))
    split = keys.where("n < 2 OR m0 <> m1").groupBy(F.col("pair_id").alias("s_id")).agg(F.min(at).alias("first"))
    out = both.join(split, F.col("pair_id").eqNullSafe(F.col("s_id")), "left")
    common = F.col("first").isNull() | (at < F.col("first"))
    out = out.where(~common | (F.col("side") == "chosen"))
    rendered = render(F.col("role"), F.col("text"))
    trained = ~common & (F.col("role") == trained_role)
    size = F.char_length(rendered)
    head = F.lit(len(HEAD.format(role=""))) + F.char_length("role")
    return out.select(
        "pair_id",
        F.when(common, F.lit("prompt")).otherwise(F.col("side")).alias("part"),
        "turn",
        "place",
        "role",
        rendered.alias("rendered"),
        F.when(trained, head).otherwise(F.lit(0)).alias("mask_from"),
        F.when(trained, size).otherwise(F.lit(0)).alias("mask_to"),
        size.alias("n_chars"),
    )


def pair_records(segments: DataFrame, max_chars: int = MAX_CHARS) -> DataFrame:
    """`pair_id, piece, prompt, chosen, rejected, chosen_masks, rejected_masks`: a row per pair, piece 0.

    A record holds what format_preferences() gave as rows: the prompt, and two completions with the spans `from, to` of
    each that are trained on. Pairs of more than `max_chars` characters come in pieces of about that many, numbered from
    0: prompt, then chosen, then rejected. A pair's texts are those of its pieces one after another, and spans count from
    the start of their piece's text; a segment is never cut. No segments of a part make an empty text without spans. Null
    pair_ids are one pair. Pieces of long pairs are found by one order of all their segments, so no pair is one task's work.
    """
    segments = materialise(segments, "preference-segments")
    size = segments.groupBy(F.col("pair_id").alias("z_id")).agg(F.sum("n_chars").alias("chars"))
    long = materialise(size.where(F.col("chars") > max_chars).select("z_id"), "preference-long")
    same = F.col("pair_id").eqNullSafe(F.col("z_id"))
    whole = segments.join(long, same, "left_anti").withColumn("piece", F.lit(0).cast("bigint"))
    if not long.isEmpty():
        part = F.array_position(F.array(*map(F.lit, ("prompt", "chosen", "rejected"))), F.col("part"))
        cut = segments.join(long, same, "left_semi").withColumnRenamed("place", "nth")
        cut = in_groups(cut, ["pair_id"], [part, F.col("turn"), F.col("nth")], size="n_chars", name="preference-pieces")
        cut = cut.drop("place").withColumnRenamed("nth", "place").withColumn("piece", F.expr(f"before div {max_chars}"))
        whole = whole.unionByName(cut.select(whole.columns))
    row = F.struct(F.col("turn").isNotNull().alias("known"), "turn", "place", "rendered", "mask_from", "mask_to", "n_chars")
    of = lambda part: F.array_sort(F.collect_list(F.when(F.col("part") == part, row))).alias(part)
    out = whole.groupBy("pair_id", "piece").agg(*map(of, ("prompt", "chosen", "rejected")))
    text = lambda part: F.concat_ws("", F.transform(part, lambda r: r["rendered"]))

    def masks(part: str) -> Column:
        start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<from:bigint,to:bigint>>").alias("spans"))
        span = lambda acc, r: F.struct((acc["at"] + r["mask_from"]).alias("from"), (acc["at"] + r["mask_to"]).alias("to"))
        step = lambda acc, r: F.struct((acc["at"] + r["n_chars"]).alias("at"), F.when(r["mask_to"] > 0, F.concat(acc["spans"], F.array(span(acc, r)))).otherwise(acc["spans"]).alias("spans"))
        return F.aggregate(part, start, step, lambda acc: acc["spans"])

    return out.select("pair_id", "piece", *(text(p).alias(p) for p in ("prompt", "chosen", "rejected")), *(masks(p).alias(f"{p}_masks") for p in ("chosen", "rejected")))


def reply_pairs(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chosen, rejected) from plain conversations (`conv_id, turn, role, text`), which have no preferences of their own.

    Chosen is a conversation. Rejected is the same with its last assistant turn's text replaced by the assistant's first
    text, an answer to another question; with one assistant turn only, by the first text of the conversation, an echo.
    Turns after the last reply follow on both sides. Conversations without an assistant turn are all prompt. Null turns
    come first; the last turn of an assistant whose turns are all null is none of them.
    """
    said = F.when(F.col("role") == "assistant", F.struct("turn", F.coalesce("text", F.lit("")).alias("text")))
    ends = turns.groupBy(F.col("conv_id").alias("c_id")).agg(
        F.max(said).alias("last"), F.min(said).alias("first"), F.min(F.struct("turn", F.coalesce("text", F.lit("")).alias("text"))).alias("opening")
    )
    ends = ends.where("last IS NOT NULL").select("c_id", F.col("last.turn").alias("last_turn"), F.when(F.col("first.turn") < F.col("last.turn"), F.col("first.text")).otherwise(F.col("opening.text")).alias("other"))
    told = turns.join(ends, turns.conv_id.eqNullSafe(ends.c_id), "left")
    chosen = told.select(F.col("conv_id").alias("pair_id"), "turn", "role", "text")
    swapped = F.when((F.col("turn") == F.col("last_turn")) & (F.col("role") == "assistant"), F.col("other")).otherwise(F.col("text"))
    return chosen, told.select(F.col("conv_id").alias("pair_id"), "turn", "role", swapped.alias("text"))
