from voxelith.llm.preference import format_preferences, pair_records, reply_pairs

TURNS = "pair_id bigint, turn bigint, role string, text string, part string"


def seg(role, text):
    return f"<|{role}|>\n{text}<|end|>\n"


def joined(rows, pair, part):
    return "".join(r.rendered for r in sorted((r for r in rows if (r.pair_id, r.part) == (pair, part)), key=lambda r: (r.turn is not None, r.turn or 0, r.place)))


def test_prefix_is_rendered_once_and_replies_are_masked(spark):
    chosen = [(1, 0, "user", "q", "x"), (1, 1, "assistant", "a", "x"), (1, 2, "user", "r", "x"), (1, 3, "assistant", "yes", "x")]
    rejected = [*chosen[:3], (1, 3, "assistant", "no", "x"), (1, 4, "user", "hm", "x")]
    both = [(2, 0, "user", "same", "x"), (2, 1, None, None, "x")]
    alone = [(3, 0, "user", "only here", "x")]
    got = format_preferences(spark.createDataFrame(chosen + both + alone, TURNS), spark.createDataFrame(rejected + both, TURNS)).collect()
    assert joined(got, 1, "prompt") == seg("user", "q") + seg("assistant", "a") + seg("user", "r")
    assert joined(got, 1, "chosen") == seg("assistant", "yes")
    assert joined(got, 1, "rejected") == seg("assistant", "no") + seg("user", "hm")
    assert joined(got, 2, "prompt") == seg("user", "same") + seg("", "") and joined(got, 2, "chosen") == joined(got, 2, "rejected") == ""
    assert joined(got, 3, "chosen") == seg("user", "only here") and joined(got, 3, "prompt") == ""
    for r in got:
        trained = r.rendered[r.mask_from : r.mask_to]
        assert trained == (r.rendered.split("\n", 1)[1] if r.part != "prompt" and r.role == "assistant" else "")
        assert r.n_chars == len(r.rendered)


def test_repeated_rows_null_turns_and_no_rows(spark):
    a = [(1, None, "user", "first", ""), (1, 0, "user", "q", ""), (1, 0, "user", "q", ""), (1, 1, "assistant", "z" * 100_000, "")]
    b = [(1, None, "user", "first", ""), (1, 0, "user", "q", ""), (1, 1, "assistant", "z" * 100_000, "")]
    got = format_preferences(spark.createDataFrame(a, TURNS), spark.createDataFrame(b, TURNS)).collect()
    assert joined(got, 1, "prompt") == seg("user", "first") + seg("user", "q")
    assert joined(got, 1, "chosen") == seg("user", "q") + seg("assistant", "z" * 100_000)
    none = spark.createDataFrame([], TURNS)
    assert format_preferences(none, none).count() == 0


def test_reply_pairs(spark):
    turns = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "user", "r"), (1, 3, "assistant", "b"), (1, 4, "user", "bye"), (2, 0, "user", "q"), (2, 1, "assistant", "a"), (3, 0, "user", "alone"), (3, None, "user", "x"), (4, 0, "assistant", None)]
    chosen, rejected = reply_pairs(spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string"))
    told = lambda df: sorted(((r.pair_id, r.turn, r.role, r.text) for r in df.collect()), key=str)
    assert told(chosen) == sorted(turns, key=str)
    other = {(1, 3): "a", (2, 1): "q", (4, 0): ""}
    assert told(rejected) == sorted(((c, t, r, other.get((c, t), x)) for c, t, r, x in turns), key=str)
    none = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert [d.count() for d in reply_pairs(none)] == [0, 0]


def test_pair_records(spark):
    chosen = [(1, 0, "user", "q", ""), (1, 1, "assistant", "yes", ""), (1, 2, "user", "so", ""), (1, 3, "assistant", "fine", ""), (None, 0, "user", "n", ""), (5, 0, "assistant", "z" * 900, "")]
    rejected = [(1, 0, "user", "q", ""), (1, 1, "assistant", "no", ""), (None, 0, "user", "n", ""), (5, 0, "assistant", "y" * 900, "")]
    segments = format_preferences(spark.createDataFrame(chosen, TURNS), spark.createDataFrame(rejected, TURNS))
    records = pair_records(segments, 1000)
    rows = sorted(records.collect(), key=lambda r: r.piece)
    got = {r.pair_id: r for r in rows if r.piece == 0}
    assert set(got) == {1, None, 5}
    assert (got[1].prompt, got[1].rejected) == (seg("user", "q"), seg("assistant", "no"))
    assert got[1].chosen == seg("assistant", "yes") + seg("user", "so") + seg("assistant", "fine")
    trained = lambda text, masks: [text[m["from"] : m["to"]] for m in masks]
    assert trained(got[1].chosen, got[1].chosen_masks) == ["yes<|end|>\n", "fine<|end|>\n"] and trained(got[1].rejected, got[1].rejected_masks) == ["no<|end|>\n"]
    assert (got[None].prompt, got[None].chosen, got[None].chosen_masks) == (seg("user", "n"), "", [])
    long = [r for r in rows if r.pair_id == 5]
    assert "".join(r.chosen for r in long) == seg("assistant", "z" * 900) and "".join(r.rejected for r in long) == seg("assistant", "y" * 900)
    assert [t for r in long for side in ("chosen", "rejected") for t in trained(r[side], r[f"{side}_masks"])] == ["z" * 900 + "<|end|>\n", "y" * 900 + "<|end|>\n"]
    assert pair_records(segments.where("false")).count() == 0


def test_long_pairs_come_in_pieces(spark):
    """Pieces joined are the whole pair, whatever their size, with repeated rows and null turns."""
    turns = [(k, i if i else None, ["user", "assistant"][i % 2], f"turn {i} of {k} " * (i % 5), "") for k in (1, 2, None) for i in range(30)] + [(1, 4, "user", "again", "")] * 2
    other = [(k, t, r, x + "!" if t and t > 9 else x, "") for k, t, r, x, _ in turns]
    segments = format_preferences(spark.createDataFrame(turns, TURNS), spark.createDataFrame(other, TURNS))
    whole = {r.pair_id: r for r in pair_records(segments).collect()}
    for size in (1, 100, 700):
        for pair, want in whole.items():
            rows = sorted((r for r in pair_records(segments, size).collect() if r.pair_id == pair), key=lambda r: r.piece)
            assert len(rows) > 1
            for c in ("prompt", "chosen", "rejected"):
                assert "".join(r[c] for r in rows) == want[c]
            for c in ("chosen", "rejected"):
                assert [r[c][m["from"] : m["to"]] for r in rows for m in r[f"{c}_masks"]] == [want[c][m["from"] : m["to"]] for m in want[f"{c}_masks"]]
