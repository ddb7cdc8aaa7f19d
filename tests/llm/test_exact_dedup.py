import hashlib
import string
from collections import defaultdict

from voxelith.llm.exact_dedup import dedup_report, drop_duplicates

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
SCHEMA = "doc_id bigint, text string, text_sha256 string, `Rn` int, `a.b` int"


def rows():
    texts = ["Hot Text"] * 400 + [None, "", "É", "é", "ABC É", "abc É", "x" * 300_000, "X" * 300_000, "lone"]
    out = [(i, t, "clash", i, 1) for i, t in enumerate(texts)]
    return [*out, (5, "Hot Text", "again", 5, 1), (None, "lone", None, None, None), (None, "nameless", None, None, None)]


def expected(data):
    groups = defaultdict(list)
    for r in data:
        groups[(r[1] or "").translate(LOWER)].append(r[0])
    return {t: (max((i for i in ids if i is not None), default=None), len(ids)) for t, ids in groups.items()}


def test_report_equals_brute_force(spark):
    data = rows()
    want = expected(data)
    got = dedup_report(spark.createDataFrame(data, SCHEMA).repartition(3), support=0.01).collect()
    assert len(got) == len(data)
    by_text = {hashlib.sha256(t.encode()).hexdigest(): v for t, v in want.items()}
    for r in got:
        keep, size = by_text[r.text_sha256]
        assert (r.keep_id, r.group_size, r.kept) == (keep, size, r.doc_id == keep)


def test_drop_keeps_one_row_of_each_text(spark):
    data = rows()
    got = drop_duplicates(spark.createDataFrame(data, SCHEMA), support=0.01)
    assert got.columns == ["doc_id", "text", "text_sha256", "Rn", "a.b"]
    kept = [((r.text or "").translate(LOWER), r.doc_id) for r in got.collect()]
    assert sorted(kept, key=str) == sorted(((t, k) for t, (k, _) in expected(data).items()), key=str)


def test_no_row_is_lost_between_the_paths(spark):
    """Many texts of about the same number of copies, so that candidates vary."""
    data = [(i, f"t{i % 700}", None, None, None) for i in range(5000)]
    got = dedup_report(spark.createDataFrame(data, SCHEMA).repartition(4))
    assert (got.count(), got.where("kept").count()) == (5000, 700)


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert dedup_report(empty).count() == 0
    assert drop_duplicates(empty).count() == 0
