"""Every registered query of the engine against its SQL on a small table; those without SQL give rows."""

import os

import duckdb
import pytest

from voxelith.plans.catalog import QUERIES, SQL

SF = "/root/testdata/sf0.001"


def text(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (int, float)):
        return f"{float(v) + 0.0:.9g}"
    if isinstance(v, (list, tuple)):
        return str([text(x) for x in v])
    return str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, con, name):
    got, want = QUERIES[name](spark, SF), con.sql(SQL[name])
    order = sorted(got.columns)
    assert order == sorted(want.columns)
    assert sorted([text(r[c]) for c in order] for r in got.collect()) == sorted([text(v) for v in r] for r in want.select(*(f'"{c}"' for c in order)).fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_has_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
