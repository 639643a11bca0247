"""Every registered query runs on the smallest tables; those with an oracle must agree with it."""

import pytest
from conftest import DATA
from oracle import compare, connect

import __spark_entry__ as entry

SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(DATA)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, DATA)
    if name in SQL:
        assert compare(df, con, SQL[name]) is None
    else:
        assert df.count() >= 0
        assert len(set(df.columns)) == len(df.columns)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["q_id", "doc_id", "final_score", "rank"]
    assert df.count() > 0
