"""Every registered query against its SQL in another engine."""

import pytest

import check
from forecourt import suite

SF_DIR = "/root/testdata/sf0.001"
QUERIES, SQL = suite.all_queries(), suite.all_sql(SF_DIR)


@pytest.fixture(scope="module")
def db():
    return check.connect(SF_DIR)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_sql(spark, db, name):
    expected = db.sql(SQL[name]).to_arrow_table()
    assert check.compare(QUERIES[name](spark, SF_DIR).toArrow(), expected) is None


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["name", "value"]
