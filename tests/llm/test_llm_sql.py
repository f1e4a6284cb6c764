"""Queries that SQL can express, side by side with their SQL in another engine."""

import pytest

import check
from forecourt.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return check.connect(SF)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_agrees_with_sql(spark, db, name):
    expected = db.sql(queries.SQL[name]).to_arrow_table()
    assert check.compare(queries.QUERIES[name](spark, SF).toArrow(), expected) is None


def test_registered_names():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 1 + len(queries.QUERIES)))
