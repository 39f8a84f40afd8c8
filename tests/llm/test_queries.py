"""Queries with SQL against it."""

import pytest

from check_sql import compare, connect
from tripmart.llm import queries


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, con, sf_dir, name):
    assert compare(spark, con, queries.QUERIES[name], queries.SQL[name], sf_dir) is None


def test_all_queries():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
