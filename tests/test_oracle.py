"""Every core query against its SQL on the smallest data."""

import pytest

from siftlight import reference_queries, retrieval_queries, retrieval_sql

QUERIES = {**retrieval_queries.queries(), **reference_queries.queries()}
SQL = {**retrieval_sql.oracle_sql(), **reference_queries.oracle_sql()}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(agree, name):
    agree(QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    from tests.conftest import DATA

    assert QUERIES[name](spark, DATA).count() > 0
