"""The registered queries: against SQL where there is some, else that they give rows."""

import pytest

from siftlight.llm import queries as Q

QUERIES, SQL = Q.queries(), Q.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(agree, name):
    agree(QUERIES[name], SQL[name])


@pytest.mark.parametrize(("name", "columns"), [("p1_found", ["doc_id", "stem"]), ("p3_found", ["doc_id"]), ("p9_found", ["doc_id", "start_pos", "end_pos"])])
def test_columns(spark, name, columns):
    from tests.conftest import DATA

    df = QUERIES[name](spark, DATA)
    assert df.columns == columns and df.count() > 0
