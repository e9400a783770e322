import os

import pytest

from lexiquarry.llm import queries
from tests import oracle

pytestmark = pytest.mark.skipif(not os.path.isdir(oracle.SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    pytest.importorskip("duckdb")
    return oracle.connect()


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows_as_sql(spark, con, name):
    assert oracle.rows_of_spark(queries.QUERIES[name](spark, oracle.SF_DIR)) == oracle.rows_of_sql(con, queries.SQL[name])
