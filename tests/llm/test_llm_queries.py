from __future__ import annotations

import pytest

from lexmill.llm import queries as llm
from tests.compare import DATA, same

SQL = llm.oracle_sql()
SMALL = DATA / "sf0.001"
pytestmark = pytest.mark.skipif(not SMALL.exists(), reason="the test tables are not here")


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    same(spark, llm.queries()[name], SQL[name], SMALL)


@pytest.mark.parametrize("name", sorted(set(llm.queries()) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    assert llm.queries()[name](spark, str(SMALL)).count() > 0
