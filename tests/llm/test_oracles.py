"""Training-data queries against their SQL."""

import pytest

from tests.duck import difference
from vectrail import llm

SQL, QUERIES = llm.oracle_sql(), llm.queries()


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, sf, name):
    assert difference(QUERIES[name](spark, sf), SQL[name], sf) == ""
