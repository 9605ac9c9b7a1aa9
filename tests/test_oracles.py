"""Every query of the retrieval engine against its SQL; the others run and have rows."""

import pytest

from tests.duck import difference
from vectrail import catalog

SQL, QUERIES = catalog.oracle_sql(), catalog.queries()


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, sf, name):
    assert difference(QUERIES[name](spark, sf), SQL[name], sf) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0
