"""Every registered query of the event library against its SQL on the smallest tables."""

import pytest

from emberframe.plans import catalog
from tests.compare import DATA, assert_same

SQL = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    assert assert_same(catalog.queries()[name](spark, f"{DATA}/sf0.001"), SQL[name], f"{DATA}/sf0.001") > 0


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    assert catalog.queries()[name](spark, f"{DATA}/sf0.001").count() > 0
