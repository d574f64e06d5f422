"""Every registered query with SQL gives that SQL's rows on the smallest tables."""

import pytest

from sightline import registry
from tests.compare import rows

NAMES = sorted(registry.queries())


def test_sql_names_are_queries():
    assert set(registry.oracle_sql()) <= set(NAMES)


@pytest.mark.parametrize("name", NAMES)
def test_query(name, spark, sf, duck):
    got = registry.queries()[name](spark, sf).toPandas()
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert len(got.columns)
        return
    want = duck.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
