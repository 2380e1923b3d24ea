import pytest

from semloom.plans import registry
from tests.oracle import same, views


@pytest.fixture(scope="module")
def con(data):
    return views(data)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, data, con, name):
    df = registry.QUERIES[name](spark, data)
    if name in registry.SQL:
        same(con, df, registry.SQL[name])
    else:
        assert df.columns and df.count() >= 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
