import pytest

from semloom.llm import queries
from tests.oracle import same, views


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, data, name):
    df = queries.QUERIES[name](spark, data)
    if name in queries.SQL:
        same(views(data), df, queries.SQL[name])
    else:
        assert df.count() > 0
