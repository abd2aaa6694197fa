import pytest

from clipwright.plans.catalog import QUERIES
from tests.oracle import compare


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if sql])
def test_query_equals_its_sql(spark, sf, name):
    build, sql = QUERIES[name]
    compare(spark, sf, build, sql)
