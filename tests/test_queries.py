import pytest
from compare import assert_equal
from tideline.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, name):
    assert_equal(spark, "/root/testdata/sf0.001", catalog.queries()[name], catalog.oracle_sql()[name])
