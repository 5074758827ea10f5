import pytest
from compare import assert_equal
from tideline.llm import registry


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, name):
    assert_equal(spark, "/root/testdata/sf0.001", registry.queries()[name], registry.oracle_sql()[name])
