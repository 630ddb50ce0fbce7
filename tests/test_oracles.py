import pytest
from oracle import differences

from filegraph.queries import ORACLES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    assert differences(name, spark, "sf0.001") == []
