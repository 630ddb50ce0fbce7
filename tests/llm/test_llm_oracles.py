import pytest
from oracle import differences

queries = pytest.importorskip("filegraph.llm.queries")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    assert differences(name, spark, "sf0.001") == []
