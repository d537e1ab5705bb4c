import pytest

from tandem.llm import queries
from tests.oracle import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    assert compare(spark, queries.QUERIES[name], queries.ORACLE_SQL[name], SF) == 200
