import pytest

from merchlens.llm.queries import ORACLES, QUERIES
from tests.check import compare, connect
from tests.conftest import SMALL


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_its_sql(spark, name):
    ok, message, rows, _ = compare(spark, connect(SMALL), QUERIES[name], ORACLES[name], SMALL)
    assert ok and rows, message
