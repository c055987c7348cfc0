"""Every registered query against its SQL twin on the smallest tables."""

import pytest

import __spark_entry__ as entry
from registry.core import ORACLES, QUERIES
from tests.check import compare, connect
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    ok, message, _, _ = compare(spark, duck, QUERIES[name], ORACLES[name], SMALL)
    assert ok, message


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
