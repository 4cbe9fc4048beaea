"""Every registered query against its SQL oracle."""

import pytest

import __spark_entry__ as entry
from taleweave.plans.catalog import ORACLES, QUERIES
from tests.parity import compare, connect

@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, sf, con, name):
    assert compare(QUERIES[name](spark, sf), con, ORACLES[name]) is None


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_has_an_oracle():
    assert set(ORACLES) == set(QUERIES)
