"""Every query with an SQL twin gives the same rows in both engines."""

import pytest
from check import compare, connect

from avalista.catalog import QUERIES, SQL


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, sf, duck, name):
    assert compare(QUERIES[name](spark, sf), duck, SQL[name]) == ""


def test_every_twin_has_a_query():
    assert set(SQL) <= set(QUERIES)
