"""Every registered query with SQL must agree with the second engine on the smallest data."""

import pytest

from corpusweave.plans import load_all
from corpusweave.plans.registry import CATALOG, ORACLE
from tests.harness import compare, connect

load_all()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_agrees(name, spark, con, sf):
    ok, message = compare(CATALOG[name], ORACLE[name], spark, con, sf)
    assert ok, message


@pytest.mark.parametrize("name", sorted(set(CATALOG) - set(ORACLE)))
def test_query_without_sql_runs(name, spark, sf):
    df = CATALOG[name](spark, sf)
    assert df.columns and df.count() > 0
