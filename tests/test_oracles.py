"""Every query with SQL against DuckDB; every query without it must return rows."""

import pytest
from oracle import ROOT, compare, connect

from spanledger.catalog import REGISTRY

SF = "sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", [q.name for q in REGISTRY.values() if q.sql])
def test_matches_sql(spark, con, name):
    assert compare(REGISTRY[name], spark, con, SF) is None


@pytest.mark.parametrize("name", [q.name for q in REGISTRY.values() if not q.sql])
def test_returns_rows(spark, name):
    assert REGISTRY[name].run(spark, f"{ROOT}/{SF}").count() > 0
