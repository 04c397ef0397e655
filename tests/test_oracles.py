import pytest

from tests import oracle
from tessera.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_against_sql(spark, name):
    assert oracle.ours(catalog.QUERIES[name], spark) == oracle.duck(catalog.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_without_sql(spark, name):
    assert oracle.ours(catalog.QUERIES[name], spark)[0]
