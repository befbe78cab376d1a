"""Every query of the catalogue against its SQL on the smallest tables; those without SQL must run."""

import os

import pytest

from meshql.plans import catalog

from . import oracle

pytestmark = pytest.mark.skipif(not os.path.isdir(oracle.SF), reason="no tables")


@pytest.fixture(scope="module")
def c():
    return oracle.connection()


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_same_rows(spark, c, name):
    oracle.same(spark, catalog.QUERIES[name], catalog.ORACLE_SQL[name], c)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, oracle.SF).count() > 0
