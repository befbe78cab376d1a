"""Queries with SQL against it on the smallest tables."""

import os

import pytest

from meshql.llm import queries

from .. import oracle

pytestmark = pytest.mark.skipif(not os.path.isdir(oracle.SF), reason="no tables")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows(spark, name):
    oracle.same(spark, queries.QUERIES[name], queries.ORACLE_SQL[name], oracle.connection())
