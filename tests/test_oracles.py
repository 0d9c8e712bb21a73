"""Every core query that has SQL must give the rows that SQL gives."""

from __future__ import annotations

import pytest

from quillon.plans.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_agrees_with_sql(spark, sf_dir, duck, same, name):
    same(QUERIES[name](spark, sf_dir).toPandas(), duck.sql(ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_gives_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0
