"""Every registered query runs; those with SQL give what an independent engine gives."""

import pytest

from gleaner.plans.catalog import ORACLE_SQL, QUERIES

from .compare import normal, oracle


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, sf, name):
    got, want = normal(QUERIES[name](spark, sf).toPandas()), normal(oracle(ORACLE_SQL[name], sf))
    assert list(got.columns) == list(want.columns)
    assert len(got) == len(want)
    assert got.equals(want), got[(got != want).any(axis=1)].head()


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLE_SQL.keys()))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0
