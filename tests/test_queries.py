"""Every registered query with an oracle gives the oracle's rows."""

from __future__ import annotations

import pytest

from florilege.plans.registry import ORACLE_SQL, QUERIES
from tests.oracle import connect, same


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_oracle(spark, sf, con, name):
    same(QUERIES[name](spark, sf), con, ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, sf, name):
    df = QUERIES[name](spark, sf)
    assert df.columns and df.count() > 0


def test_entry_module(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
