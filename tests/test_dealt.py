"""What a task holds does not grow with the table."""

from __future__ import annotations

import pytest

from florilege.operators import rows
from florilege.plans.registry import ORACLE_SQL, QUERIES
from tests.oracle import connect, same


@pytest.mark.parametrize("name,parts", [("retrieve_linked_documents", 60), ("graph_co_citation", 60)])
def test_tasks_get_a_bounded_number_of_rows(spark, sf, monkeypatch, name, parts):
    monkeypatch.setattr(rows, "TASK_ROWS", 100)
    df = QUERIES[name](spark, sf)
    assert "hashpartitioning(l_orderkey#" in (plan := df._jdf.queryExecution().executedPlan().toString()) and f", {parts})" in plan
    same(df, connect(sf), ORACLE_SQL[name])
