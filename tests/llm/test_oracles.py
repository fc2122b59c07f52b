from __future__ import annotations

import pytest

from florilege.llm.queries import ORACLE_SQL, QUERIES
from tests.oracle import connect, same


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_oracle(spark, sf, name):
    same(QUERIES[name](spark, sf), connect(sf), ORACLE_SQL[name])
