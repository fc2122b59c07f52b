"""Cover-density search by sets of rarest terms against the search by positions."""

from __future__ import annotations

import random

import pytest

from florilege.operators import lexical as lx


@pytest.mark.parametrize("block", [200_000, 7])
def test_sets_give_what_positions_give(spark, monkeypatch, block):
    monkeypatch.setattr(lx, "BROADCAST_SETS", block)
    rng = random.Random(4)
    pool = [f"w{i}" for i in range(25)] + ["the"] * 8
    docs = [(i, rng.choice((0, 1)), " ".join(rng.choice(pool) for _ in range(rng.randrange(0, 30)))) for i in range(120)] + [(300, 0, None), (7, 1, "the w1 w2")]
    asked = [(q, w) for q in range(40) for w in rng.sample(pool + ["none"], rng.randrange(1, 6))]
    df = spark.createDataFrame(docs, "id long, part int, t string")
    queries = spark.createDataFrame(asked, "q long, term string")
    keys, index = ["id", "part"], lx.positions(df, ["id", "part"], "t")
    got = lx.cover_rarest(df, keys, "t", queries, "q", 3, 4)
    want = lx.cover_search(index, keys, lx.rarest(queries, "q", index, keys, 3), "q", 4)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_only_the_best_of_a_task_leave_it(spark):
    df = spark.createDataFrame([(1, "a b c")], "id long, t string")
    queries = spark.createDataFrame([(1, "a"), (1, "b")], "q long, term string")
    plan = lx.cover_rarest(df, ["id"], "t", queries, "q", 3, 4)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "BroadcastHashJoin" in plan
