"""Passages are read once: phrases without patterns, values that a plan does not write out again."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from florilege.functions import passages
from florilege.plans.registry import QUERIES


def test_literals_are_all_that_the_patterns_match(spark):
    rng = random.Random(3)
    words = sorted({w for pattern, _ in passages.TREATMENTS for p in passages.literals(pattern) for w in p.split()})
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 9))) for _ in range(2000)] + [f"x {p.upper()} y" for pattern, _ in passages.TREATMENTS for p in passages.literals(pattern)]
    assert all(re.fullmatch(pattern, p) for pattern, _ in passages.TREATMENTS for p in passages.literals(pattern))
    want = [next((name for pattern, name in passages.TREATMENTS if re.search(pattern, t)), "cites") for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", passages.treatment(F.lower("t")).alias("x"))
    assert [r["x"] for r in df.orderBy("i").collect()] == want and len(set(want)) == 7


def test_the_plan_reads_a_line_once(spark, sf):
    plan = QUERIES["ref_paragraph_numbers"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("case law cited") == 1
    plan = QUERIES["ref_treatments"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("split(") == 2
