"""Fielded search where many queries ask for the same common words."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from florilege.operators import fields


def test_common_conditions_are_met_once_for_all_queries(spark):
    rows = spark.range(40_000).select("id", F.concat(F.lit("Customer number "), F.col("id").cast("string")).alias("party"), (F.col("id") % 4000).cast("string").alias("section"))
    ask = lambda no, field, op, value, negated=False: F.struct(F.lit(no).alias("cond_no"), F.lit(field).alias("field"), F.lit(op).alias("op"), value.alias("value"), F.lit(None).cast("string").alias("upto"), F.lit(negated).alias("negated"))
    three = F.array(ask(1, "party", "word", F.lit("Customer")), ask(2, "party", "prefix", F.lit("numb")), ask(3, "section", "is", (F.col("id") % 4000).cast("string")))
    asked = spark.range(5_000).select(F.col("id").alias("query_id"), F.explode(three).alias("c")).select("query_id", "c.*")
    began = time.time()
    entries = fields.index(rows, "id")
    assert fields.search(entries, "id", asked).agg(F.count(F.lit(1)), F.count_distinct("query_id")).first()[:] == (50_000, 5_000)
    assert fields.counts(entries, "id", asked).where("n = 10").count() == 5_000
    assert time.time() - began < 60


def test_sets_keep_negations_and_impossible_conditions(spark):
    rows = spark.createDataFrame([(1, "Asha Rao", "F"), (2, "Asha Menon", "O"), (2, "Asha Menon", "O")], "id long, party string, type string")
    asked = spark.createDataFrame([
        (1, 1, "party", "word", "asha", None, False), (1, 2, "type", "is", "f", None, True),
        (2, 1, "party", "word", "asha", None, False), (2, 2, "type", "is", "f", None, True),
        (3, 1, "party", "word", "asha", None, False), (3, 2, "date", "between", "x", "y", False),
        (4, 1, "type", "is", "f", None, True),
        (5, 1, "party", "prefix", "as", None, False),
        (6, 1, "party", "word", "asha", None, False), (6, 2, "party", "word", "asha", None, True),
    ], "query_id long, cond_no int, field string, op string, value string, upto string, negated boolean")
    found = fields.search(fields.index(rows, "id"), "id", asked)
    assert sorted(tuple(r) for r in found.collect()) == [(1, 2), (2, 2)]
