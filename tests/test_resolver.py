"""States of references, edges resolved anew, effects."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from florilege.operators import resolver as rs


@pytest.mark.parametrize("raw,why", [("2024 INSC 554", None), ("", "empty"), ("  ", "empty"), (None, "empty"), ("AIR 1", "short"), ("x1" * 30, "long"), ("no digits here", "no digit"), ("1234567", "no letter")])
def test_keys_that_cannot_be(spark, raw, why):
    assert spark.createDataFrame([(raw,)], "r string").select(rs.refusal(F.col("r"))).first()[0] == why


def test_the_seven_states(spark):
    refs = spark.createDataFrame([(1, "2001 SCC 1"), (2, "2001 SCC 2"), (3, "2001 SCC 3"), (4, "2001 SCC 4"), (5, "2001 SCC 5"), (6, "2001 SCC 6"), (7, "??")], "id long, raw string")
    index = spark.createDataFrame([("2001SCC1", 10, "a"), ("2001SCC2", 20, "b"), ("2001SCC3", 30, "c"), ("2001SCC4", 40, "a"), ("2001SCC4", 41, "a"), ("2001SCC5", 5, "a"), ("2001SCC5", 5, "a")], "key string, target long, cohort string")
    cohorts = spark.createDataFrame([("a", 5, 5, 0), ("b", 5, 4, 0), ("c", 5, 4, 1)], "cohort string, declared long, held long, unread long")
    got = {r["id"]: (r["state"], r["target"]) for r in rs.resolve(refs, "raw", "id", index, cohorts).collect()}
    assert got == {1: ("UNIQUE", 10), 2: ("UNIQUE_UNCONFIRMED_COHORT", 20), 3: ("UNIQUE_UNCONFIRMED_STALE_INDEX", 30), 4: ("AMBIGUOUS", None), 5: ("SELF_REFERENCE", None), 6: ("TARGET_NOT_HELD", None), 7: ("REFUSED", None)}
    assert {s for s, _ in got.values()} == set(rs.STATES)


def test_edges_are_resolved_once(spark):
    rows = [(1, "2001 SCC 1", None), (2, "2001 SCC 1", 99), (10, "2001 SCC 1", None), (3, "1999 SCC 1", None), (4, "SCC ONE 1", None), (5, "2002 SCC 2", None), (6, "2002 SCC 9", None), (7, "", None), (8, None, None)]
    edges = spark.createDataFrame(rows, "source long, cited string, target long")
    index = spark.createDataFrame([("2001SCC1", 10, [2001]), ("1999SCC1", 11, [2001]), ("SCCONE1", 12, [2001]), ("2002SCC2", 13, [2002]), ("2002SCC2", 14, [2002])], "key string, target long, years array<int>")
    first = rs.reresolve(edges, index)
    got = {r["source"]: (r["verdict"], r["target"]) for r in first.collect()}
    assert got == {1: ("resolved", 10), 2: ("kept", 99), 10: ("self_reference", None), 3: ("year_guard", None), 4: ("no_year", None), 5: ("several_targets", None), 6: ("not_held", None), 7: ("cites_nothing", None), 8: ("cites_nothing", None)}
    again = {r["source"]: (r["verdict"], r["target"]) for r in rs.reresolve(first.drop("verdict"), index.withColumn("target", F.col("target") + 1)).collect()}
    assert again[1] == ("kept", 10) and again[2] == ("kept", 99)


@pytest.mark.parametrize(
    "status,edges,effect",
    [
        ("none", [("overruled", False)], "none"), ("set_aside", [], "set_aside"), ("partly_set_aside", [], "partly_set_aside"), ("doubted", [], "doubted"), ("set_aside", [("followed", False)], "set_aside"),
        ("set_aside", [("overruled", True)], "evidence_defect"), ("set_aside", [("overruled", True), ("doubted", False)], "review_required"), ("set_aside", [("overruled", False), ("doubted", False)], "set_aside"),
        ("partly_set_aside", [("doubted", False)], "review_required"), ("partly_set_aside", [("overruled", False)], "set_aside"), ("doubted", [("overruled_in_part", False)], "partly_set_aside"),
    ],
)
def test_effects(spark, status, edges, effect):
    told = spark.createDataFrame([(1, r, d) for r, d in edges], "k long, relationship string, defect boolean")
    assert rs.effects(spark.createDataFrame([(1, status)], "k long, status string"), told, "k").first()["effect"] == effect


def test_days_before_years(spark):
    d = datetime.date
    rows = [(d(2000, 6, 1), None, d(2000, 7, 1), 2000), (d(2000, 8, 1), None, d(2000, 7, 1), 2000), (None, 2000, d(2000, 7, 1), None), (d(2000, 6, 1), None, None, 2000), (d(1999, 6, 1), None, None, 2000)]
    df = spark.createDataFrame(rows, "day date, year int, enacted date, act int")
    assert [r[0] for r in df.select(rs.in_time(F.col("day"), F.col("year"), F.col("enacted"), F.col("act"))).collect()] == [False, True, True, True, False]


def test_rows_without_a_key_are_no_hot_group(spark):
    edges = spark.range(20_000).select(F.col("id").alias("source"), F.when(F.col("id") % 2 == 0, "").otherwise("2001 SCC 1").alias("cited"), F.when(F.col("id") % 4 < 3, F.lit(7)).cast("long").alias("target"))
    assert edges.select(rs._apart(F.when(F.col("cited") != "", F.lit(None).cast("string")), edges.columns).alias("k")).groupBy("k").count().agg(F.max("count")).first()[0] == 1
    index = spark.createDataFrame([("2001SCC1", 10, [2001])], "key string, target long, years array<int>")
    got = {r["verdict"]: r["count"] for r in rs.reresolve(edges, index).groupBy("verdict").count().collect()}
    assert got == {"kept": 15_000, "resolved": 5_000}


def test_years_of_many_targets_are_not_gathered(spark):
    index = spark.range(1000).select(F.lit("2001SCC1").alias("key"), F.col("id").alias("target"), F.array((F.lit(1900) + F.col("id").cast("int"))).alias("years"))
    edges = spark.createDataFrame([(1, "2001 SCC 1", None)], "source long, cited string, target long")
    assert rs.reresolve(edges, index).first()["verdict"] == "several_targets"
