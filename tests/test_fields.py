"""Fielded search against a plain version."""

from __future__ import annotations

import datetime
import random
import re

import pytest
from pyspark.sql import functions as F

from florilege.operators import fields as fi


@pytest.mark.parametrize(
    "text,want",
    [
        ("W.P./12/2001", ("WP", 12, 2001)), ("w.p. 12 of 2001", ("WP", 12, 2001)), ("CRM-M-39444-2022", ("CRMM", 39444, 2022)), ("Cr. Misc. 0012 OF 1999", ("CRMISC", 12, 1999)), ("WP 12/2001", ("WP", 12, 2001)),
        ("/12/2001", ("", 12, 2001)), ("12/2001", None), ("12/3456/2019", None), ("WP/12/1899", None), ("WP/12345678/2001", None), ("", None), ("word", None), ("WP 12 of 20010", None),
    ],
)
def test_case_numbers(spark, text, want):
    got = spark.createDataFrame([(text,)], "x string").select(fi.case_number(F.col("x")).alias("n")).first()["n"]
    assert (got and tuple(got)) == want


key = lambda x: re.sub("[^A-Za-z0-9]", "", x).upper()
words = lambda x: re.findall("[a-z0-9]+", (x or "").lower())


def holds(row, field, op, value, upto):
    held = row[field]
    if held is None:
        return False
    if op == "is":
        return key(held) == key(value)
    if op == "word":
        return value.lower() in words(held)
    if op == "prefix":
        return any(w.startswith(value.lower()) for w in words(held))
    if op == "between":
        return datetime.date.fromisoformat(value) <= held <= datetime.date.fromisoformat(upto)
    return held.upper().endswith(value.upper())


def test_queries_against_a_plain_version(spark):
    rng = random.Random(4)
    pick = lambda *x: rng.choice([None, *x])
    rows = [
        {"id": i, "party": pick("Rao & Sons", "State of X", "rao"), "judge": pick("A. Khanna", "Khan"), "cite": pick("(2001) 4 SCC 2", "2001 4 scc 2", "AIR 9"), "caseno": pick("WP/7/2001", "WP/17/2001", "CR/7/2001"), "court": pick("High", "LOW"), "date": pick(*[datetime.date(2001, m, d) for m in (1, 2, 3) for d in (1, 28)]), "type": pick("order", "Judgment")}
        for i in range(200)
    ]
    df = spark.createDataFrame(rows, "id long, party string, judge string, cite string, caseno string, court string, date date, type string")
    pool = [("party", "word", "RAO", None), ("party", "prefix", "sta", None), ("judge", "prefix", "khan", None), ("judge", "word", "khan", None), ("cite", "is", "2001 (4) SCC 2", None), ("caseno", "caseno", "/7/2001", None), ("caseno", "caseno", "WP/7/2001", None), ("court", "is", "high", None), ("date", "between", "2001-01-28", "2001-03-01"), ("date", "between", "2001-02-02", "2001-02-27"), ("type", "is", "ORDER", None)]
    conditions = []
    for q in range(60):
        for no, c in enumerate(rng.sample(pool, rng.randrange(1, 4))):
            conditions.append((q, no, *c, rng.random() < 0.3))
    conditions.append((99, 0, "date", "between", "oops", "2001-01-01", False))
    asked = spark.createDataFrame(conditions, "query_id long, cond_no int, field string, op string, value string, upto string, negated boolean")
    found = fi.search(fi.index(df, "id"), "id", asked)
    got = {tuple(r) for r in found.collect()}
    want, outcome = set(), {99: "no_match"}
    for q in range(60):
        own = [c for c in conditions if c[0] == q]
        if all(c[6] for c in own):
            outcome[q] = "refused"
            continue
        hits = {(q, r["id"]) for r in rows if all(holds(r, *c[2:6]) != c[6] for c in own)}
        want |= hits
        outcome[q] = "matched" if hits else "no_match"
    assert got == want and len(want) > 100
    assert {r["query_id"]: r["outcome"] for r in fi.outcomes(asked, found).collect()} == outcome and set(outcome.values()) == {"refused", "no_match", "matched"}


def test_queries_meet_rows_by_equi_joins(spark):
    asked = spark.createDataFrame([(1, 1, "party", "word", "x", None, False)], "query_id long, cond_no int, field string, op string, value string, upto string, negated boolean")
    rows = spark.createDataFrame([(1, "x")], "id long, party string")
    plan = fi.search(fi.index(rows, "id"), "id", asked)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
