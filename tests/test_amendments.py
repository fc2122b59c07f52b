"""Amendment notes: entries, events, intervals."""

from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from florilege.operators import amendments as am

FIVE = (
    "1. Ins. by Act 91 of 1976, s. 12 (w.e.f. 1-8-1976). 2. Subs. by Act 44 of 1965, s. 8, for clause (a) (w.e.f. 1-4-1966). "
    '3. Subs. by s. 8, ibid ., for "enter any pit or its office" (w.e.f. 1-4-1966). 4. Ins. by s. 8, ibid . (w.e.f. 1-4-1966). 5. The words "or its office" omitted by s. 8, ibid .'
)


def test_entries_of_a_numbered_run():
    assert [n for n, _ in am.entries(FIVE)] == [1, 2, 3, 4, 5]
    assert am.entries(FIVE)[0][1] == "Ins. by Act 91 of 1976, s. 12 (w.e.f. 1-8-1976)."


@pytest.mark.parametrize(
    "note,numbers",
    [
        ("1. Ins. by Act 91 of 1976, s. 12 (w.e.f. 1-8-1976).", [1]), ("3. Ins. by Act 8 of 2020, s. 2 and Sch. 2 (w.e.f. 01-07-2020).", [3]),
        ("1 Subs. by s. 9, ibid ., for sub-section (1) (w.e.f. 24-1-2000). 2 Subs. by Act 2 of 2000, s. 9.", [1, 2]), ("Subs. by Act 54 of 2003, s. 22.", [1]),
        ("", []), ("  \n ", []), ("2. Ins. by Act 3 of 1990, s. 4. 1 of that act. 5. Rep. by Act 1 of 1999.", [2, 5]),
    ],
)
def test_numbers_of_entries(note, numbers):
    assert [n for n, _ in am.entries(note)] == numbers


@pytest.mark.parametrize(
    "entry,day",
    [
        ("Ins. (w.e.f. 1-8-1976).", date(1976, 8, 1)), ("(w.e.f. 01-07-2026)", date(2026, 7, 1)), ("(w.e.f. 31- 10- 2019)", date(2019, 10, 31)), ("(w.e.f. 31-10- 2019)", date(2019, 10, 31)),
        ("(w.e.f. 13-1-2012)", date(2012, 1, 13)), ("Ins. by Act 11 of 1994, s. 12.", None), ("(w.e.f. 31-2-2019)", None), ("(w.e.f. 1-13-2019)", None), ("(w.e.f. 1-1-1700)", None),
    ],
)
def test_days_are_read_day_first_or_not_at_all(entry, day):
    assert am.effective_day(entry) == day


def test_acts_keep_their_prefix():
    assert am.act("Subs. by Act 45 of 1965, s. 8") == ("Act 45 of 1965", 45, 1965)
    assert am.act("Subs. by Delhi Act 12 of 2011, s. 2")[0] == "Delhi Act 12 of 2011"
    assert am.act("Subs. by s. 8, ibid .") is None


@pytest.mark.parametrize(
    "entry,kind",
    [
        ("Subs. by Act", "substituted"), ("Subs by Act", "substituted"), ("Subs. bys. 17", "substituted"), ("Subs. ibid.", "substituted"), ("substituted by", "substituted"), ("Ins. by", "inserted"), ("Added by", "inserted"),
        ("The word omitted by", "omitted"), ("omitted, ibid", "omitted"), ("Rep. by", "repealed"), ("re-numbered and ins. by", "renumbered"), ("relettered by", "renumbered"), ("vide notification No. 3", "commenced"), ("See now the Land Act, 1894 (1 of 1894).", None),
    ],
)
def test_events(entry, kind):
    assert am.event(entry) == kind


def read(spark, *notes):
    return am.events(spark.createDataFrame(list(enumerate(notes)), "id long, note string"), "note").orderBy("id", "ordinal").collect()


def test_ibid_is_the_act_before_it_and_only_that(spark):
    rows = read(spark, FIVE, "1. Subs. by s. 9, ibid. 2. Ins. by Act 2 of 2000, s. 9. 3. See now the Act.", None, "")
    assert [(r["act_number"], r["ibid"]) for r in rows if r["id"] == 0] == [(91, None), (44, None), (44, "resolved"), (44, "resolved"), (44, "resolved")]
    assert [(r["event"], r["act_number"], r["ibid"]) for r in rows if r["id"] == 1] == [("substituted", None, "open"), ("inserted", 2, None), ("unread", None, None)]
    assert rows[2]["replaced"] == "enter any pit or its office" and rows[0]["section"] == "12" and {r["id"] for r in rows} == {0, 1}


def test_intervals_and_days(spark):
    notes = ["1. Ins. by Act 1 of 1950, s. 2 (w.e.f. 1-1-1950). 2. Rep. by Act 2 of 1960 (w.e.f. 1-1-1960). 3. Subs. by Act 3 of 1960, s. 1 (w.e.f. 5-5-1970). 4. Ins. by Act 9 of 1980, s. 1.", "See now."]
    found = am.events(spark.createDataFrame(list(enumerate(notes)), "id long, note string"), "note")
    versions = am.intervals(found, ["id"])
    got = [tuple(r) for r in versions.orderBy("id", "version").collect()]
    assert got == [(0, 1, date(1950, 1, 1), date(1959, 12, 31), "in", 1), (0, 2, date(1960, 1, 1), date(1970, 5, 4), "out", 1), (0, 3, date(1970, 5, 5), None, "in", 1)]
    asked = spark.createDataFrame([(0, date(1949, 1, 1)), (0, date(1950, 1, 1)), (0, date(1965, 1, 1)), (0, date(2020, 1, 1)), (1, date(2000, 1, 1))], "id long, day date")
    assert sorted(tuple(r)[1:] for r in am.in_force(asked, ["id"], F.col("day"), versions).collect()) == [(date(1949, 1, 1), 0, "in"), (date(1950, 1, 1), 1, "in"), (date(1965, 1, 1), 2, "out"), (date(2000, 1, 1), 0, "in"), (date(2020, 1, 1), 3, "in")]
