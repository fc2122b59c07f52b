"""Roles of spans by the voice before them."""

from __future__ import annotations

import datetime

import pytest

from florilege.operators import roles
from florilege.operators.spans import Source

TEXT = """The petitioner was dismissed from service. Learned counsel for the petitioner urged that the inquiry was bad in law and prays that the
order be set aside. Per contra, it is argued that the inquiry was fair. Having heard both sides, we are of the opinion that no notice was given to
him. In an earlier case the bench observed as follows: "a notice is the soul of an inquiry". The present inquiry had no such soul. The question is
whether the order can stand. The inquiry began on 4.5.2010. In the result the order of dismissal is set aside."""


def verdict(role, span, unsafe=False, decided=None, text=TEXT):
    source = Source(text)
    return roles.verify(role, span, source, roles.voices(source.flat), unsafe, decided)[:2]


@pytest.mark.parametrize(
    "role,span,want",
    [
        ("holding", "no notice was given to him", ("accepted", "court")), ("holding", "the inquiry was bad in law", ("mismatch", "submission")), ("holding", "the inquiry was fair", ("mismatch", "submission")),
        ("argument_petitioner", "the inquiry was bad in law", ("accepted", "submission")), ("argument_respondent", "no notice was given to him", ("mismatch", "court")), ("relief", "order be set aside", ("accepted", "submission")),
        ("reasoning", "a notice is the soul of an inquiry", ("mismatch", "quotation")), ("reasoning", "The present inquiry had no such soul", ("accepted", "court")),
        ("relief_granted", "the order of dismissal is set aside", ("accepted", "operative")), ("relief", "the order of dismissal is set aside", ("mismatch", "operative")), ("relief_granted", "no notice was given to him", ("mismatch", "court")),
        ("issue", "whether the order can stand", ("accepted", "asks")), ("issue", "no notice was given to him", ("mismatch", "states")),
        ("procedural_event", "The inquiry began on 4.5.2010", ("accepted", "day")), ("procedural_event", "no notice was given to him", ("unproven", "no_day")),
        ("holding", "The petitioner was dismissed from service", ("unproven", "no_voice")), ("headline", "no notice was given to him", ("unproven", "unknown_role")), ("holding", "the moon is made of cheese and nothing else", ("unsupported", "absent")),
    ],
)
def test_verdicts(role, span, want):
    assert verdict(role, span) == want


def test_no_span_is_a_holding_and_an_argument():
    for span in ("the inquiry was bad in law", "no notice was given to him", "the order of dismissal is set aside"):
        assert [verdict(r, span)[0] for r in ("holding", "argument_petitioner")].count("accepted") == 1


def test_days_after_the_decision_and_unsafe_documents():
    assert verdict("procedural_event", "The inquiry began on 4.5.2010", decided=datetime.date(2009, 1, 1)) == ("mismatch", "after_decision")
    assert verdict("procedural_event", "The inquiry began on 4.5.2010", decided=datetime.date(2011, 1, 1)) == ("accepted", "day")
    assert verdict("holding", "no notice was given to him", unsafe=True) == ("damaged", "unsafe") and verdict("holding", "x", text="") == ("damaged", "empty")


def test_voices_end_with_their_reach():
    text = "We hold that this is so. " + "word " * 130 + "The far span stands here."
    assert verdict("holding", "The far span stands here", text=text) == ("unproven", "no_voice")


def test_columns(spark):
    rows = [(1, TEXT, False, None, [("holding", "no notice was given to him"), ("issue", None)]), (2, None, None, datetime.date(2020, 1, 1), [("holding", "x")]), (3, "text", False, None, None)]
    df = spark.createDataFrame(rows, "id long, text string, unsafe boolean, decided date, claims array<struct<role:string,span:string>>")
    got = {(r["id"], r["claim_no"]): (r["verdict"], r["start"] is not None) for r in roles.verified(df, "id").collect()}
    assert got == {(1, 0): ("accepted", True), (1, 1): ("unsupported", False), (2, 0): ("damaged", False)}
