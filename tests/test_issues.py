"""Statements of issues."""

from __future__ import annotations

import pytest

from florilege.operators import issues


def found(text):
    return [(s, via) for _, s, via in issues.statements(text)]


ASKED = "the notice was served upon the tenant before the suit"


@pytest.mark.parametrize("opening", ["The question that arises for consideration is whether", "The short point which falls for determination is whether", "The only issue before us is whether", "The controversy in this appeal is whether", "The question of law is whether"])
def test_forms_that_announce(opening):
    assert found(f"The facts are plain. {opening} {ASKED}. We think so.") == [(f"{opening} {ASKED}.", "announced")]


def test_questions_and_their_places():
    text = f"It was cold. Whether\n{ASKED}? Nobody knows. Can a court in such a case refuse to hear the tenant?"
    assert found(text) == [(f"Whether {ASKED}?", "question"), ("Can a court in such a case refuse to hear the tenant?", "question")]
    assert all(" ".join(text[at : at + len(s)].split()) == s for at, s, _ in issues.statements(text))


def test_lists_are_split_and_points_within_points_stay():
    text = f"The following issues arise: (i) whether {ASKED}; (ii) whether the rent (a) as agreed and (b) as paid was in arrears; and (iii) whether costs are to be paid by the landlord."
    assert found(text) == [(f"whether {ASKED}", "point"), ("whether the rent (a) as agreed and (b) as paid was in arrears", "point"), ("whether costs are to be paid by the landlord.", "point")]


@pytest.mark.parametrize(
    "text",
    [
        "The question of limitation was not pressed by the learned counsel at all.", "The question is not whether the notice was served upon the tenant before the suit.", f"The question is whether {ASKED} in view of (2001) 4 SCC 12.",
        f"Dismissing the appeal, the Court said. The question is whether {ASKED}.", "Is it so?", "The question is whether " + "very " * 60 + "long.", "", "No question here at all.", f"Islands matter: {ASKED}?",
    ],
)
def test_what_states_no_issue(text):
    assert found(text) == []


def test_once_is_enough():
    assert len(found(f"Whether {ASKED}? We ask again. Whether {ASKED}?")) == 1


def test_columns(spark):
    rows = issues.issues(spark.createDataFrame([(1, f"Whether {ASKED}?"), (2, None), (3, "none")], "id long, t string"), "id", "t").collect()
    assert [tuple(r) for r in rows] == [(1, 1, 0, f"Whether {ASKED}?", "question")]
