"""Phrases and citations looked up as strings, against the patterns."""

from __future__ import annotations

import random

import pytest

from florilege.operators import headnotes, roles


def test_voices_are_those_of_the_pattern():
    rng = random.Random(5)
    parts = [p for phrases in roles.VOICES.values() for p in phrases] + ["We Hold", "x", "_", " ", " ", ". ", "held", "it is ", "it is held as under", "the petition is "]
    for k in range(3000):
        text = "".join(rng.choice(parts) + rng.choice(("", " ", " ", "s", "_", "ſ" if k % 5 == 0 else ",")) for _ in range(rng.randrange(12)))
        assert roles.voices(text) == [(m.end(), m.lastgroup, m.group().lower()) for m in roles._VOICE.finditer(text)]


def test_plain_text_needs_no_pattern(monkeypatch):
    monkeypatch.setattr(roles, "_VOICE", None)
    assert roles.voices("We hold that. Weholds we hold") == [(7, "court", "we hold"), (29, "court", "we hold")]


@pytest.mark.parametrize("text", ["a v. b [1950] 1 S.C.R. Digital", "AIR 1950 SC 1", "x AIR 1950 SC 1", "(a) b v. c [1] (1999) 1 SCC 2", "FAIR 1950 SC 1 no AIR 1951 SC 2", "[", ""])
def test_citations_are_found_where_the_pattern_finds_them(text):
    begins = [at for at in map(text.find, ("[", "(", "AIR")) if at >= 0]
    got = headnotes._CITED.search(text, min(begins)) if begins else None
    want = headnotes._CITED.search(text)
    assert (got and got.span()) == (want and want.span())


def test_parts_without_a_page_header_are_not_searched_for_one(monkeypatch):
    header = headnotes._HEADER
    monkeypatch.setattr(headnotes, "_HEADER", None)
    assert headnotes._flat(" A  v. B\n[1950] 1 SCR 2") == "A v. B [1950] 1 SCR 2"
    monkeypatch.setattr(headnotes, "_HEADER", header)
    assert headnotes._flat("A 12 [1950] 1 ſ.c.R. v. B") == "A v. B"
