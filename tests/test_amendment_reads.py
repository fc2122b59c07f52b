"""Amendment notes at scale: literals before patterns, only the fields asked for, one deal of the events."""

from __future__ import annotations

import random
import re
import sys
from datetime import date

from pyspark.sql import functions as F

from florilege.operators import amendments as am

WORDS = (
    "Ins. ins İns. iNS added Added by By by, ibid ibid. ſubs. Subs. Subs subs, substituted rep. Rep. rep.by re-numbered renumbered relettered re- omitted omitted, vide notif notıf. notification "
    "Act Delhi Act, 91 of 1976 9 of 12345 s. S. ſ. ss. s.12A 12A (a) (s. .s. s(. 1. 2. 3 4 10. (w.e.f. W.E.F. w.e.f.1-2-1990) 1- 8- 31-2-2019 1976). for For “x y” \"or\" . ) .) ٣. The"
).split()


def plain_entries(note: str) -> list[tuple[int, str]]:
    flat, begins = " ".join(note.split()), []
    for found in re.finditer(r"(?<!\S)(\d{1,2})\.? ", flat):
        before = flat[: found.start()].rstrip()
        word = before.rpartition(" ")[2].lstrip("(").lower()
        if before and (before[-1] not in ".)" or word.rstrip(".") in am.TAKES_NUMBER):
            continue
        if not begins or int(found[1]) > begins[-1][0]:
            begins.append((int(found[1]), found.start(), found.end()))
    if not begins:
        return [(1, flat)] if flat else []
    return [(n, flat[end:stop].strip()) for (n, _, end), stop in zip(begins, [b[1] for b in begins[1:]] + [len(flat)], strict=True)]


def texts(n: int) -> list[str]:
    rng = random.Random(5)
    return [rng.choice((" ", " ", "  ", "\xa0")).join(rng.choice(WORDS) for _ in range(rng.randrange(14))) for _ in range(n)]


def test_places_to_look_at_lose_no_match():
    def span(found):
        return found and (found.span(), found.groups())

    seen = set()
    for text in texts(20000):
        low = am.lower(text)
        assert len(low) == len(text)
        for pattern, head in ((am.DAY, "w.e.f."), (am.SECTION, "s."), (am.REPLACED, "for")):
            found = pattern.search(text)
            assert span(found) == span(am.found_at(pattern, head, text, low)), text
            seen |= {head} if found else set()
        want = next((name for name, verb, _ in am.VERBS if verb.search(text)), None)
        assert am.event(text) == want, text
        seen.add(want)
        assert am.entries(text) == plain_entries(text), text
        assert bool(am.act(text)) == bool(am.ACT.search(text))
    assert seen == {"w.e.f.", "s.", "for", None} | {name for name, _, _ in am.VERBS}


def test_lower_knows_all_letters_that_pass_as_plain_ones():
    every = "".join(chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000)
    low = am.lower(every)
    assert len(low) == len(every)
    for letter in "abcdefghijklmnopqrstuvwxyz":
        assert all(low[m.start()] == letter for m in re.finditer(letter, every, re.IGNORECASE))


def test_dated_fields_are_those_of_the_whole_reading(spark):
    at = [list(am.FIELDS).index(name) for name in am.DATED]
    for text in texts(3000):
        assert am.dated(text) == [tuple(row[i] for i in at) for row in am.read(text)]
    notes = spark.createDataFrame(list(enumerate([*texts(300), None, ""])), "id long, note string")
    whole, part = am.events(notes, "note"), am.events(notes, "note", am.DATED)
    assert whole.columns == ["id", *am.FIELDS] and part.columns == ["id", *am.DATED]
    assert sorted(map(repr, whole.select(part.columns).collect())) == sorted(map(repr, part.collect()))
    assert am.events(notes.where("note = ''"), "note").count() == 0


def test_events_are_read_in_batches_and_dealt_once(spark):
    notes = spark.createDataFrame([(1, "1. Ins. by Act 1 of 1950, s. 2 (w.e.f. 1-1-1950).")], "id long, note string")
    plan = am.intervals(am.events(notes, "note", am.DATED), ["id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("ArrowEvalPython") == 1


def test_a_day_asked_twice_is_answered_twice(spark):
    versions = spark.createDataFrame([(1, 1, date(1950, 1, 1), date(1959, 12, 31), "in"), (1, 2, date(1960, 1, 1), None, "out")], "id long, version int, valid_from date, valid_to date, standing string")
    asked = spark.createDataFrame([(1, date(1955, 1, 1)), (1, date(1955, 1, 1)), (1, date(1970, 1, 1)), (1, None), (None, date(1955, 1, 1)), (2, date(1955, 1, 1))], "id long, day date")
    got = am.in_force(asked, ["id"], F.col("day"), versions)
    assert got.columns == ["id", "day", "version", "standing"]
    assert sorted((r["id"] or 0, r["version"], r["standing"]) for r in got.collect()) == [(0, 0, "in"), (1, 0, "in"), (1, 1, "in"), (1, 1, "in"), (1, 2, "out"), (2, 0, "in")]
