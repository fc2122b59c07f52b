"""Nearest markers and rising headings against plain versions."""

from __future__ import annotations

import itertools
import random

from florilege.operators import markers as mk


def plain(spans, marks, guards, reach):
    out = []
    for k, a, b in sorted(set(spans)):
        best = None
        for k2, c, d, label in marks:
            if k2 != k:
                continue
            side = "before" if c < a else "behind"
            gap = a - d if side == "before" else c - b
            between = (c, a) if side == "before" else (a, c)
            if gap > reach or any(g == k and between[0] < s < between[1] for g, s, _ in guards):
                continue
            rank = (gap, side == "behind")
            if best is None or rank < best[0]:
                best = (rank, (k, a, b, label, c, gap, side))
        if best:
            out.append(best[1])
    return out


def test_nearest_against_all_pairs(spark):
    rng = random.Random(5)
    spans, marks, guards = [], [], []
    for key in range(40):
        at = 0
        for _ in range(rng.randrange(25)):
            at += rng.randrange(1, 60)
            end = at + rng.randrange(1, 9)
            kind = rng.choice("smmg")
            (spans.append((key, at, end)) if kind == "s" else marks.append((key, at, end, f"m{at}")) if kind == "m" else guards.append((key, at, end)))
            at = end
    frame = lambda rows, more="": spark.createDataFrame(rows, f"id long, start int, end int{more}")
    for reach in (10, 70):
        for held in (guards, []):
            got = mk.nearest(frame(spans + spans[:3]), frame(marks, ", label string"), frame(held) if held else None, "id", reach)
            assert sorted(tuple(r) for r in got.collect()) == plain(spans, marks, held, reach)


def test_longest_rise_against_all_subsequences():
    rng = random.Random(3)
    for _ in range(200):
        keys = [(rng.randrange(6), rng.choice(["", "A"])) for _ in range(rng.randrange(9))]
        got = [keys[i] for i in mk.longest_rise(keys)]
        most = max(n for n in range(len(keys) + 1) for c in itertools.combinations(keys, n) if all(a < b for a, b in zip(c, c[1:])))
        assert len(got) == most and all(a < b for a, b in zip(got, got[1:]))


def test_contents_and_strays_fall_away(spark):
    text = "Contents\n1. Names\n2. Rent\n3. Courts\n1. Names\nThe words.\n2. Rent\n900. See the act of 1900\n2A. More rent\n 10 pieces\n3. Courts\nEnd\n"
    rows = mk.ascending(spark.createDataFrame([(1, text), (2, None), (3, "no headings 1. x")], "id long, t string"), "id", "t").orderBy("place").collect()
    assert [(r["id"], r["number"], r["suffix"], r["title"]) for r in rows] == [(1, 1, "", "Names"), (1, 2, "", "Rent"), (1, 2, "A", "More rent"), (1, 3, "", "Courts")]
    assert rows[-1]["start"] + rows[-1]["size"] == len(text)


def test_suffixes_rise():
    keys = [(9, 0, ""), (9, 1, "A"), (9, 1, "B"), (9, 2, "AA"), (10, 0, "")]
    assert mk.longest_rise(keys) == [0, 1, 2, 3, 4] and mk.longest_rise([]) == []
