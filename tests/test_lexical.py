"""Stems, cover density and word similarity against plain versions."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from florilege.operators import lexical as lx


@pytest.mark.parametrize("word,stem", [("hearing", "hear"), ("ring", "ring"), ("parties", "party"), ("decided", "decid"), ("bed", "bed"), ("courts", "court"), ("bus", "bus"), ("act", "act"), ("process", "process"), ("basis", "basis"), ("acts", "act")])
def test_stems(spark, word, stem):
    assert spark.range(1).select(F.expr(lx.stem_sql(f"'{word}'"))).first()[0] == stem


def plain_covers(hits, terms):
    spans = [(a, b) for a, _ in hits for b, _ in hits if a <= b and len({t for p, t in hits if a <= p <= b}) == terms]
    return sorted(s for s in spans if not any(o != s and s[0] <= o[0] and o[1] <= s[1] for o in spans))


def test_covers_against_all_windows():
    rng = random.Random(1)
    for _ in range(300):
        terms = "abc"[: rng.randrange(1, 4)]
        hits = sorted({rng.randrange(30): rng.choice(terms) for _ in range(rng.randrange(12))}.items())
        assert lx.covers(hits, len(terms)) == plain_covers(hits, len(terms))


def test_search_ranks_close_terms_first(spark):
    docs = spark.createDataFrame([(1, "rent of the act"), (2, "rent acts"), (3, "rent only"), (4, "acts and rents, rent act"), (5, None), (6, "")], "id long, t string")
    asked = spark.createDataFrame([(10, "rent"), (10, "act"), (11, "zzz"), (12, "only")], "q long, term string")
    got = [tuple(r) for r in lx.cover_search(lx.positions(docs, ["id"], "t"), ["id"], asked, "q", 2).orderBy("q", "rn").collect()]
    assert got == [(10, 4, round(1 / 3 + 1 / 2, 6), 1), (10, 2, 0.5, 2), (12, 3, 1.0, 1)]


def test_rarest_terms_are_those_that_are_held(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "a b"), (3, "a")], "id long, t string")
    asked = spark.createDataFrame([(1, t) for t in "abcz"] + [(2, "z")], "q long, term string")
    got = sorted(tuple(r) for r in lx.rarest(asked, "q", lx.positions(docs, ["id"], "t"), ["id"], 2).collect())
    assert got == [(1, "b"), (1, "c")]


def test_word_similarity_of_extents():
    assert lx.word_similarity(["word"], ["two", "words"]) == pytest.approx(4 / 7)
    assert lx.word_similarity(["rao"], ["state", "rao", "sons"]) == 1
    assert lx.word_similarity(["rao", "sons"], ["state", "rao", "sons"]) == 1
    assert lx.word_similarity(["x"], []) == 0


def test_similar_titles_against_all_pairs_that_share_the_word(spark):
    rng = random.Random(8)
    pool = ["".join(rng.choice("abcd") for _ in range(rng.randrange(3, 8))) for _ in range(30)]
    titles = [(i, [rng.choice(pool) for _ in range(rng.randrange(1, 9))]) for i in range(80)] + [(99, [])]
    asked = [(i, [w[:-1] if rng.random() < 0.3 else w for w in rng.choice(titles)[1][:3]]) for i in range(60)]
    got = sorted(tuple(r) for r in lx.similar_titles(spark.createDataFrame(asked, "query_id long, words array<string>"), spark.createDataFrame(titles, "title_id long, words array<string>")).collect())
    want = []
    for q, words in asked:
        df = {w: sum(w in t for _, t in titles) for w in words}
        held = [(n, w) for w, n in df.items() if n]
        for i, t in titles:
            if held and min(held)[1] in t and (s := lx.word_similarity(words, t)) >= 0.65:
                want.append((q, i, round(s, 6)))
    assert got == sorted(want) and len(want) > 60


def test_pairs_are_equi_joins(spark):
    frame = lambda k: spark.createDataFrame([(1, ["a"])], f"{k} long, words array<string>")
    plan = lx.similar_titles(frame("query_id"), frame("title_id"))._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
