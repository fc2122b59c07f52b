"""Names and titles whose words are alike: every pair, whatever word it shares."""

from __future__ import annotations

import random

import pytest

from florilege.operators import lexical as lx
from florilege.plans.registry import ORACLE_SQL, QUERIES
from tests.oracle import connect, same

ASKED, TITLES = "query_id long, words array<string>", "title_id long, words array<string>"


def found(spark, asked, titles):
    return sorted(tuple(r) for r in lx.alike_titles(spark.createDataFrame(asked, ASKED), spark.createDataFrame(titles, TITLES)).collect())


def test_titles_without_the_rarest_word_are_found(spark):
    asked = [(1, ["state", "kaveri", "mills"]), (2, ["kaverin"]), (3, [])]
    titles = [(1, ["the", "state", "kaveri", "mill", "x"]), (2, ["state", "zzz"]), (4, []), (5, None), *((i, ["mills", "kaveri"]) for i in range(6, 9))]
    got = found(spark, asked, titles)
    assert [(q, t) for q, t, _ in got] == [(1, 1), (1, 6), (1, 7), (1, 8), (2, 1), (2, 6), (2, 7), (2, 8)]
    assert got[1][2] == pytest.approx(13 / 19, abs=1e-6)


@pytest.mark.parametrize("tile", [(40_000, 4_000, 4, 1 << 20), (7, 13, 1, 1 << 20), (30, 90, 99, 3)])
def test_every_pair_of_a_plain_search(spark, monkeypatch, tile):
    for name, value in zip(("TILE_NAMES", "TILE_TITLES", "RARE_HITS", "MEASURED"), tile, strict=True):
        monkeypatch.setattr(lx, name, value)
    rng = random.Random(8)
    pool = ["".join(rng.choice("abcd") for _ in range(rng.randrange(1, 12))) for _ in range(40)] + ["the"]
    titles = [(i, [rng.choice(pool) for _ in range(rng.randrange(0, 9))]) for i in range(70)] + [(99, [w * 3 for w in pool[:30]])]
    asked = [(i, [w[:-1] if rng.random() < 0.3 else w for w in rng.choice(titles)[1][:3]]) for i in range(60)]
    want = sorted((q, i, round(s, 6)) for q, a in asked if a for i, t in titles if (s := lx.word_similarity(a, t)) >= 0.65)
    assert found(spark, asked, titles) == want and len(want) > 60


def test_the_query_finds_them(spark):
    folder = "/root/testdata/sf0.01"
    same(QUERIES["search_word_similarity"](spark, folder), connect(folder), ORACLE_SQL["search_word_similarity"])
    assert QUERIES["search_word_similarity"](spark, folder).count() == 183
