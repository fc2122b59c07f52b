"""Sets of terms met in place: stems as the SQL has them, and texts that pay for what they hold alone."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from florilege.operators import lexical as lx


def test_stems_are_those_of_the_sql(spark, monkeypatch):
    monkeypatch.setattr(lx, "MOST_KNOWN", 50)
    rng = random.Random(2)
    ends = ["ing", "ies", "ed", "s", "ss", "us", "is", "", "x", "9"]
    words = ["".join(rng.choice("abes7") for _ in range(rng.randrange(0, 5))) + rng.choice(ends) for _ in range(600)]
    want = [r["x"] for r in spark.createDataFrame(list(enumerate(words)), "i int, w string").orderBy("i").select(F.expr(lx.stem_sql("w")).alias("x")).collect()]
    known = lx.Stems()
    assert [known[w] for w in words] == want and len(known) <= 50


class Counted(dict):
    looked = 0

    def get(self, key, default=None):
        Counted.looked += 1
        return super().get(key, default)


def test_sets_of_a_common_first_term_are_not_walked():
    sets = [["the", f"w{i}", "x"] for i in range(5000)] + [["the"], ["the", "w7"], ["q"]]
    index = {k: Counted(v) for k, v in lx.by_first(sets).items()}
    held = {"the": [0], "w7": [1], "x": [2], "none": [3]}
    assert sorted(lx.whole_sets(held, index)) == [["the"], ["the", "w7"], ["the", "w7", "x"]]
    assert Counted.looked <= 2 * len(held)


def test_texts_of_equal_keys_are_one(spark):
    docs = spark.createDataFrame([(1, "a x b"), (1, "Bs a"), (2, None), (3, "é A"), (None, "a b")], "id long, t string")
    asked = spark.createDataFrame([(9, "a"), (9, "b"), (8, "a"), (8, "b"), (7, "bs"), (6, "none")], "q long, term string")
    for block in (200_000, 1):
        got = lx.cover_rarest(docs, ["id"], "t", asked, "q", 3, 5)
        index = lx.positions(docs, ["id"], "t")
        want = lx.cover_search(index, ["id"], lx.rarest(asked, "q", index, ["id"], 3), "q", 5)
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
