"""Which pairs of names and titles reach the exact measure."""

from __future__ import annotations

from florilege.operators import lexical as lx


def _all_alike(batches):
    for batch in batches:
        yield batch.drop(columns=["_asked", "_words"]).assign(similarity=1.0)


def test_pairs_that_cannot_be_alike_are_not_measured(spark, monkeypatch):
    monkeypatch.setattr(lx, "_similar", _all_alike)
    asked = spark.createDataFrame([(1, ["state", "kaveri", "mills"])], "query_id long, words array<string>")
    titles = spark.createDataFrame([(1, ["the", "state", "kaveri", "mill", "x"]), (2, ["state", "zzz"]), (3, ["state", "of", "punjab"]), (4, ["mills", "x"])], "title_id long, words array<string>")
    assert sorted(r["title_id"] for r in lx.similar_titles(asked, titles).collect()) == [1]
    more = titles.unionByName(spark.createDataFrame([(i, ["mills", "kaveri"]) for i in range(5, 9)], titles.schema)).unionByName(spark.createDataFrame([(9, ["state", "kaveri", "mills", "ltd"])], titles.schema))
    assert {r["title_id"] for r in lx.similar_titles(asked, more).collect()} == {1, 9}
