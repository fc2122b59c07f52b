"""The vector index against exact search."""

from __future__ import annotations

import numpy as np
import pytest

from florilege.operators import vector_index as vi

DIM = 12


def data(seed=0, n=1500):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(20, DIM))
    rows = []
    for i in range(n):
        v = centres[i % 20] + 0.4 * rng.normal(size=DIM)
        rows.append((i, [float(x) for x in v], 0 if i % 300 else 7, "x"))
    rows += [(9000 + i, rows[3][1], 0, "x") for i in range(300)]  # a list of copies
    return rows


BAD = [(9501, None, 0, "x"), (9502, [], 0, "x"), (9503, [float("nan")] * DIM, 0, "x"), (9504, [None] * DIM, 0, "x"), (9505, [float("inf")] * DIM, 0, "x")]


def exact(rows, q, k, wanted):
    vec = np.array(next(v for i, v, _, _ in rows if i == q))
    best = sorted((-float(np.dot(vec, v)), i) for i, v, t, _ in rows if i != q and (wanted is None or t == wanted))
    return [i for _, i in best[:k]]


@pytest.fixture(scope="module")
def built(spark):
    rows = data()
    df = spark.createDataFrame(rows + BAD, "id long, v array<double>, t int, score string").repartition(4)
    return rows, df, vi.build(df, "id", "v", "t", "test-vector-index")


def found(spark, built, asked, k=10, **more):
    rows, df, index = built
    queries = spark.createDataFrame([(q, next((v for i, v, _, _ in rows + BAD if i == q), None), w) for q, w in asked], "query_id long, q array<double>, wanted long")
    out = {}
    for r in vi.search(index, df, "id", "v", queries, k, **more).orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append(r)
    return out


def test_recall_without_and_with_a_filter(spark, built):
    rows = built[0]
    asked = [(q, None) for q in range(0, 1500, 50)] + [(q, 7) for q in range(1, 1500, 150)]
    got = found(spark, built, asked)
    hits = {w: [len({r["key"] for r in got[q]} & set(exact(rows, q, 10, w))) for q, x in asked if x == w] for w in (None, 7)}
    assert sum(hits[None]) >= 0.9 * 10 * len(hits[None])
    for q, w in asked:
        keys = [r["key"] for r in got[q]]
        assert len(keys) == len(set(keys)) == min(10, sum(1 for i, _, t, _ in rows if i != q and (w is None or t == w))) and q not in keys
        assert [r["score"] for r in got[q]] == sorted((r["score"] for r in got[q]), reverse=True)
    # five vectors have the tag, so all lists are read and the result is exact
    assert all([r["key"] for r in got[q]] == exact(rows, q, 10, 7) for q, w in asked if w == 7)


def test_a_narrow_search_goes_on_until_it_has_enough(spark, built):
    rows = built[0]
    got = found(spark, built, [(1, 7), (2, 99), (50, None)], probes=1)
    assert {r["key"] for r in got[1]} == {i for i, _, t, _ in rows if t == 7}
    assert 2 not in got and len(got[50]) == 10


def test_scores_are_those_of_the_vectors(spark, built):
    vec = {i: v for i, v, _, _ in built[0]}
    for r in found(spark, built, [(10, None)])[10]:
        assert r["score"] == pytest.approx(float(np.dot(vec[10], vec[r["key"]])))


def test_bad_vectors_take_no_part(spark, built):
    got = found(spark, built, [(9501, None), (9502, None), (9503, None), (9504, None), (9505, None), (3, None)])
    assert set(got) == {3} and not {r["key"] for r in got[3]} & {b[0] for b in BAD}


def test_an_index_is_opened_again(spark, built):
    again = vi.open_index(spark, "test-vector-index")
    assert again.probes == built[2].probes and np.array_equal(again.centres, built[2].centres)
    rows, df, _ = built
    a = found(spark, built, [(20, None)])[20]
    assert [tuple(r) for r in found(spark, (rows, df, again), [(20, None)])[20]] == [tuple(r) for r in a]


def test_blocks_are_bounded(spark, built, monkeypatch):
    monkeypatch.setattr(vi, "BLOCK", 50)
    index = vi.build(built[1], "id", "v", "t", "test-vector-blocks")
    assert max(len(r["held"]) for r in index.blocks(spark).collect()) < 120


def test_an_empty_table(spark):
    df = spark.createDataFrame([], "id long, v array<double>, t int")
    index = vi.build(df, "id", "v", "t", "test-vector-empty")
    asked = spark.createDataFrame([(1, [1.0], None)], "query_id long, q array<double>, wanted long")
    assert vi.search(index, df, "id", "v", asked, 3).count() == 0


def test_agreement(spark):
    one = spark.createDataFrame([(1, k, s, r) for r, (k, s) in enumerate([(10, 0.9), (11, 0.5), (12, 0.1)], 1)], "query_id long, key long, score double, rank int")
    two = spark.createDataFrame([(1, 11, 0.5, 1), (1, 10, 0.5, 2), (1, 99, 0.2, 3)], "query_id long, key long, score double, rank int")
    got = vi.agreement(one, two, 3).first()
    best, have = 0.8 + 0.4 / np.log2(3), 0.4 + 0.8 / np.log2(3)
    assert (got["overlap"], got["ties"]) == (2, 1) and got["ndcg"] == round(have / best, 6)
    assert vi.agreement(one, one, 3).first()["ndcg"] == 1


def test_recall_of_the_table(spark, sf):
    from florilege.plans.registry import QUERIES

    arms = {r["arm"]: r for r in QUERIES["eval_index_recall"](spark, sf).collect()}
    assert set(arms) == {"whole", "filtered"} and all(r["recall"] >= 0.9 for r in arms.values())
