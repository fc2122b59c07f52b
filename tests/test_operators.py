"""Operators on small cases: nulls, ties, empty tables, and laws that hold for any input."""

from __future__ import annotations

import bisect
import datetime
import math
import random
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from florilege.functions import quality, signals, text
from florilege.operators import analytics, documents, evaluation, joins, retrieval, rows
from florilege.sources import tables as files


def values(df):
    return sorted(tuple(r) for r in df.collect())


def test_keyset_pages_tile_the_table(spark):
    rng = random.Random(3)
    data = [(rng.randint(1, 5), i) for i in range(40)]
    df = spark.createDataFrame(data, "t int, id int")
    seen, cursor = [], None
    while page := rows.keyset_page(df, ["t", "id"], cursor, 7).collect():
        seen += [tuple(r) for r in page]
        cursor = list(page[-1])
    assert seen == sorted(data)


def test_latest_per_group_breaks_ties(spark):
    df = spark.createDataFrame([(1, 5, 1, "a"), (1, 5, 2, "b"), (2, None, 3, "c")], "k int, t int, id int, v string")
    assert values(rows.latest_per_group(df, ["k"], ["t", "id"]).select("k", "v")) == [(1, "b"), (2, "c")]


def test_changes_and_runs_treat_null_as_a_value(spark):
    df = spark.createDataFrame([(1, 1, None), (1, 2, None), (1, 3, "x"), (1, 4, "x"), (1, 5, None)], "k int, t int, v string")
    assert [r["t"] for r in rows.changes(df, ["k"], ["t"], "v").orderBy("t").collect()] == [1, 3, 5]
    assert [r["run_length"] for r in rows.runs(df, ["k"], ["t"], "v").orderBy("run").collect()] == [2, 2, 1]


def test_as_of_join_against_bisect(spark):
    rng = random.Random(5)
    right = sorted({(rng.randint(0, 2), rng.randint(0, 60)) for _ in range(40)})
    left = [(rng.randint(0, 3), rng.randint(0, 60), i) for i in range(60)]
    l = spark.createDataFrame(left, "k int, at int, id int")
    r = spark.createDataFrame([(k, t, t * 10) for k, t in right], "k int, since int, pay int")
    got = {x["id"]: x["pay"] for x in joins.as_of(l, r, ["k"], "at", "since", ["pay"]).collect()}
    for k, at, i in left:
        mine = [t for kk, t in right if kk == k]
        j = bisect.bisect_right(mine, at) - 1
        assert got[i] == (mine[j] * 10 if j >= 0 else None)


def test_interval_join_against_pairs(spark):
    points = spark.createDataFrame([(i,) for i in range(30)], "x int")
    spans = [(0, 3), (5, 5), (7, 20), (19, 30)]
    out = joins.in_interval(points, spark.createDataFrame(spans, "lo int, hi int"), "x", "lo", "hi", 4)
    assert values(out.select("x", "lo", "hi")) == sorted((x, lo, hi) for x in range(30) for lo, hi in spans if lo <= x < hi)


def test_unique_keys_neutralise_collisions(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1), ("b", 2), (None, 3)], "key string, id int")
    assert values(joins.unique_keys(df.where("key is not null"), "key", "id")) == [("a", 1)]


def test_merge_keeps_and_takes(spark):
    old = spark.createDataFrame([(1, "p", 10), (2, None, 20)], "k int, keep string, take int")
    new = spark.createDataFrame([(2, "n", 21), (3, "m", None)], "k int, keep string, take int")
    assert values(joins.merge_rows(old, new, "k", ["keep"], ["take"]).where("k < 3")) == [(1, "p", 10, "kept"), (2, "n", 21, "updated")]


def test_semi_any_does_not_multiply(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (3, "c"), (None, None)], "id int, s string")
    arms = [("id", spark.createDataFrame([(1,), (1,), (2,)], "x int")), ("s", spark.createDataFrame([("a",)], "y string"))]
    assert values(joins.semi_any(df, arms)) == [(1, "a"), (2, "b"), (2, "b")]


def test_ordinal_is_gapless(spark):
    df = spark.createDataFrame([(i * 7 % 101,) for i in range(101)], "id int")
    assert values(analytics.ordinal(df, "id", "o", 8)) == [(i, i + 1) for i in range(101)]


def test_readout_withholds_small_rates(spark):
    seen = spark.createDataFrame([(i, i % 2) for i in range(99)], "u int, v int")
    assert all(r["rate"] is None for r in analytics.readout(seen, seen.where("u < 10"), "u", "v").collect())


def test_wildcards_escape_what_like_reads():
    assert text.wildcard("50%_*a?\\") == "50\\%\\_%a_\\\\"


def test_lookup_keys_drop_nulls(spark):
    df = spark.createDataFrame([(["(2019) 4 SCC", None, "--"],)], "c array<string>")
    assert df.select(text.lookup_keys(F.col("c"))).first()[0] == ["20194SCC"]


def test_fusion_is_the_sum_of_reciprocals(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "q int, d int, rank int")
    b = spark.createDataFrame([(1, 11, 1)], "q int, d int, rank int")
    got = {r["d"]: r["score"] for r in retrieval.fuse([(a, 1.0), (b, 2.0)], "q", "d", 5).collect()}
    assert got == {11: round(1 / 62 + 2 / 61, 9), 10: round(1 / 61, 9)}


def test_mcnemar_against_binomial(spark):
    df = spark.createDataFrame([(0, 0), (5, 1), (10, 10), (3, 12), (700, 640), (2100, 2000)], "a long, b long")
    for r in df.select("a", "b", evaluation.mcnemar(F.col("a"), F.col("b")).alias("p")).collect():
        n = r["a"] + r["b"]
        want = min(1.0, float(Fraction(2 * sum(math.comb(n, i) for i in range(min(r["a"], r["b"]) + 1)), 2**n))) if n else 1.0
        assert abs(r["p"] - want) < 1e-9


def test_gate_never_passes_without_a_value(spark):
    df = spark.createDataFrame([(None,), (0.7,)], "x double")
    assert values(df.select(evaluation.grade(F.col("x"), 0.6, False))) == [(False,), (True,)]


def test_bootstrap_interval_holds_the_mean(spark):
    df = spark.createDataFrame([(i, float(i % 10)) for i in range(300)], "id int, v double")
    r = evaluation.bootstrap(df, "id", "v").first()
    assert r["low"] < r["mean"] < r["high"]


def test_chunks_tile_and_stay_in_bounds():
    rng = random.Random(1)
    for _ in range(200):
        t = "".join(rng.choice(["word ", "end. ", "\n\n", "x" * 50]) for _ in range(rng.randint(0, 200)))
        spans = documents.pack(t, 300, 40)
        assert all(0 <= a < b <= len(t) and b - a <= 300 + 40 for a, b in spans)
        if t.strip():
            assert spans[0][0] == 0 and spans[-1][1] == len(t)
            assert all(x[1] == y[0] for x, y in zip(spans, spans[1:], strict=False))


def test_quality_signals_on_nulls_and_empties(spark):
    df = spark.createDataFrame([("",), ("a b c",), ("x" * 100,)], "t string")
    assert [r[0] for r in df.select(quality.damage_verdict(F.col("t"))).collect()] == ["empty", "clean", "runs"]
    assert df.select(quality.ocr_quality(F.col("t"))).first()[0] == 1.0


def test_checksum_ignores_order_and_sees_nulls(spark):
    a = spark.createDataFrame([(1, None), (2, "x")], "i int, s string")
    b = spark.createDataFrame([(2, "x"), (1, None)], "i int, s string")
    c = spark.createDataFrame([(2, "x"), (1, "")], "i int, s string")
    one = lambda df: files.checksum(df, ["i", "s"]).first()["checksum"]
    assert one(a) == one(b) != one(c)


def test_json_lines_last_wins_and_bad_lines_go(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"id": 1, "at": 1, "v": "a"}\nnot json\n{"id": 1, "at": 2, "v": "b"}\n')
    assert values(files.json_lines(spark, str(tmp_path / "c.jsonl"), "id int, at int, v string", "id", "at")) == [(1, 2, "b")]


def test_partitioned_round_trip(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    files.write_by(docs, str(tmp_path / "d"), ["lang", "source"])
    back = files.partitioned(spark, str(tmp_path / "d"), lang="en")
    assert back.count() == docs.where("lang = 'en'").count()
    assert "PartitionFilters: [isnotnull(lang" in back._jdf.queryExecution().toString()


def test_failure_ledger_rules(spark):
    df = spark.createDataFrame([("a", "slow", 1), ("a", "slow", 2), ("b", "gone", 1), ("c", "slow", 1), ("c", "slow", 2), ("c", "late", 3)], "url string, why string, at int")
    assert values(files.failure_ledger(df, "url", "why", ("gone",))) == [("a", 2, "slow", False), ("b", 1, "gone", True), ("c", 3, "late", True)]


def test_filters_reach_the_scan(spark, sf):
    from florilege.plans.registry import QUERIES

    plan = QUERIES["join_semi"](spark, sf)._jdf.queryExecution().toString()
    assert "EqualTo(l_returnflag,R)" in plan and "GreaterThan(l_quantity," in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double,l_returnflag:string>" in plan


def test_late_rows_split(spark):
    from florilege.streaming.events import split_late

    df = spark.createDataFrame([(1, datetime.datetime(2024, 1, 1)), (2, datetime.datetime(2024, 2, 1))], "event_id int, ts timestamp")
    fresh, late = split_late(df, "2024-01-15")
    assert (fresh.count(), late.first()[0]) == (1, 1)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert documents.duplicate_groups(none, "doc_id", "text").count() == 0
    assert documents.chunks(none, "doc_id", "text").count() == 0
    assert retrieval.document_frequency(none, "text", "doc_id").count() == 0


def test_locate_verdicts(spark):
    from florilege.operators.spans import locate

    df = spark.createDataFrame([(1, "a  b c", "a  b"), (2, "a  b\nc", "a b c"), (3, "alpha beta gamma", "alpha beta delta"), (4, "x", "quite other"), (5, None, "y"), (6, "z", None)], "id long, t string, s string")
    got = {r["id"]: (r["verdict"], r["start"]) for r in locate(df.withColumn("s", F.array("s")), "id", "t", "s").collect()}
    assert got == {1: ("exact", 0), 2: ("collapsed", 0), 3: ("partial", 0), 4: ("absent", -1), 5: ("absent", -1), 6: ("absent", -1)}


def test_clusters_on_a_long_chain(spark):
    from florilege.operators.clusters import shared_target_clusters

    edges = [(i, f"t{i}") for i in range(40)] + [(i + 1, f"t{i}") for i in range(39)] + [(100, "u"), (101, "u"), (102, "v")]
    got = dict(values(shared_target_clusters(spark.createDataFrame(edges, "a int, b string"), "a", "b")))
    assert got == {**{i: 0 for i in range(40)}, 100: 100, 101: 100, 102: 102}


def test_shared_paragraphs_against_union_find(spark, sf):
    from florilege.plans.registry import QUERIES

    parent, holders = {}, {}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for doc, body in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        for p in (body or "").split("\n"):
            if len(p.strip(" ")) >= 120:
                parent.setdefault(doc, doc)
                holders.setdefault(p.strip(" "), []).append(doc)
    for docs in holders.values():
        for doc in docs[1:]:
            a, b = sorted((find(docs[0]), find(doc)))
            parent[b] = a
    assert values(QUERIES["ref_shared_target_clusters"](spark, sf)) == sorted((x, find(x)) for x in parent)


def test_rate_limit_counts_only_what_it_admits(spark):
    at = [0, 10, 20, 59, 61, 70, 75, 500, 501, 502]
    df = spark.createDataFrame([(i, 1, s) for i, s in enumerate(at)] + [(99, 2, 5)], "id long, u long, s int").withColumn("ts", F.timestamp_seconds("s"))
    got = {r["id"]: (r["refused"], r["after_us"] // 1_000_000) for r in rows.rate_limited(df, "u", "ts", "id", 2, 60).collect()}
    assert got == {0: (False, 0), 1: (False, 0), 2: (True, 40), 3: (True, 1), 4: (False, 0), 5: (False, 0), 6: (True, 46), 7: (False, 0), 8: (False, 0), 9: (True, 58), 99: (False, 0)}


def test_rate_limit_of_a_key_that_never_pauses(spark):
    df = spark.range(25_000).select("id", F.lit(None).cast("long").alias("u"), F.timestamp_seconds("id").alias("ts"))
    got = {r["id"] for r in rows.rate_limited(df, "u", "ts", "id", 2, 10).where("not refused").collect()}
    assert got == {i for i in range(25_000) if i % 10 < 2}


def test_dense_top_in_tiles(spark, monkeypatch):
    rng = random.Random(3)
    vectors = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(300)] + [(900, None)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    asked = df.where("vec_id % 25 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    x = {r[0]: r[1] for r in df.where("embedding is not null").collect()}
    for name, value in {"TILE_VECTORS": 40, "TILE_QUERIES": 5, "QUERY_ROWS": 2}.items():
        monkeypatch.setattr(retrieval, name, value)
    for digits in (6, 1):
        out = retrieval.dense_top(asked, df, 7, digits)
        assert "NestedLoop" not in out._jdf.queryExecution().toString()
        got = {}
        for r in out.orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append(r["vec_id"])
        for q in (k for k in x if k % 25 == 0):
            score = {v: sum(a * b for a, b in zip(x[q], x[v], strict=True)) for v in x if v != q}
            assert got[q] == sorted(score, key=lambda v: (-round(score[v], digits), v))[:7]


def test_items_are_located_exactly(spark):
    texts = ["a b c d e f g h", "xa b c d e f gy a b c d e f g", "b c\td e f", "", None, "a b c d e f g h", "zz b z"]
    docs = spark.createDataFrame([(i % 6, t) for i, t in enumerate(texts)] + [(None, "a b c d e f g")], "doc_id long, text string")
    asked = ["a b c d e f g", "b", "", None, "b c d e f", " b c d e f ", "b", "nowhere to be found in any text"]
    items = spark.createDataFrame([(min(i, 6), t) for i, t in enumerate(asked)], "item_id long, text string")
    got = documents.locate(docs, "doc_id", "text", items, "item_id", "text", block=2).collect()
    rows = [(i % 6, t) for i, t in enumerate(texts)] + [(None, "a b c d e f g")]
    want = [(min(i, 6), k, t.find(w)) for i, w in enumerate(asked) if w is not None for k, t in rows if t is not None and w in t]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_maximum_before_over_ranges(spark):
    values = [(i, (i * 7919) % 101 if i % 5 else None) for i in range(0, 300, 3)]
    df = spark.createDataFrame(values, "k long, v long")
    got = {r.k: r.m for r in rows.maximum_before(df, "k", "v", "m", size=7).collect()}
    assert got == {k: max((v for q, v in values if q < k and v is not None), default=None) for k, _ in values}


def test_signals_of_single_texts(spark):
    texts = [None, "", "ab #$%", "he nd ersion icense oftware his", "the and version license software this", "he nd"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    whole, cut = signals.cut_counts(F.col("t"))
    got = df.select("i", signals.font_verdict(F.col("t"), r"[#%$&*]{3}"), whole, cut, signals.fnv1a(F.col("t"))).orderBy("i").collect()

    def fnv(text):
        h = 2166136261
        for c in (text or "").encode():
            h = ((h ^ c) * 16777619) % 2**32
        return None if text is None else h

    assert [tuple(r)[1:] for r in got] == [
        (v, w, c, fnv(t)) for t, v, w, c in zip(texts, ["unknown", "clean", "suspect", "clean", "clean", "clean"], [0, 0, 0, 0, 6, 0], [0, 0, 0, 6, 0, 2], strict=True)
    ]


def test_half_precision_and_swapped_digits(spark):
    rng = random.Random(5)
    numbers = [0.0, 1.0, -1.0, 2.0**-14, 2.0**-25, 3 * 2.0**-25, 65504.0, *[rng.uniform(-1, 1) * 2.0 ** rng.randint(-20, 10) for _ in range(500)]]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(numbers)], "i int, x double")
    assert [r.h for r in df.orderBy("i").select(signals.half(F.col("x")).alias("h")).collect()] == [float(np.float16(x)) for x in numbers]
    ids = spark.createDataFrame([(None,), (7,), (22,), (21,), (1203,)], "n long")
    assert [r.s for r in ids.select(signals.swapped_digits(F.col("n")).alias("s")).collect()] == [None, None, None, "12", "1230"]


def test_nearest_within_a_group(spark):
    rng = random.Random(9)
    vectors = [(i, [rng.uniform(-1, 1) for _ in range(4)], None if i % 7 == 0 else i % 3) for i in range(60)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>, label long")
    asked = df.where("vec_id < 10").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), "label")
    got = values(retrieval.dense_top(asked, df, 3, within="label").select("query_id", "rank", "vec_id"))
    want = []
    for i, q, label in vectors[:10]:
        near = sorted((-round(sum(a * b for a, b in zip(q, v, strict=True)), 6), j) for j, v, other in vectors if j != i and other == label)
        want += [(i, place, j) for place, (_, j) in enumerate(near[:3], 1)]
    assert got == sorted(want)
