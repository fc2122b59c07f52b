"""Operators on reports and on references, on cases written by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from florilege.functions import passages
from florilege.operators import resolution


def texts(spark, *values):
    return spark.createDataFrame(list(enumerate(values)), "id int, text string")


def test_treatment_stops_at_the_next_case_and_heeds_negations(spark):
    cite = "(1994) 3 SCC 1"
    cases = [
        (f"{cite}, overruled.", "overruled", "overruled"),
        (f"{cite} was held not overruled by this bench", "overruled", "cites"),
        (f"{cite} is partly overruled", "overruled", "overruled_in_part"),
        (f"{cite} and Roe v. Doe, followed", "", "cites"),
        (f"{cite} is no longer good law", "", "overruled"),
        (f"{cite} {'x' * 100} relied on", "relied on", "cites"),
        (f"{cite}\n\nfollowed", "", "cites"),
        (f"{cite}", "", "cites"),
    ]
    df = texts(spark, *[c[0] for c in cases], None, "", "no citation here")
    got = {r.id: (r.annotation, r.treatment) for r in passages.treatments(df, "id", "text").collect()}
    assert got == {i: c[1:] for i, c in enumerate(cases)}


def test_every_citation_has_its_own_reach_and_rows_repeat(spark):
    both = "(1990) 1 AIR 7, followed; A v. B (1991) 2 AIR 8, distinguished"
    rows = passages.treatments(texts(spark, both, both), "id", "text").orderBy("id", "ordinal").collect()
    assert [(r.id, r.ordinal, r.treatment) for r in rows] == [(i, o, t) for i in (0, 1) for o, t in ((1, "followed"), (2, "distinguished"))]


def test_sections_need_an_act_that_follows_at_once(spark):
    cases = [
        ("section 302 of the Indian Penal Code, 1860", ("INDIAN PENAL CODE", "302")),
        ("Section 3(1)(b) of the Punjab Municipal Act", ("PUNJAB MUNICIPAL ACT", "3")),
        ("s.138 of the NI Act", ("NEGOTIABLE INSTRUMENTS ACT", "138")),
        ("s. 357(3) CrPC", ("CODE OF CRIMINAL PROCEDURE", "357")),
        ("section 5, and later the Court held that the Sales Act applied", None),
        ("section 9", None),
    ]
    df = texts(spark, *[c[0] for c in cases], None, "")
    got = {r.id: (r.act, r.section) for r in passages.section_references(df, "id", "text").collect()}
    assert got == {i: c[1] for i, c in enumerate(cases) if c[1]}


def test_paragraph_numbers_refuse_what_is_unclear(spark):
    cases = [
        ("in paragraphs 12 to 15 of it", [12, 13, 14, 15]),
        ("paras 45-47", [45, 46, 47]),
        ("paragraphs 12, 19 and 14", [12, 14, 19]),
        ("para. 7 and paragraph 7", [7]),
        ("paragraphs 1 to 400", None),
        ("paragraphs 15 to 12", None),
        ("[Para 129] Roe v. Doe", None),
        ("Case law cited: paragraph 4", None),
        ("paragraph 1973", None),
        ("nothing", None),
        ("", None),
        (None, None),
    ]
    df = texts(spark, *[c[0] for c in cases]).select("id", passages.paragraph_numbers(F.col("text")).alias("n"))
    assert {r.id: r.n for r in df.collect()} == {i: c[1] for i, c in enumerate(cases)}


def test_paragraphs_go_on_counting(spark):
    long = "x" * 50
    text = f"Title {long}\n1. {long}\n1998. {long} a year\n2. short\n(3) {long}\n9. {long} a leap"
    rows = passages.paragraphs(texts(spark, text, None, " \n ", f"40. {long}"), "id", "text").orderBy("id", "ordinal").collect()
    assert [(r.id, r.number) for r in rows] == [(0, None), (0, 1), (0, 3), (3, None)]
    whole = [text[r.start : r.start + r.size] for r in rows if r.id == 0]
    assert "".join(whole) == text and "2. short" in whole[1] and "9. " in whole[2]


def test_very_long_texts(spark):
    text = "\n".join(f"{i}. (1994) 3 SCC {i}, followed at paragraph {i}" for i in range(1, 20001))
    df = texts(spark, text)
    assert passages.paragraphs(df, "id", "text", least=0).count() == 9999  # a number has four digits at most
    assert passages.treatments(df, "id", "text").where("treatment = 'followed'").count() == 20000


def test_marks_are_plain(spark):
    df = texts(spark, "“a” ‘b’ 1–2—3 ﬁ", None, "").select("id", passages.canonical_marks(F.col("text")).alias("x"))
    assert {r.id: r.x for r in df.collect()} == {0: "\"a\" 'b' 1-2-3 fi", 1: None, 2: ""}


def test_identity_takes_the_strongest_key_once(spark):
    rows = spark.createDataFrame([(1, "A", ["B", None, ""]), (2, None, ["A"]), (3, "", None), (4, "B", ["B"]), (4, "B", ["B"])], "id int, neutral string, reporters array<string>")
    asked = spark.createDataFrame([("A",), ("A",), ("B",), (None,), ("",)], "q string")
    tiers = [("neutral", F.array("neutral")), ("reporter", F.col("reporters"))]
    got = {tuple(r) for r in resolution.match_identity(asked, "q", rows, "id", tiers).collect()}
    assert got == {("A", 1, "neutral"), ("A", 2, "reporter"), ("B", 1, "reporter"), ("B", 4, "neutral")}


def test_collisions_rates_and_gates(spark):
    claims = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "a"), (None, "a")], "target int, key string")
    got = sorted((str(r.target), r.collided) for r in resolution.split_collisions(claims, "target", "key").collect())
    assert got == [("1", True), ("1", True), ("2", False), ("2", False), ("None", False)]
    none = resolution.resolver_rates(spark.createDataFrame([], "s string"), "s").first()
    assert (none.n, none.formed, none.hit_rate) == (0, 0, 0.0)
    links = spark.createDataFrame([(1, 1, 2, True), (1, 1, 0, None), (1, 2, 0, True)], "s int, d int, tier int, open boolean")
    assert [tuple(r) for r in resolution.linked(links, "s", "d", "tier", F.col("open")).collect()] == [(1, 0, 1, 1)]


def test_samples_agree_between_runs(spark):
    df = spark.range(10000).withColumnRenamed("id", "k")
    kept = {r.k for r in resolution.sample_rows(df, "k", 0.1, 3).collect()}
    assert kept == {r.k for r in resolution.sample_rows(df.repartition(7), "k", 0.1, 3).collect()} and 850 < len(kept) < 1150
    blocks = {r.k for r in resolution.sample_blocks(df, "k", 100, 0.5, 3).collect()}
    assert blocks == {b * 100 + i for b in {k // 100 for k in blocks} for i in range(100)} and 0 < len(blocks) < 10000
