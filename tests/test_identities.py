"""Identity classes against all pairs, dispositions of headnotes."""

from __future__ import annotations

import datetime
import itertools
import random
from collections import Counter

from pyspark.sql import functions as F

from florilege.operators import headnotes as hn
from florilege.operators import identity


def relation(a, b):
    """All strengths of one pair."""
    same = lambda k: a[k] is not None and a[k] == b[k]
    gap = abs((a["day"] - b["day"]).days) if a["day"] and b["day"] else None
    out = []
    if same("cnr") and gap == 0:
        out.append(("CNR_EXACT", f"{a['cnr']}|{a['day']}"))
    if same("citation"):
        out.append(("CITATION_EXACT", str(a["citation"])))
    if same("court") and gap == 0 and same("case_no"):
        out.append(("REGISTRY_STRONG", f"{a['court']}|{a['day']}|{a['case_no']}"))
    if same("court") and gap == 0 and same("caption") and a["case_no"] and b["case_no"] and a["case_no"] != b["case_no"]:
        out.append(("CAPTION_WEAK", f"{a['court']}|{a['day']}|{a['caption']}"))
    if same("cnr") and gap:
        out.append(("SAME_CASE_ADJACENT_DATE" if gap == 1 else "SAME_CASE_DIFFERENT_DATE", str(a["cnr"])))
    return out


def test_classes_against_all_pairs(spark):
    rng = random.Random(7)
    pick = lambda *x: rng.choice([None, *x])
    rows = [{"id": i, "cnr": pick(1, 2, 3), "citation": pick(*range(30)), "court": pick("A", "B"), "day": pick(*[datetime.date(2020, 1, d) for d in (1, 2, 3, 9)]), "case_no": pick("x", "y"), "caption": pick("p", "q")} for i in range(150)]
    df = spark.createDataFrame(rows, "id long, cnr long, citation long, court string, day date, case_no string, caption string")
    found = identity.classes(df)
    links, best = Counter(), {}
    for a, b in itertools.combinations(rows, 2):
        for r in relation(a, b):
            links[r] += 1
    assert {(r["strength"], r["class"]): r["links"] for r in found.collect()} == links and len({k for k, _ in links}) == 6
    for r in rows:
        own = [("CNR_EXACT", "cnr day"), ("CITATION_EXACT", "citation"), ("REGISTRY_STRONG", "court day case_no"), ("CAPTION_WEAK", "court day caption"), ("SAME_CASE_ADJACENT_DATE", "cnr"), ("SAME_CASE_DIFFERENT_DATE", "cnr")]
        for strength, keys in own:
            values = [r[k] for k in keys.split()]
            if None not in values and (strength, "|".join(map(str, values))) in links:
                best[r["id"]] = strength
                break
    assert {r["id"]: r["strength"] for r in identity.strongest(df, "id", found).collect()} == best


def test_a_hot_key_is_one_class(spark):
    df = spark.range(20_000).select("id", F.lit(1).alias("cnr"), F.lit(None).cast("long").alias("citation"), F.lit("A").alias("court"), F.lit(datetime.date(2020, 1, 1)).alias("day"), F.lit("x").alias("case_no"), F.lit("p").alias("caption"))
    assert {r["strength"]: r["links"] for r in identity.classes(df).collect()} == {"CNR_EXACT": 199_990_000, "REGISTRY_STRONG": 199_990_000}


def test_formatting_is_no_difference(spark):
    assert [r[0] for r in spark.createDataFrame([("W.P. 12/2020",), ("wp 12-2020",), ("--",), (None,)], "x string").select(identity.plain(F.col("x"))).collect()] == ["WP122020", "WP122020", None, None]


NOTE = (
    "Miners of the North v. State of X (1992) Supp 2 SCC 239; State of M P v. Fabric Mills Ltd. [1995] 1 SCR 756 : (1995) Supp 1 SCC 642; "
    "Cement & Chemical Co. Ltd. v. Union [2000] Supp. 4 SCR 44 : (2001) 1 SCC 91 – overruled. "
    "B Dass v. Lt Governor [1979] 1 SCR 271 : (1978) 4 SCC 11; Steel v. State [2016] 10 SCR 1 : (2017) 1574 [2024] 7 S.C.R.Digital Supreme Court Reports 12 SCC 1 – affirmed."
)
PROSE = (
    "Union v. T Patel (1985) 3 SCC 398 : [1985] 2 Suppl. SCR 131; K Hollohan v. Zach (1992) Supp 2 SCC 651 : [1992] 1 SCR 686 – relied on "
    "1.1.3 A trust has been vested in the office of the Speaker of the House. Review is necessary so that the features of the union are not lost. [Para 94][830-D-F] "
    "R Ath v Union (2010) 4 SCC 1 : [2010] 3 SCR 1059; Pandit Sharma v Dr S Sinha AIR 1960 SC 1186 – relied on. Mohd S v State (2014) 11 SCC 415; Y Kumar v State (2016) 3 SCC 183 – overruled."
)


def by(text):
    out = {}
    for _, name, _, _, said, _ in hn.read(text):
        out.setdefault(said, []).append(name)
    return out


def test_every_case_of_a_list_gets_its_disposition():
    assert by(NOTE) == {"overruled": ["Miners of the North v. State of X", "State of M P v. Fabric Mills Ltd.", "Cement & Chemical Co. Ltd. v. Union"], "affirmed": ["B Dass v. Lt Governor", "Steel v. State"]}


def test_lists_end_at_prose_and_at_marks_without_a_stop():
    assert by(PROSE) == {"relied on": ["Union v. T Patel", "K Hollohan v. Zach", "R Ath v Union", "Pandit Sharma v Dr S Sinha"], "overruled": ["Mohd S v State", "Y Kumar v State"]}
    assert by("E P v State (1974) 4 SCC 3; Anuj v Hotels (2008) 3 SCC 1 – referred to The law treats all as one. Free v Union (2017) 10 SCC 800 – relied on.") == {"referred to": ["E P v State", "Anuj v Hotels"], "relied on": ["Free v Union"]}


def test_only_what_moves_the_law_is_adverse():
    flags = {said: adverse for _, _, _, _, said, adverse in hn.read("A v B (1999) 1 SCC 1 – partially overruled. A v B (1999) 1 SCC 1 – overruled. A v B (1999) 1 SCC 1 – distinguished. A v B (1999) 1 SCC 1 – per incurium.")}
    assert flags == {"partially overruled": True, "overruled": True, "distinguished": False, "per incurium": True}


def test_parallel_citations_need_the_colon():
    rows = {name: (scr, scc) for _, name, scr, scc, _, _ in hn.read(NOTE + " X v Y [2001] 1 SCR 5 and (2001) 2 SCC 6 – followed. Z v Y (2001) 2 SCC 6 : [2001] 1 SCR 5 – followed.")}
    assert rows["Steel v. State"] == ("[2016] 10 SCR 1", "(2017) 12 SCC 1") and rows["X v Y"] == (None, None) and rows["Z v Y"] == ("[2001] 1 SCR 5", "(2001) 2 SCC 6")
    assert rows["Miners of the North v. State of X"] == (None, None)


def test_what_is_no_list():
    assert list(hn.read("The years 1999 – 2004 were dry – the end")) == [] and list(hn.read("(2001) 2 SCC 6 – overruled.")) == [] and list(hn.read("A v B, as held – the law; see page – under section 4")) == [] and list(hn.read("")) == []


def test_columns_of_dispositions(spark):
    got = hn.dispositions(spark.createDataFrame([(1, NOTE), (2, None), (3, "none")], "id long, t string"), "id", "t").collect()
    assert len(got) == 5 and {r["id"] for r in got} == {1} and NOTE[got[1]["start"] :].strip().startswith("State of M P")
