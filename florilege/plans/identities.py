"""Classes of rows that may be one decision, and dispositions of cited cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from florilege.operators import headnotes, identity
from florilege.plans.catalog import Tables, query

#: Orders as decisions: the customer is the case, the price in hundreds the citation, the status the court.
DECISIONS = "(SELECT o_orderkey, o_custkey AS cnr, floor(o_totalprice / 100)::BIGINT AS citation, o_orderstatus AS court, o_orderdate::DATE AS day, substr(o_orderpriority, 1, 1) AS case_no, (o_orderkey // 8) % 3 AS caption FROM orders)"


def decisions(t: Tables) -> DataFrame:
    return t.orders.select(
        "o_orderkey", F.col("o_custkey").alias("cnr"), F.floor(F.col("o_totalprice") / 100).alias("citation"), F.col("o_orderstatus").alias("court"), F.col("o_orderdate").cast("date").alias("day"),
        F.substring("o_orderpriority", 1, 1).alias("case_no"), (F.floor(F.col("o_orderkey") / 8) % 3).alias("caption"),
    )


CLASSES = f"""
d AS {DECISIONS},
p AS (SELECT a.o_orderkey AS a, b.o_orderkey AS b, a.cnr = b.cnr AND a.day = b.day AS e1, a.citation = b.citation AS e2, a.court = b.court AND a.day = b.day AND a.case_no = b.case_no AS e3,
  a.court = b.court AND a.day = b.day AND a.caption = b.caption AND a.case_no <> b.case_no AS e4, a.cnr = b.cnr AND abs(a.day - b.day) = 1 AS e5, a.cnr = b.cnr AND abs(a.day - b.day) > 1 AS e6, a.cnr, a.citation, a.court, a.day, a.case_no, a.caption
  FROM d a JOIN d b ON a.o_orderkey < b.o_orderkey AND (a.cnr = b.cnr OR a.citation = b.citation OR (a.court = b.court AND a.day = b.day))),
l AS (SELECT a, b, 0 AS r, 'CNR_EXACT' AS strength, cnr || '|' || day AS class FROM p WHERE e1 UNION ALL SELECT a, b, 1, 'CITATION_EXACT', citation::VARCHAR FROM p WHERE e2
  UNION ALL SELECT a, b, 2, 'REGISTRY_STRONG', court || '|' || day || '|' || case_no FROM p WHERE e3 UNION ALL SELECT a, b, 3, 'CAPTION_WEAK', court || '|' || day || '|' || caption FROM p WHERE e4
  UNION ALL SELECT a, b, 4, 'SAME_CASE_ADJACENT_DATE', cnr::VARCHAR FROM p WHERE e5 UNION ALL SELECT a, b, 5, 'SAME_CASE_DIFFERENT_DATE', cnr::VARCHAR FROM p WHERE e6)"""


@query("doc_identity_classes", f"WITH {CLASSES} SELECT strength, class, count(*) AS links FROM l GROUP BY 1, 2")
def identity_classes(t: Tables) -> DataFrame:
    """Classes with the number of pairs each stands for; the SQL makes the pairs."""
    return identity.classes(decisions(t)).select("strength", "class", "links")


@query("doc_identity_strength", f"""
WITH {CLASSES}, held AS (SELECT DISTINCT strength, class, r FROM l),
k AS (SELECT o_orderkey, unnest([cnr || '|' || day, citation::VARCHAR, court || '|' || day || '|' || case_no, court || '|' || day || '|' || caption, cnr::VARCHAR, cnr::VARCHAR]) AS class, unnest(range(0, 6)) AS r FROM d)
SELECT o_orderkey, arg_min(strength, r) AS strength, arg_min(class, r) AS class FROM k JOIN held USING (class, r) GROUP BY 1""")
def identity_strength(t: Tables) -> DataFrame:
    rows = decisions(t)
    return identity.strongest(rows, "o_orderkey", identity.classes(rows))


ENDED = "CASE l_returnflag WHEN 'A' THEN 'overruled' WHEN 'R' THEN 'relied on' ELSE 'held inapplicable' END"


@query("ref_headnote_dispositions", f"""
WITH n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n, count(*) OVER (PARTITION BY l_orderkey) AS last FROM lineitem),
e AS (SELECT l_orderkey, n, l_partkey, l_suppkey, l_linenumber, n = last OR l_linestatus = 'F' AND n % 3 = 0 AS ends, {ENDED} AS said FROM n),
g AS (SELECT *, first_value(CASE WHEN ends THEN said END IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS disposition FROM e)
SELECT l_orderkey, n - 1 AS entry_no, 'Party ' || l_partkey || ' v. Bench ' || l_suppkey AS name, CASE WHEN l_partkey % 3 <> 0 THEN '(' || (1950 + l_partkey % 70) || ') ' || (n + 1) || ' SCC ' || l_suppkey END AS scc, disposition, disposition = 'overruled' AS adverse FROM g""")
def headnote_dispositions(t: Tables) -> DataFrame:
    """Headnotes made of the lines of each order: prose, then lists, each closed by a disposition; every third case
    has no parallel citation. The SQL has the entries from the columns."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    line = t.lineitem.withColumns({"n": F.row_number().over(order), "last": F.count(F.lit(1)).over(Window.partitionBy("l_orderkey"))})
    s = lambda c: c.cast("string")
    year = s(F.lit(1950) + F.col("l_partkey") % 70)
    scr = F.concat(F.lit(" ["), year, F.lit("] "), s(F.col("n")), F.lit(" SCR "), s(F.col("l_partkey")))
    scc = F.concat(F.when(F.col("l_partkey") % 3 != 0, " : (").otherwise(" ("), year, F.lit(")\n"), s(F.col("n") + 1), F.lit(" SCC "), s(F.col("l_suppkey")))
    ends = (F.col("n") == F.col("last")) | ((F.col("l_linestatus") == "F") & (F.col("n") % 3 == 0))
    said = F.when(F.col("l_returnflag") == "A", "overruled").when(F.col("l_returnflag") == "R", "relied\non").otherwise("held inapplicable")
    entry = F.concat(F.lit("Party "), s(F.col("l_partkey")), F.lit(" v. Bench "), s(F.col("l_suppkey")), scr, scc, F.when(ends, F.concat(F.lit(" – "), said, F.when(F.col("n") % 2 == 0, ". ").otherwise(" "))).otherwise("; "))
    # an order has a few lines
    told = line.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", entry.alias("e")))), lambda x: x["e"]), "").alias("list"))
    notes = told.select("l_orderkey", F.concat(F.lit("The court has held (2001) 3 SCC 4 to stand; the words are plain. "), "list", F.lit("Nothing more; said A v. B (1999) 1 SCC 1 there.")).alias("text"))
    return headnotes.dispositions(notes, "l_orderkey", "text").select("l_orderkey", F.col("entry_no").cast("long").alias("entry_no"), "name", "scc", "disposition", "adverse")
