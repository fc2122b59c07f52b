"""References with the nearest marker, and sections by rising headings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from florilege.functions import references as refs
from florilege.operators import markers
from florilege.plans.catalog import Tables, query
from florilege.plans.references import NORMAL, SPOTS


def _sql(span: str, marker: str, reach: int, guard: str | None) -> str:
    """Spans of one kind with the nearest of another, by windows over merged places."""
    cut = "" if guard is None else f" UNION ALL SELECT doc_id, start, start + length(r) AS stop, 'guard' AS role, NULL AS label FROM s WHERE kind = '{guard}'"
    return f"""
WITH s AS ({SPOTS}),
p AS (SELECT DISTINCT doc_id, start, start + length(r) AS stop, 'span' AS role, NULL::VARCHAR AS label FROM s WHERE kind = '{span}' UNION ALL SELECT doc_id, start, start + length(r), 'marker', {NORMAL} FROM s WHERE kind = '{marker}'{cut}),
w AS (SELECT *, last_value(CASE WHEN role = 'marker' THEN {{'a': start, 'b': stop, 'l': label}} END IGNORE NULLS) OVER b AS m0, last_value(CASE WHEN role = 'guard' THEN start END IGNORE NULLS) OVER b AS g0,
  first_value(CASE WHEN role = 'marker' THEN {{'a': start, 'b': stop, 'l': label}} END IGNORE NULLS) OVER f AS m1, first_value(CASE WHEN role = 'guard' THEN start END IGNORE NULLS) OVER f AS g1
  FROM p WINDOW b AS (PARTITION BY doc_id ORDER BY start, stop, role ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), f AS (PARTITION BY doc_id ORDER BY start, stop, role ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
n AS (SELECT *, CASE WHEN greatest(start - m0.b, 0) <= {reach} AND NOT coalesce(g0 > m0.a, false) AND m0 IS NOT NULL THEN greatest(start - m0.b, 0) END AS n0,
  CASE WHEN greatest(m1.a - stop, 0) <= {reach} AND NOT coalesce(g1 < m1.a, false) AND m1 IS NOT NULL THEN greatest(m1.a - stop, 0) END AS n1 FROM w WHERE role = 'span')
SELECT doc_id, start::INT AS start, CASE WHEN n0 IS NOT NULL AND (n1 IS NULL OR n0 <= n1) THEN m0.l ELSE m1.l END AS label, CASE WHEN n0 IS NOT NULL AND (n1 IS NULL OR n0 <= n1) THEN n0 ELSE n1 END::INT AS gap,
  CASE WHEN n0 IS NOT NULL AND (n1 IS NULL OR n0 <= n1) THEN 'before' ELSE 'behind' END AS side FROM n WHERE n0 IS NOT NULL OR n1 IS NOT NULL"""


def _near(t: Tables, span: str, marker: str, reach: int, guard: str | None) -> DataFrame:
    found = refs.spots(t.documents, "doc_id", "text")
    of = lambda kind: found.where(F.col("kind") == kind).withColumn("label", refs.normal(F.col("found")))
    near = markers.nearest(of(span), of(marker), None if guard is None else of(guard), "doc_id", reach)
    return near.select("doc_id", "start", "label", "gap", "side")


@query("ref_version_licence", _sql("version", "licence", 70, None))
def version_licence(t: Tables) -> DataFrame:
    """Versions with the nearest licence within 70 characters."""
    return _near(t, "version", "licence", 70, None)


@query("ref_mail_address", _sql("mail", "address", 220, "licence"))
def mail_address(t: Tables) -> DataFrame:
    """Mail addresses with the nearest machine address within 220 characters, unless a licence stands between."""
    return _near(t, "mail", "address", 220, "licence")


@query("ref_address_mail", _sql("address", "mail", 600, "version"))
def address_mail(t: Tables) -> DataFrame:
    """Machine addresses with the nearest mail address within 600 characters, unless a version stands between."""
    return _near(t, "address", "mail", 600, "version")


@query("ref_section_headings")
def section_headings(t: Tables) -> DataFrame:
    """Each supplier's order lines as a text of numbered headings, of which a longest rise stays. No oracle:
    which rise stays is a rule of the search; tests hold its length against all subsequences."""
    suffix = F.when(F.col("l_linenumber") % 3 == 0, "A").otherwise("")
    number = (F.floor(F.col("l_orderkey") / 64) % 997 + 1).cast("string")
    heading = F.concat(number, suffix, F.lit(". of part "), F.col("l_partkey").cast("string"))
    # a supplier has some hundred lines, at any scale
    texts = t.lineitem.groupBy("l_suppkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", heading.alias("h")))), lambda s: s["h"]), "\ntext\n").alias("text"))
    return markers.ascending(texts, "l_suppkey", "text")
