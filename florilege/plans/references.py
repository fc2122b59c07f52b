"""References, evidence spans, names, amendments and clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from florilege.functions import references as refs
from florilege.operators.clusters import shared_target_clusters
from florilege.plans.catalog import Tables, query

NORMAL = "trim(regexp_replace(upper(r), '[^A-Z0-9@]+', ' ', 'g'))"
ARMS = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, unnest(regexp_extract_all(text, '{p}')) AS r FROM documents" for k, p in refs.PATTERNS)


@query("ref_extract", f"SELECT doc_id, kind, {NORMAL} AS reference, count(*) AS n FROM ({ARMS}) GROUP BY 1, 2, 3")
def extract(t: Tables) -> DataFrame:
    return refs.references(t.documents, "doc_id", "text")


SPOTS = " UNION ALL ".join(
    f"SELECT doc_id, '{k}' AS kind, r, length(list_aggregate(list_concat([''], list_slice(g, 1, i)), 'string_agg', '')) + coalesce(length(list_aggregate(list_concat([''], list_slice(ms, 1, i - 1)), 'string_agg', '')), 0) AS start "
    f"FROM (SELECT doc_id, generate_subscripts(ms, 1) AS i, unnest(ms) AS r, ms, g FROM (SELECT doc_id, regexp_extract_all(text, '{p}') AS ms, string_split_regex(text, '{p}') AS g FROM documents))"
    for k, p in refs.PATTERNS
)


@query("ref_first_offsets", f"SELECT doc_id, kind, {NORMAL} AS reference, min(start)::INT AS start FROM ({SPOTS}) GROUP BY 1, 2, 3")
def first_offsets(t: Tables) -> DataFrame:
    return refs.first_offsets(t.documents, "doc_id", "text")


@query("ref_parallel", f"""
WITH s AS (SELECT doc_id, {NORMAL} AS reference, min(start) AS start FROM ({SPOTS}) GROUP BY doc_id, kind, 2)
SELECT x.reference AS a, y.reference AS b, count(*) AS n FROM s x JOIN s y ON x.doc_id = y.doc_id AND x.reference < y.reference AND abs(x.start - y.start) <= 55 GROUP BY 1, 2""")
def parallel(t: Tables) -> DataFrame:
    return refs.co_named(t.documents, "doc_id", "text")


@query("ref_document_frequency", f"SELECT kind, {NORMAL} AS reference, count(DISTINCT doc_id) AS docs FROM ({ARMS}) GROUP BY 1, 2 HAVING count(DISTINCT doc_id) >= 2")
def frequency(t: Tables) -> DataFrame:
    return refs.references(t.documents, "doc_id", "text").groupBy("kind", "reference").agg(F.count_distinct("doc_id").alias("docs")).where("docs >= 2")


@query("ref_strip_from_text", r"""
SELECT doc_id, length(regexp_replace(regexp_replace(text, '[0-9]{1,3}(?:\.[0-9]{1,3}){3}', '', 'g'), '[A-Za-z0-9._+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+', '', 'g')) AS n FROM documents""")
def strip(t: Tables) -> DataFrame:
    x = F.regexp_replace(F.regexp_replace("text", refs.PATTERNS[2][1], ""), refs.PATTERNS[3][1], "")
    return t.documents.select("doc_id", F.length(x).cast("long").alias("n"))


@query("ref_name_split", r"""
SELECT c_custkey, string_split(c_name, '#')[1] AS party, string_split(c_name, '#')[2] AS serial FROM customer""")
def name_split(t: Tables) -> DataFrame:
    parts = F.split("c_name", "#")
    return t.customer.select("c_custkey", F.get(parts, 0).alias("party"), F.get(parts, 1).alias("serial"))


@query("ref_ascending_runs", """
WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, max(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey FROM s WHERE high IS NULL OR l_partkey > high""")
def ascending_runs(t: Tables) -> DataFrame:
    """Numbers kept only while they rise: headings of a table of contents fall away."""
    before = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey").rowsBetween(Window.unboundedPreceding, -1)
    s = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.max("l_partkey").over(before).alias("high"))
    return s.where("high IS NULL OR l_partkey > high").drop("high")


@query("ref_adjudication", """
WITH j AS (SELECT o_orderkey, o_totalprice / 600000 AS confidence, lag(o_totalprice / 600000) OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS next FROM orders)
SELECT o_orderkey, CASE WHEN confidence NOT BETWEEN 0 AND 1 THEN 'rejected' WHEN confidence >= 0.5 AND confidence - coalesce(next, 0) >= 0.15 THEN 'high' WHEN confidence >= 0.3 THEN 'medium' ELSE 'low' END AS tier FROM j""")
def adjudication(t: Tables) -> DataFrame:
    """Answers as JSON, parsed whole or rejected; a tier needs a gap to the next best answer."""
    said = t.orders.select("o_custkey", F.to_json(F.struct("o_orderkey", (F.col("o_totalprice") / 600000).alias("confidence"))).alias("answer"))
    parsed = said.select("o_custkey", F.from_json("answer", "o_orderkey long, confidence double", {"mode": "PERMISSIVE"}).alias("a")).select("o_custkey", "a.*")
    following = F.lag("confidence").over(Window.partitionBy("o_custkey").orderBy("confidence", "o_orderkey"))
    c, gap = F.col("confidence"), F.col("confidence") - F.coalesce("next", F.lit(0.0))
    tier = F.when(~c.between(0, 1), "rejected").when((c >= 0.5) & (gap >= 0.15), "high").when(c >= 0.3, "medium").otherwise("low")
    return parsed.withColumn("next", following).select("o_orderkey", tier.alias("tier"))


@query("ref_amendment_state", """
SELECT l_partkey, l_shipdate AS effective, l_returnflag AS event, count(*) OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber) AS ordinal FROM lineitem WHERE l_returnflag <> 'N'""")
def amendment_state(t: Tables) -> DataFrame:
    w = Window.partitionBy("l_partkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber")
    return t.lineitem.where("l_returnflag <> 'N'").select("l_partkey", F.col("l_shipdate").alias("effective"), F.col("l_returnflag").alias("event"), F.count(F.lit(1)).over(w).alias("ordinal"))


@query("ref_shared_target_clusters")
def clusters(t: Tables) -> DataFrame:
    """Documents connected by paragraphs of 120 characters or more. No oracle: recursive SQL pairs the
    holders of a paragraph; a test holds the result against union-find."""
    each = t.documents.select("doc_id", F.explode(F.split("text", "\n")).alias("p")).select("doc_id", F.trim("p").alias("p"))
    return shared_target_clusters(each.where("length(p) >= 120").select("doc_id", F.sha2("p", 256).alias("r")), "doc_id", "r")


@query("ref_page_sections", r"""
SELECT page_id, generate_subscripts(a, 1) AS ordinal, length(unnest(a)) AS n FROM (SELECT page_id, regexp_extract_all(html, '<p>([^<]*)', 1) AS a FROM pages)""")
def page_sections(t: Tables) -> DataFrame:
    each = t.pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit("<p>([^<]*)"), F.lit(1))).alias("p", "x"))
    return each.select("page_id", (F.col("p") + 1).cast("long").alias("ordinal"), F.length("x").cast("long").alias("n"))
