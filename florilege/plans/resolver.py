"""States of references, edges resolved anew, effects from status and edges, over order lines and parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from florilege.functions.text import lookup_key
from florilege.operators import resolver
from florilege.plans.catalog import Tables, query

#: Parts are targets, known by brand, size and the price in tens; their brand is the cohort, of which brands of even
#: numbers have parts that the index has not read, and brands of numbers that five divides declare one more.
STATES = """
p AS (SELECT p_partkey, p_brand, regexp_extract(p_brand, '([0-9]+)', 1)::INT AS b, upper(regexp_replace(p_brand || '/' || p_size, '[^A-Za-z0-9]', '', 'g')) AS key FROM part),
i AS (SELECT * FROM p WHERE b % 2 = 1 OR p_partkey % 10 <> 9),
k AS (SELECT key, count(DISTINCT p_partkey) AS n, min(p_partkey) AS target, min(p_brand) AS cohort FROM i GROUP BY 1),
c AS (SELECT p_brand AS cohort, count(*) + max(CASE WHEN b % 5 = 0 THEN 1 ELSE 0 END) AS declared, count(*) AS held, count(*) FILTER (WHERE b % 2 = 0 AND p_partkey % 10 = 9) AS unread FROM p GROUP BY 1),
r AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_suppkey % 17 = 0 THEN ' ' WHEN l_suppkey % 19 = 0 THEN 'B#1' WHEN l_suppkey % 23 = 0 THEN 'Brand of size' ELSE 'brand ' || (l_partkey % 26) || '-' || (l_suppkey % 51) END AS raw FROM lineitem),
s AS (SELECT r.*, upper(regexp_replace(raw, '[^A-Za-z0-9]', '', 'g')) AS rk FROM r),
v AS (SELECT l_orderkey, l_linenumber, CASE WHEN trim(raw) = '' OR length(rk) < 6 OR length(rk) > 40 OR NOT regexp_matches(rk, '[0-9]') OR NOT regexp_matches(rk, '[A-Z]') THEN 'REFUSED' WHEN n IS NULL THEN 'TARGET_NOT_HELD' WHEN n > 1 THEN 'AMBIGUOUS'
  WHEN target = l_partkey THEN 'SELF_REFERENCE' WHEN coalesce(unread > 0, true) THEN 'UNIQUE_UNCONFIRMED_STALE_INDEX' WHEN held < declared THEN 'UNIQUE_UNCONFIRMED_COHORT' ELSE 'UNIQUE' END AS state, target FROM s LEFT JOIN k ON rk = key LEFT JOIN c USING (cohort))"""


def states(t: Tables) -> DataFrame:
    number = F.regexp_extract("p_brand", "([0-9]+)", 1).cast("int")
    parts = t.part.select("p_partkey", F.col("p_brand").alias("cohort"), number.alias("b"), lookup_key(F.concat_ws("/", "p_brand", F.col("p_size").cast("string"))).alias("key"))
    unread = (F.col("b") % 2 == 0) & (F.col("p_partkey") % 10 == 9)
    cohorts = parts.groupBy("cohort").agg((F.count(F.lit(1)) + F.max(F.when(F.col("b") % 5 == 0, 1).otherwise(0))).alias("declared"), F.count(F.lit(1)).alias("held"), F.count_if(unread).alias("unread"))
    s = lambda c: c.cast("string")
    raw = F.when(F.col("l_suppkey") % 17 == 0, " ").when(F.col("l_suppkey") % 19 == 0, "B#1").when(F.col("l_suppkey") % 23 == 0, "Brand of size").otherwise(F.concat(F.lit("brand "), s(F.col("l_partkey") % 26), F.lit("-"), s(F.col("l_suppkey") % 51)))
    references = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", raw.alias("raw"))
    return resolver.resolve(references, "raw", "l_partkey", parts.where(~unread).select("key", F.col("p_partkey").alias("target"), "cohort"), cohorts)


@query("graph_reference_states", f"WITH {STATES} SELECT l_orderkey, l_linenumber, state, CASE WHEN state LIKE 'UNIQUE%' THEN target END AS target FROM v")
def reference_states(t: Tables) -> DataFrame:
    return states(t).select("l_orderkey", "l_linenumber", "state", "target")


@query("graph_state_rates", f"WITH {STATES} SELECT state, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS rate FROM v GROUP BY 1")
def state_rates(t: Tables) -> DataFrame:
    counted = states(t).groupBy("state").agg(F.count(F.lit(1)).alias("n"))
    total = counted.agg(F.sum("n").alias("_all"))
    return counted.join(F.broadcast(total)).select("state", "n", F.round(F.col("n") / F.col("_all"), 6).alias("rate"))  # one row, seven states


@query("graph_edges_reresolved", """
WITH k AS (SELECT upper('CL' || (1990 + o_custkey % 20) || 'N' || o_custkey) AS key, count(DISTINCT o_orderkey) AS n, min(o_orderkey) AS found, list(DISTINCT year(o_orderdate)) AS years FROM orders GROUP BY o_custkey),
e AS (SELECT l_orderkey AS source, l_linenumber, CASE WHEN l_linenumber = 7 THEN '' WHEN l_suppkey % 9 = 0 THEN 'Cl. N ' || l_partkey ELSE 'Cl. ' || (1990 + l_partkey % 20) || ' n ' || l_partkey END AS cited, CASE WHEN l_suppkey % 4 = 0 THEN l_suppkey END AS target FROM lineitem),
j AS (SELECT e.*, k.n, k.found, k.years, nullif(regexp_extract(cited, '(1[89][0-9]{2}|20[0-9]{2})', 1), '')::INT AS yr FROM e LEFT JOIN k ON target IS NULL AND cited <> '' AND upper(regexp_replace(cited, '[^A-Za-z0-9]', '', 'g')) = key),
v AS (SELECT *, CASE WHEN target IS NOT NULL THEN 'kept' WHEN cited = '' THEN 'cites_nothing' WHEN n IS NULL THEN 'not_held' WHEN n > 1 THEN 'several_targets' WHEN yr IS NULL THEN 'no_year' WHEN NOT list_contains(years, yr) THEN 'year_guard' WHEN found = source THEN 'self_reference' ELSE 'resolved' END AS verdict FROM j)
SELECT source, l_linenumber, CASE WHEN verdict = 'resolved' THEN found ELSE target END AS target, verdict FROM v""")
def edges_reresolved(t: Tables) -> DataFrame:
    s = lambda c: c.cast("string")
    cited = F.when(F.col("l_linenumber") == 7, "").when(F.col("l_suppkey") % 9 == 0, F.concat(F.lit("Cl. N "), s(F.col("l_partkey")))).otherwise(F.concat(F.lit("Cl. "), s(F.lit(1990) + F.col("l_partkey") % 20), F.lit(" n "), s(F.col("l_partkey"))))
    edges = t.lineitem.select(F.col("l_orderkey").alias("source"), "l_linenumber", cited.alias("cited"), F.when(F.col("l_suppkey") % 4 == 0, F.col("l_suppkey")).alias("target"))
    key = F.concat(F.lit("CL"), s(F.lit(1990) + F.col("o_custkey") % 20), F.lit("N"), s(F.col("o_custkey")))
    index = t.orders.select(key.alias("key"), F.col("o_orderkey").alias("target"), F.array(F.year("o_orderdate")).alias("years"))
    return resolver.reresolve(edges, index).select("source", "l_linenumber", "target", "verdict")


@query("graph_effect_from_status", """
WITH e AS (SELECT l_partkey AS part, CASE l_returnflag WHEN 'R' THEN CASE WHEN l_linenumber % 2 = 0 THEN 'overruled' ELSE 'overruled_in_part' END WHEN 'A' THEN 'doubted' ELSE 'followed' END AS rel, l_quantity < 10 AS defect FROM lineitem),
b AS (SELECT part, min(CASE WHEN NOT defect THEN CASE rel WHEN 'overruled' THEN 1 WHEN 'overruled_in_part' THEN 2 ELSE 3 END END) AS best FROM e WHERE rel <> 'followed' AND part % 6 <> 0 AND (part % 5 <> 0 OR defect) AND (part % 7 <> 0 OR rel = 'doubted') GROUP BY 1),
s AS (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'set_aside' WHEN 2 THEN 'partly_set_aside' ELSE 'doubted' END AS status FROM part)
SELECT p_partkey, CASE WHEN status = 'none' THEN 'none' WHEN part IS NOT NULL AND best IS NULL THEN 'evidence_defect' WHEN best IS NULL THEN status WHEN best > CASE status WHEN 'set_aside' THEN 1 WHEN 'partly_set_aside' THEN 2 ELSE 3 END THEN 'review_required'
  ELSE CASE best WHEN 1 THEN 'set_aside' WHEN 2 THEN 'partly_set_aside' ELSE 'doubted' END END AS effect FROM s LEFT JOIN b ON part = p_partkey""")
def effect_from_status(t: Tables) -> DataFrame:
    relationship = F.when(F.col("l_returnflag") == "R", F.when(F.col("l_linenumber") % 2 == 0, "overruled").otherwise("overruled_in_part")).when(F.col("l_returnflag") == "A", "doubted").otherwise("followed")
    edges = t.lineitem.select(F.col("l_partkey").alias("p_partkey"), relationship.alias("relationship"), (F.col("l_quantity") < 10).alias("defect"))
    edges = edges.where("p_partkey % 6 <> 0 and (p_partkey % 5 <> 0 or defect) and (p_partkey % 7 <> 0 or relationship = 'doubted')")
    status = F.when(F.col("p_size") % 4 == 0, "none").when(F.col("p_size") % 4 == 1, "set_aside").when(F.col("p_size") % 4 == 2, "partly_set_aside").otherwise("doubted")
    return resolver.effects(t.part.select("p_partkey", status.alias("status")), edges, "p_partkey")


@query("graph_chronology_gate", """
SELECT l_orderkey, l_linenumber, CASE WHEN l_suppkey % 3 <> 0 AND o_orderkey % 5 <> 0 THEN l_shipdate::DATE >= o_orderdate::DATE + 30 ELSE year(l_shipdate) >= year(o_orderdate::DATE + 30) END AS may FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def chronology_gate(t: Tables) -> DataFrame:
    """Whether a line comes after its order: by days where both are known, else by years."""
    joined = t.lineitem.join(t.orders.select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    shipped, began = F.col("l_shipdate").cast("date"), F.date_add(F.col("o_orderdate").cast("date"), 30)
    may = resolver.in_time(F.when(F.col("l_suppkey") % 3 != 0, shipped), F.year(shipped), F.when(F.col("o_orderkey") % 5 != 0, began), F.year(began))
    return joined.select("l_orderkey", "l_linenumber", may.alias("may"))
