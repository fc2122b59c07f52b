"""Fielded search: orders as decisions, suppliers as the queries that ask for them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from florilege.operators import fields
from florilege.plans.catalog import Tables, query

DECISIONS = """
d AS (SELECT o_orderkey, c_name AS party, o_orderpriority AS judge, year(o_orderdate) AS yr, o_custkey % 9 + 1 AS vol, o_orderkey % 500 AS page, o_orderkey % 1000 AS serial, o_orderdate::DATE AS day,
  c_mktsegment AS court, c_nationkey AS act, o_orderkey % 40 AS section, o_orderstatus AS kind FROM orders JOIN customer ON o_custkey = c_custkey),
found AS (SELECT s_suppkey AS query_id, o_orderkey FROM supplier JOIN d ON CASE s_suppkey % 6
  WHEN 0 THEN act = s_nationkey AND day BETWEEN DATE '1995-03-10' AND DATE '1996-01-20' AND kind <> 'F'
  WHEN 1 THEN serial = s_suppkey AND yr = 1995
  WHEN 2 THEN section = s_suppkey % 40 AND list_contains(regexp_extract_all(lower(party), '[a-z0-9]+'), 'customer') AND len(list_filter(regexp_extract_all(lower(judge), '[a-z0-9]+'), lambda w: starts_with(w, 'urge'))) > 0
  WHEN 3 THEN vol = s_nationkey % 9 + 1 AND page = s_suppkey % 500 AND yr = 1996
  WHEN 4 THEN o_orderkey = s_suppkey AND court <> 'BUILDING' ELSE false END)"""


def decisions(t: Tables) -> DataFrame:
    s, year = lambda c: c.cast("string"), F.year("o_orderdate").cast("string")
    joined = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return joined.select(
        "o_orderkey", F.col("c_name").alias("party"), F.col("o_orderpriority").alias("judge"), F.concat(F.lit("("), year, F.lit(") "), s(F.col("o_custkey") % 9 + 1), F.lit(" SCC "), s(F.col("o_orderkey") % 500)).alias("cite"),
        F.concat(F.lit("W.P./"), s(F.col("o_orderkey") % 1000), F.lit("/"), year).alias("caseno"), F.concat(F.lit("CN-"), s(F.col("o_orderkey"))).alias("cnr"), F.col("c_mktsegment").alias("court"), F.col("o_orderdate").cast("date").alias("date"),
        F.concat(F.lit("Act "), s(F.col("c_nationkey"))).alias("act"), s(F.col("o_orderkey") % 40).alias("section"), F.col("o_orderstatus").alias("type"), F.concat_ws(" ", "c_name", "o_orderpriority").alias("text"),
    )


def asked(t: Tables) -> DataFrame:
    """One to three conditions for each supplier; those of kind 5 only negate."""
    s = lambda c: c.cast("string")
    k = F.col("s_suppkey")

    def cond(no: int, field: str, op: str, value, upto=F.lit(None), negated: bool = False):
        return F.struct(F.lit(no).alias("cond_no"), F.lit(field).alias("field"), F.lit(op).alias("op"), value.alias("value"), upto.cast("string").alias("upto"), F.lit(negated).alias("negated"))

    kinds = [
        F.array(cond(1, "act", "is", F.concat(F.lit("ACT "), s(F.col("s_nationkey")))), cond(2, "date", "between", F.lit("1995-03-10"), F.lit("1996-01-20")), cond(3, "type", "is", F.lit("f"), negated=True)),
        F.array(cond(1, "caseno", "caseno", F.concat(F.when(k % 4 == 1, "W P ").otherwise("/"), s(k), F.lit(" of 1995")))),
        F.array(cond(1, "section", "is", s(k % 40)), cond(2, "party", "word", F.lit("Customer")), cond(3, "judge", "prefix", F.lit("urge"))),
        F.array(cond(1, "cite", "is", F.concat(F.lit("1996 "), s(F.col("s_nationkey") % 9 + 1), F.lit(" scc "), s(k % 500)))),
        F.array(cond(1, "cnr", "is", F.concat(F.lit("cn"), s(k))), cond(2, "court", "is", F.lit("Building"), negated=True)),
        F.array(cond(1, "type", "is", F.lit("O"), negated=True)),
    ]
    chosen = kinds[5]
    for i in range(5):
        chosen = F.when(k % 6 == i, kinds[i]).otherwise(chosen)
    return t.supplier.select(k.alias("query_id"), F.explode(chosen).alias("c")).select("query_id", "c.*")


@query("search_fielded_queries", f"WITH {DECISIONS} SELECT query_id, o_orderkey FROM found")
def fielded_queries(t: Tables) -> DataFrame:
    """All eleven fields are in the index; the queries ask for ten, by value, word, prefix, number and day."""
    return fields.search(fields.index(decisions(t), "o_orderkey"), "o_orderkey", asked(t))


@query("search_fielded_outcomes", f"""
WITH {DECISIONS} SELECT s_suppkey AS query_id, CASE WHEN s_suppkey % 6 = 5 THEN 'refused' WHEN count(o_orderkey) = 0 THEN 'no_match' ELSE 'matched' END AS outcome, count(o_orderkey) AS n FROM supplier LEFT JOIN found ON query_id = s_suppkey GROUP BY 1""")
def fielded_outcomes(t: Tables) -> DataFrame:
    """What each query comes to; one that only negates is refused."""
    conditions = asked(t)
    return fields.named(conditions, fields.counts(fields.index(decisions(t), "o_orderkey"), "o_orderkey", conditions))
