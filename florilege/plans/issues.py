"""Statements of issues in decisions made of orders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from florilege.operators import issues
from florilege.plans.catalog import Tables, query

ASKED = "'the sale of order ' || o_orderkey || ' to buyer ' || o_custkey || ' can stand in law'"


@query("doc_stated_issues", f"""
SELECT o_orderkey, 1 AS ordinal, CASE WHEN o_orderkey % 5 = 0 THEN 'Whether ' || {ASKED} || '?' WHEN o_orderkey % 5 = 1 THEN 'The question that arises for consideration is whether ' || {ASKED} || '.' ELSE 'whether ' || {ASKED} END AS statement,
  CASE WHEN o_orderkey % 5 = 0 THEN 'question' WHEN o_orderkey % 5 = 1 THEN 'announced' ELSE 'point' END AS via FROM orders WHERE o_orderkey % 5 <= 2
UNION ALL SELECT o_orderkey, 2, 'Whether the price of ' || (o_custkey + 1000) || ' was paid to the seller in time?', 'point' FROM orders WHERE o_orderkey % 5 = 2""")
def stated_issues(t: Tables) -> DataFrame:
    """Orders that ask, announce or list an issue, that say what is not one, or that have a headnote. The SQL has
    the statements from the columns."""
    s, k = lambda c: F.col(c).cast("string"), F.col("o_orderkey") % 5
    asked = F.concat(F.lit("the sale of order "), s("o_orderkey"), F.lit(" to buyer "), s("o_custkey"), F.lit(" can stand\nin law"))
    second = F.concat(F.lit("Whether the price of "), (F.col("o_custkey") + 1000).cast("string"), F.lit(" was paid to the seller in time?"))
    stated = (
        F.when(k == 0, F.concat(F.lit("Whether "), asked, F.lit("? ")))
        .when(k == 1, F.concat(F.lit("The question that arises for consideration is whether "), asked, F.lit(". ")))
        .when(k == 2, F.concat(F.lit("The following points fall for decision: (i) whether "), asked, F.lit("; (ii) "), second, F.lit(" ")))
        .when(k == 3, F.concat(F.lit("The question is not whether "), asked, F.lit(". ")))
        .otherwise(F.concat(F.lit("HELD: The question is whether "), asked, F.lit(". ")))
    )
    text = F.concat(F.lit("The facts are plain. "), stated, F.lit("The sum of 3.5 was paid. "), stated, F.lit("So it ends."))
    return issues.issues(t.orders.select("o_orderkey", text.alias("text")), "o_orderkey", "text").select("o_orderkey", "ordinal", "statement", "via")
