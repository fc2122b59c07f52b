"""Claims about whose words a span are, over reports made of order lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from florilege.operators import roles
from florilege.plans.catalog import Tables, query


@query("ref_role_verdicts", """
WITH n AS (SELECT l_orderkey, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n, CASE l_returnflag WHEN 'A' THEN 'submission' WHEN 'R' THEN 'operative' ELSE 'court' END AS voice FROM lineitem),
c AS (SELECT *, CASE l_suppkey % 4 WHEN 0 THEN 'holding' WHEN 1 THEN 'argument_petitioner' WHEN 2 THEN 'relief_granted' ELSE 'headline' END AS role FROM n)
SELECT l_orderkey, n - 1 AS claim_no, CASE WHEN l_orderkey % 50 = 0 THEN 'damaged' WHEN l_partkey % 11 = 0 THEN 'unsupported' WHEN role = 'headline' THEN 'unproven' WHEN role = 'holding' AND voice <> 'submission' OR role = 'argument_petitioner' AND voice = 'submission' OR role = 'relief_granted' AND voice = 'operative' THEN 'accepted' ELSE 'mismatch' END AS verdict FROM c""")
def role_verdicts(t: Tables) -> DataFrame:
    """Each line of an order is a paragraph in some voice and a claim about it; every eleventh part is quoted wrongly. The
    SQL has the verdicts from the columns."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    said = F.concat(F.lit("lot "), F.col("l_partkey").cast("string"), F.lit(" of store "), F.col("l_suppkey").cast("string"), F.lit(" was sold to buyer "), F.col("l_orderkey").cast("string"))
    opening = F.when(F.col("l_returnflag") == "A", "Learned counsel for the buyer urged that ").when(F.col("l_returnflag") == "R", "For the reasons\nstated, ").otherwise("We hold that ")
    role = F.element_at(F.array(*[F.lit(r) for r in ("holding", "argument_petitioner", "relief_granted", "headline")]), (F.col("l_suppkey") % 4 + 1).cast("int"))
    quoted = F.when(F.col("l_partkey") % 11 == 0, F.concat(F.lit("nothing was ever said of "), F.reverse(said))).otherwise(F.concat(said, F.lit(" line "), F.row_number().over(order).cast("string")))
    line = t.lineitem.select("l_orderkey", F.row_number().over(order).alias("n"), F.concat(opening, said, F.lit(" line "), F.row_number().over(order).cast("string"), F.lit(" end.\n")).alias("p"), role.alias("role"), quoted.alias("span"))
    # an order has a few lines
    told = line.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("n", "p", "role", "span"))).alias("x"))
    docs = told.select(
        "l_orderkey", F.array_join(F.transform("x", lambda s: s["p"]), "").alias("text"), (F.col("l_orderkey") % 50 == 0).alias("unsafe"), F.lit(None).cast("date").alias("decided"),
        F.transform("x", lambda s: F.struct(s["role"].alias("role"), s["span"].alias("span"))).alias("claims"),
    )
    return roles.verified(docs, "l_orderkey").select("l_orderkey", F.col("claim_no").cast("long").alias("claim_no"), "verdict")
