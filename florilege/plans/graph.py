"""Citation-style graphs. Edges are order lines: an order cites parts; the return flag is the treatment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from florilege.operators import joins, rows
from florilege.plans.catalog import Tables, query

RANK = "CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END"


def severity():
    return F.when(F.col("l_returnflag") == "R", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2)


@query("graph_treatment_counts", "SELECT l_partkey, count(*) AS total, count(*) FILTER (WHERE l_returnflag = 'R') AS negative, count(*) FILTER (WHERE l_returnflag = 'A') AS doubted, count(*) FILTER (WHERE l_returnflag = 'N') AS neutral FROM lineitem GROUP BY 1")
def treatment_counts(t: Tables) -> DataFrame:
    is_ = lambda flag: F.count_if(F.col("l_returnflag") == flag)
    return t.lineitem.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("total"), is_("R").alias("negative"), is_("A").alias("doubted"), is_("N").alias("neutral"))


@query("graph_neighbourhood", """
WITH e AS (SELECT DISTINCT l_orderkey AS s, l_suppkey AS d FROM lineitem), deg AS (SELECT d AS node, count(*) AS degree FROM e GROUP BY 1)
SELECT 'out' AS direction, s AS node, d AS neighbour, degree FROM e JOIN deg ON deg.node = e.d WHERE s <= 100 UNION ALL SELECT 'in', d, s, degree FROM e JOIN deg ON deg.node = e.d WHERE d <= 2""")
def neighbourhood(t: Tables) -> DataFrame:
    e = t.lineitem.select("l_orderkey", "l_suppkey").distinct()
    degree = e.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("degree"))
    both = joins.both_directions(e.join(degree, "l_suppkey").where("l_orderkey <= 100 OR l_suppkey <= 2"), "l_orderkey", "l_suppkey")
    wanted = both.where("(direction = 'out' AND node <= 100) OR (direction = 'in' AND node <= 2)")
    other = F.when(F.col("direction") == "out", F.col("neighbour")).otherwise(F.col("node"))
    return wanted.withColumn("l_suppkey", other).join(degree, "l_suppkey").select("direction", "node", "neighbour", "degree")


@query("graph_strongest_treatment", f"SELECT l_partkey, CASE min({RANK}) WHEN 0 THEN 'R' WHEN 1 THEN 'A' ELSE 'N' END AS strongest FROM lineitem GROUP BY 1")
def strongest(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_partkey").agg(F.min_by("l_returnflag", severity()).alias("strongest"))


EFFECT = """
WITH c AS (SELECT l_partkey, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS r, count(*) FILTER (WHERE l_returnflag = 'A') AS a FROM lineitem WHERE l_quantity > 1 GROUP BY 1),
e AS (SELECT p_partkey, CASE WHEN n IS NULL THEN 'unknown' WHEN r >= 0.4 * n THEN 'overruled' WHEN r >= 0.25 * n AND a >= 0.25 * n THEN 'review_required' WHEN a >= 0.4 * n THEN 'doubted' ELSE 'good' END AS effect FROM part LEFT JOIN c ON p_partkey = l_partkey)
"""


def effects(t: Tables) -> DataFrame:
    c = t.lineitem.where("l_quantity > 1").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("r"), F.count_if(F.col("l_returnflag") == "A").alias("a"))
    n, r, a = F.col("n"), F.col("r"), F.col("a")
    effect = F.when(n.isNull(), "unknown").when(r >= 0.4 * n, "overruled").when((r >= 0.25 * n) & (a >= 0.25 * n), "review_required").when(a >= 0.4 * n, "doubted").otherwise("good")
    return t.part.join(c, F.col("p_partkey") == F.col("l_partkey"), "left").select("p_partkey", effect.alias("effect"))


@query("graph_effect_states", EFFECT + "SELECT p_partkey, effect FROM e")
def effect_states(t: Tables) -> DataFrame:
    return effects(t)


@query("graph_effect_policy", EFFECT + "SELECT effect, may_cite, warn, count(*) AS n FROM e JOIN (VALUES ('unknown', false, true), ('overruled', false, true), ('review_required', false, true), ('doubted', true, true), ('good', true, false)) p(name, may_cite, warn) ON effect = name GROUP BY 1, 2, 3")
def effect_policy(t: Tables) -> DataFrame:
    policy = t.spark.createDataFrame([("unknown", False, True), ("overruled", False, True), ("review_required", False, True), ("doubted", True, True), ("good", True, False)], "effect string, may_cite boolean, warn boolean")
    return effects(t).join(F.broadcast(policy), "effect").groupBy("effect", "may_cite", "warn").agg(F.count(F.lit(1)).alias("n"))  # five rows


@query("graph_propagation_candidates", f"""
SELECT DISTINCT ON (l_partkey) l_partkey, l_orderkey, l_returnflag FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag IN ('R', 'A') ORDER BY l_partkey, {RANK}, (l_shipdate < o_orderdate) , o_orderdate DESC, l_orderkey, l_linenumber""")
def propagation(t: Tables) -> DataFrame:
    j = t.lineitem.where("l_returnflag IN ('R', 'A')").join(t.orders.select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    order = [severity(), F.col("l_shipdate") < F.col("o_orderdate"), F.desc("o_orderdate"), F.col("l_orderkey"), F.col("l_linenumber")]
    return rows.first_per_group(j, ["l_partkey"], order).select("l_partkey", "l_orderkey", "l_returnflag")


@query("graph_standing_as_at", """
WITH o AS (SELECT l_partkey, min(l_shipdate) AS moved FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT l_orderkey, l_linenumber, CASE WHEN o_orderdate IS NULL THEN 'date_unreliable' WHEN moved IS NULL THEN 'good_law_then' WHEN moved = l_shipdate AND l_returnflag = 'R' THEN 'overruled_here' WHEN moved <= o_orderdate THEN 'already_moved' ELSE 'moved_since' END AS standing
FROM lineitem l JOIN orders ON l_orderkey = o_orderkey LEFT JOIN o USING (l_partkey)""")
def standing_as_at(t: Tables) -> DataFrame:
    moved = t.lineitem.where("l_returnflag = 'R'").groupBy("l_partkey").agg(F.min("l_shipdate").alias("moved"))
    j = t.lineitem.join(t.orders.select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey")).join(moved, "l_partkey", "left")
    state = (
        F.when(F.col("o_orderdate").isNull(), "date_unreliable").when(F.col("moved").isNull(), "good_law_then")
        .when((F.col("moved") == F.col("l_shipdate")) & (F.col("l_returnflag") == "R"), "overruled_here").when(F.col("moved") <= F.col("o_orderdate"), "already_moved").otherwise("moved_since")
    )
    return j.select("l_orderkey", "l_linenumber", state.alias("standing"))


@query("graph_alert_fanout", """
SELECT DISTINCT o_custkey, l_partkey, CASE WHEN min(CASE l_returnflag WHEN 'R' THEN 0 ELSE 1 END) OVER (PARTITION BY o_custkey, l_partkey) = 0 THEN 'high' ELSE 'low' END AS severity, sha256(o_custkey || ':' || l_partkey) AS dedupe_key FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag IN ('R', 'A') AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)""")
def alert_fanout(t: Tables) -> DataFrame:
    j = t.lineitem.where("l_returnflag IN ('R', 'A')").join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    j = j.join(t.customer.where("c_acctbal < 0"), F.col("o_custkey") == F.col("c_custkey"), "left_anti")
    out = j.groupBy("o_custkey", "l_partkey").agg(F.min(severity()).alias("s"))
    return out.select("o_custkey", "l_partkey", F.when(F.col("s") == 0, "high").otherwise("low").alias("severity"), F.sha2(F.concat_ws(":", F.col("o_custkey").cast("string"), F.col("l_partkey").cast("string")), 256).alias("dedupe_key"))


@query("graph_recheck_divergence", f"""
WITH live AS (SELECT l_partkey, min({RANK}) AS s FROM lineitem GROUP BY 1), shown AS (SELECT l_partkey, min({RANK}) AS s FROM lineitem WHERE l_shipdate < TIMESTAMP '1996-01-01' GROUP BY 1)
SELECT l_partkey, shown.s AS rendered, live.s AS live FROM live LEFT JOIN shown USING (l_partkey) WHERE live.s IS DISTINCT FROM shown.s""")
def recheck(t: Tables) -> DataFrame:
    live = t.lineitem.groupBy("l_partkey").agg(F.min(severity()).alias("live"))
    shown = t.lineitem.where("l_shipdate < timestamp_ntz'1996-01-01'").groupBy("l_partkey").agg(F.min(severity()).alias("rendered"))
    return live.join(shown, "l_partkey", "left").where(~F.col("live").eqNullSafe(F.col("rendered"))).select("l_partkey", "rendered", "live")


@query("graph_common_group", "SELECT doc_id, sha256(text) AS h, count(*) OVER (PARTITION BY sha256(text)) AS group_size FROM documents")
def common_group(t: Tables) -> DataFrame:
    hashed = t.documents.select("doc_id", F.sha2("text", 256).alias("h"))
    return hashed.join(hashed.groupBy("h").agg(F.count(F.lit(1)).alias("group_size")), "h").select("doc_id", "h", "group_size")


@query("graph_reference_resolution", """
WITH k AS (SELECT p_brand || '/' || p_size AS key, count(DISTINCT p_partkey) AS n, min(p_partkey) AS target FROM part GROUP BY 1),
r AS (SELECT l_orderkey, l_linenumber, l_partkey, 'Brand#' || (l_partkey % 60) || '/' || (l_suppkey % 55) AS key FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 97 = 0 THEN 'REFUSED' WHEN n IS NULL THEN 'TARGET_NOT_HELD' WHEN n > 1 THEN 'AMBIGUOUS' WHEN target = l_partkey THEN 'SELF_REFERENCE' ELSE 'UNIQUE' END AS verdict FROM r LEFT JOIN k USING (key)""")
def reference_resolution(t: Tables) -> DataFrame:
    k = t.part.select(F.concat_ws("/", "p_brand", F.col("p_size").cast("string")).alias("key"), "p_partkey").groupBy("key").agg(F.count_distinct("p_partkey").alias("n"), F.min("p_partkey").alias("target"))
    key = F.concat(F.lit("Brand#"), (F.col("l_partkey") % 60).cast("string"), F.lit("/"), (F.col("l_suppkey") % 55).cast("string"))
    r = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", key.alias("key")).join(k, "key", "left")
    verdict = F.when(F.col("l_partkey") % 97 == 0, "REFUSED").when(F.col("n").isNull(), "TARGET_NOT_HELD").when(F.col("n") > 1, "AMBIGUOUS").when(F.col("target") == F.col("l_partkey"), "SELF_REFERENCE").otherwise("UNIQUE")
    return r.select("l_orderkey", "l_linenumber", verdict.alias("verdict"))


@query("graph_edge_year_guard", """
SELECT l_orderkey, l_linenumber, CASE WHEN year(l_shipdate) < year(o_orderdate) THEN 'refused_year' WHEN year(l_shipdate) - year(o_orderdate) > 1 THEN 'refused_lag' ELSE 'kept' END AS verdict FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def edge_year_guard(t: Tables) -> DataFrame:
    lag = F.year("l_shipdate") - F.year("o_orderdate")
    j = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return j.select("l_orderkey", "l_linenumber", F.when(lag < 0, "refused_year").when(lag > 1, "refused_lag").otherwise("kept").alias("verdict"))


@query("graph_alias_unique", "SELECT p_name AS alias, min(p_brand) AS target FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) = 1")
def alias_unique(t: Tables) -> DataFrame:
    return joins.unique_keys(t.part.select(F.col("p_name").alias("alias"), F.col("p_brand").alias("target")), "alias", "target")


@query("graph_match_verdict", """
WITH c AS (SELECT o_custkey, o_totalprice / 500000 AS score, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders),
s AS (SELECT c_custkey, max(score) FILTER (WHERE rn = 1) AS a, max(score) FILTER (WHERE rn = 2) AS b FROM customer LEFT JOIN c ON c_custkey = o_custkey AND rn <= 2 GROUP BY 1)
SELECT c_custkey, CASE WHEN a IS NULL OR a < 0.34 THEN 'no_candidate' WHEN coalesce(b, 0) >= 0.85 * a THEN 'ambiguous' WHEN a < 0.45 THEN 'thin' ELSE 'safe' END AS verdict FROM s""")
def match_verdict(t: Tables) -> DataFrame:
    top = rows.top_n_per_group(t.orders.select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 2)
    score = F.col("o_totalprice") / 500000
    s = top.groupBy("o_custkey").agg(F.max(F.when(F.col("rn") == 1, score)).alias("a"), F.max(F.when(F.col("rn") == 2, score)).alias("b"))
    a, b = F.col("a"), F.coalesce("b", F.lit(0.0))
    verdict = F.when(a.isNull() | (a < 0.34), "no_candidate").when(b >= 0.85 * a, "ambiguous").when(a < 0.45, "thin").otherwise("safe")
    return t.customer.join(s, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", verdict.alias("verdict"))


@query("graph_inbound_degree", "SELECT l_partkey, count(*) AS inbound, count(DISTINCT l_suppkey) AS sources FROM lineitem GROUP BY 1")
def inbound_degree(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("inbound"), F.count_distinct("l_suppkey").alias("sources"))


@query("graph_cohort_check", """
SELECT o_orderkey, (o_orderkey % 7) + 1 AS declared, coalesce(held, 0) AS held, CASE WHEN held IS NULL THEN 'missing' WHEN held < (o_orderkey % 7) + 1 THEN 'short' WHEN held > (o_orderkey % 7) + 1 THEN 'over' ELSE 'equal' END AS verdict FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS held FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey""")
def cohort_check(t: Tables) -> DataFrame:
    held = t.lineitem.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("h"))
    declared = F.col("o_orderkey") % 7 + 1
    verdict = F.when(F.col("h").isNull(), "missing").when(F.col("h") < declared, "short").when(F.col("h") > declared, "over").otherwise("equal")
    return t.orders.join(held, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", declared.alias("declared"), F.coalesce("h", F.lit(0)).alias("held"), verdict.alias("verdict"))


@query("graph_co_citation", """
SELECT a.l_partkey AS a, b.l_partkey AS b, count(*) AS n FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) a JOIN (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey GROUP BY 1, 2 HAVING count(*) >= 2""")
def co_citation(t: Tables) -> DataFrame:
    """An order has few lines, so the pairs within one stay few."""
    n = t.lineitem.count()
    e = rows.dealt(t.lineitem.select("l_orderkey", "l_partkey"), ["l_orderkey"], n).distinct()
    pairs = e.toDF("o", "a").join(e.toDF("o", "b"), "o").where("a < b")
    # an order of seven lines has three pairs for each line
    return rows.dealt(pairs, ["a", "b"], 3 * n).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
