"""Scans, filters, joins, aggregates, windows, sorts and set operations on the relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from florilege.operators import joins, rows
from florilege.plans.catalog import Tables, query

MONTH = "CAST(date_trunc('month', {}) AS DATE)"


# ---- filters and projections

@query("filter_value_band", """
SELECT o_orderkey, CASE WHEN o_totalprice >= 300000 THEN 'a' WHEN o_totalprice >= 200000 THEN 'b' WHEN o_totalprice >= 100000 THEN 'c' WHEN o_totalprice >= 50000 THEN 'd' ELSE 'e' END AS band FROM orders""")
def value_band(t: Tables) -> DataFrame:
    p = F.col("o_totalprice")
    band = F.when(p >= 300000, "a").when(p >= 200000, "b").when(p >= 100000, "c").when(p >= 50000, "d").otherwise("e")
    return t.orders.select("o_orderkey", band.alias("band"))


@query("filter_tier_with_join_flag", """
SELECT o_orderkey, CASE WHEN r.l_orderkey IS NULL AND o_totalprice >= 150000 THEN 'gold' WHEN r.l_orderkey IS NULL THEN 'plain' WHEN o_orderstatus = 'F' THEN 'returned-closed' ELSE 'returned' END AS tier
FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R') r ON o_orderkey = r.l_orderkey""")
def tier_with_join_flag(t: Tables) -> DataFrame:
    returned = t.lineitem.where("l_returnflag = 'R'").select("l_orderkey").distinct()
    none = F.col("l_orderkey").isNull()
    tier = F.when(none & (F.col("o_totalprice") >= 150000), "gold").when(none, "plain").when(F.col("o_orderstatus") == "F", "returned-closed").otherwise("returned")
    return t.orders.join(returned, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", tier.alias("tier"))


@query("filter_optional_conditions", """
SELECT o_orderkey, o_orderpriority, o_orderdate FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-12-31 23:59:59.999999' AND o_orderstatus = 'O'""")
def optional_conditions(t: Tables) -> DataFrame:
    asked = {"priorities": ["1-URGENT", "2-HIGH"], "year": 1996, "status": "O", "customer": None}
    df = t.orders
    if asked["priorities"]:
        df = df.where(F.col("o_orderpriority").isin(asked["priorities"]))
    if asked["year"]:
        year = asked["year"]  # a year means all of it
        df = df.where(F.col("o_orderdate").between(F.lit(f"{year}-01-01 00:00:00").cast("timestamp_ntz"), F.lit(f"{year}-12-31 23:59:59.999999").cast("timestamp_ntz")))
    if asked["status"]:
        df = df.where(F.col("o_orderstatus") == asked["status"])
    if asked["customer"]:
        df = df.where(F.col("o_custkey") == asked["customer"])
    return df.select("o_orderkey", "o_orderpriority", "o_orderdate")


@query("filter_wildcard_like", r"""
SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%re%n_' ESCAPE '\' OR p_type ILIKE 'promo%' ESCAPE '\'""")
def wildcard_like(t: Tables) -> DataFrame:
    from florilege.functions.text import wildcard

    return t.part.where(F.ilike("p_name", F.lit(wildcard("*re*n?"))) | F.ilike("p_type", F.lit(wildcard("promo*")))).select("p_partkey", "p_name")


@query("filter_regex_family", """
SELECT CASE WHEN regexp_matches(p_type, '(?i)brass|steel') THEN 'hard' WHEN regexp_matches(p_type, '(?i)tin|copper|nickel') THEN 'soft' ELSE 'other' END AS family, count(*) AS n FROM part GROUP BY 1""")
def regex_family(t: Tables) -> DataFrame:
    family = F.when(F.col("p_type").rlike("(?i)brass|steel"), "hard").when(F.col("p_type").rlike("(?i)tin|copper|nickel"), "soft").otherwise("other")
    return t.part.groupBy(family.alias("family")).agg(F.count(F.lit(1)).alias("n"))


@query("filter_null_safe", """
SELECT count(*) AS n FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey, l_returnflag FROM lineitem WHERE l_linenumber = 1) l ON o_orderkey = l_orderkey WHERE l_returnflag IS DISTINCT FROM 'R'""")
def null_safe(t: Tables) -> DataFrame:
    first = t.lineitem.where("l_linenumber = 1").select("l_orderkey", "l_returnflag").distinct()
    joined = t.orders.join(first, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return joined.where(~F.col("l_returnflag").eqNullSafe("R")).agg(F.count(F.lit(1)).alias("n"))


@query("filter_array_containment", """
WITH seg AS (SELECT l_orderkey, list(DISTINCT l_returnflag) AS flags FROM lineitem GROUP BY 1)
SELECT l_orderkey, len(flags) AS n FROM seg WHERE list_contains(flags, 'R') AND list_contains(flags, 'A')""")
def array_containment(t: Tables) -> DataFrame:
    seg = t.lineitem.groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("flags"))
    return seg.where(F.array_contains("flags", "R") & F.array_contains("flags", "A")).select("l_orderkey", F.size("flags").cast("long").alias("n"))


# ---- joins

@query("join_inner_three_way", """
SELECT n_name, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2""")
def inner_three_way(t: Tables) -> DataFrame:
    joined = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("join_left_with_counts", """
SELECT c_custkey, coalesce(n, 0) AS n_orders FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey""")
def left_with_counts(t: Tables) -> DataFrame:
    held = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return t.customer.join(held, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"))


@query("join_semi", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R' AND l_quantity > 40)")
def semi(t: Tables) -> DataFrame:
    big = t.lineitem.where("l_returnflag = 'R' AND l_quantity > 40")
    return t.orders.join(big, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey")


@query("join_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def anti(t: Tables) -> DataFrame:
    return t.customer.join(t.orders.where("o_orderstatus = 'P'"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("join_semi_any_bridge", """
SELECT c_custkey FROM customer WHERE c_mktsegment IN (SELECT DISTINCT c_mktsegment FROM customer WHERE c_custkey <= 2)
  OR c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)""")
def semi_any_bridge(t: Tables) -> DataFrame:
    segments = t.customer.where("c_custkey <= 2").select("c_mktsegment")
    nations = t.nation.where("n_regionkey = 1").select("n_nationkey")
    return joins.semi_any(t.customer, [("c_mktsegment", segments), ("c_nationkey", nations)]).select("c_custkey")


@query("join_theta_anti", """
SELECT o.o_orderkey FROM orders o WHERE o.o_orderstatus = 'O' AND NOT EXISTS (SELECT 1 FROM orders p WHERE p.o_custkey = o.o_custkey AND p.o_orderdate >= o.o_orderdate AND p.o_orderkey <> o.o_orderkey)""")
def theta_anti(t: Tables) -> DataFrame:
    o, p = t.orders.where("o_orderstatus = 'O'").alias("o"), t.orders.alias("p")
    on = (F.col("p.o_custkey") == F.col("o.o_custkey")) & (F.col("p.o_orderdate") >= F.col("o.o_orderdate")) & (F.col("p.o_orderkey") != F.col("o.o_orderkey"))
    return o.join(p, on, "left_anti").select("o_orderkey")


@query("join_lateral_latest", """
SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1""")
def lateral_latest(t: Tables) -> DataFrame:
    slim = t.orders.select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    return rows.latest_per_group(slim, ["o_custkey"], ["o_orderdate", "o_orderkey"])


@query("join_unnest_keep_empty", """
SELECT o_orderkey, p.part FROM (SELECT o_orderkey, parts FROM orders LEFT JOIN (SELECT l_orderkey, list(DISTINCT l_partkey) AS parts FROM lineitem WHERE l_discount > 0.08 GROUP BY 1) ON o_orderkey = l_orderkey) s LEFT JOIN LATERAL (SELECT unnest(s.parts) AS part) p ON true""")
def unnest_keep_empty(t: Tables) -> DataFrame:
    parts = t.lineitem.where("l_discount > 0.08").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("parts"))
    held = t.orders.join(parts, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return held.select("o_orderkey", F.explode_outer("parts").alias("part"))


@query("join_unnest_two_shapes", """
SELECT key, count(*) AS n FROM (SELECT upper(p_brand) AS key FROM part UNION ALL SELECT upper(unnest(string_split(p_type, ' '))) FROM part) GROUP BY 1""")
def unnest_two_shapes(t: Tables) -> DataFrame:
    keys = F.explode(F.concat(F.array("p_brand"), F.split("p_type", " ")))
    return t.part.select(keys.alias("key")).groupBy(F.upper("key").alias("key")).agg(F.count(F.lit(1)).alias("n"))


@query("join_pattern_dimension", """
SELECT DISTINCT pattern, o_orderpriority FROM (VALUES ('%urgent'), ('%low%'), ('5-%')) p(pattern) JOIN (SELECT DISTINCT o_orderpriority FROM orders) ON o_orderpriority ILIKE pattern""")
def pattern_dimension(t: Tables) -> DataFrame:
    from florilege.functions.text import wildcard

    names = t.orders.select("o_orderpriority").distinct()
    hits = [names.where(F.ilike("o_orderpriority", F.lit(wildcard(p)))).select(F.lit(wildcard(p)).alias("pattern"), "o_orderpriority") for p in ("*urgent", "*low*", "5-*")]
    return hits[0].unionByName(hits[1]).unionByName(hits[2])


@query("join_as_of", """
SELECT l_orderkey, l_linenumber, l_shipdate, o_orderkey AS last_order FROM (SELECT l_orderkey, l_linenumber, l_shipdate, b.o_custkey AS c FROM lineitem JOIN orders b ON l_orderkey = b.o_orderkey) s
ASOF LEFT JOIN (SELECT o_custkey, o_orderdate, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1, 2) o ON s.c = o.o_custkey AND s.l_shipdate >= o.o_orderdate""")
def as_of(t: Tables) -> DataFrame:
    orders = t.orders.select("o_orderkey", "o_custkey", "o_orderdate")
    ships = t.lineitem.select("l_orderkey", "l_linenumber", "l_shipdate").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", "l_shipdate", "o_custkey")
    latest = orders.groupBy("o_custkey", "o_orderdate").agg(F.max("o_orderkey").alias("last_order"))
    out = joins.as_of(ships, latest, ["o_custkey"], "l_shipdate", "o_orderdate", ["last_order"])
    return out.select("l_orderkey", "l_linenumber", "l_shipdate", "last_order")


@query("join_interval", """
WITH spans AS (SELECT p_partkey, p_size AS lo, p_size + 3 AS hi FROM part)
SELECT s.p_partkey, count(*) AS n FROM spans s JOIN lineitem ON l_quantity >= lo AND l_quantity < hi GROUP BY 1""")
def interval(t: Tables) -> DataFrame:
    spans = t.part.select("p_partkey", F.col("p_size").alias("lo"), (F.col("p_size") + 3).alias("hi"))
    # quantities are counted before the join, which then meets one row for each quantity
    counted = t.lineitem.groupBy("l_quantity").agg(F.count(F.lit(1)).alias("c"))
    return joins.in_interval(counted, spans, "l_quantity", "lo", "hi", 5).groupBy("p_partkey").agg(F.sum("c").alias("n"))


@query("join_unique_key", """
SELECT c_acctbal_key AS key, min(c_custkey) AS c_custkey FROM (SELECT c_custkey, c_mktsegment || '/' || c_nationkey || '/' || floor(c_acctbal / 500)::INT AS c_acctbal_key FROM customer) GROUP BY 1 HAVING count(DISTINCT c_custkey) = 1""")
def unique_key(t: Tables) -> DataFrame:
    key = F.concat_ws("/", "c_mktsegment", F.col("c_nationkey").cast("string"), F.floor(F.col("c_acctbal") / 500).cast("string"))
    return joins.unique_keys(t.customer.select(key.alias("key"), "c_custkey"), "key", "c_custkey")


@query("join_reporting_lag", """
SELECT year(l_shipdate)::INT AS y, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND (year(o_orderdate) = year(l_shipdate) OR year(o_orderdate) = year(l_shipdate) - 1) GROUP BY 1""")
def reporting_lag(t: Tables) -> DataFrame:
    l = t.lineitem.select("l_orderkey", F.year("l_shipdate").alias("y"))
    l = l.withColumn("order_year", F.explode(F.array("y", F.col("y") - 1)))
    o = t.orders.select("o_orderkey", F.year("o_orderdate").alias("order_year"))
    return l.join(o, (F.col("l_orderkey") == F.col("o_orderkey")) & (l["order_year"] == o["order_year"])).groupBy("y").agg(F.count(F.lit(1)).alias("n"))


@query("join_correlated_scalar", """
SELECT p_partkey, p_retailprice, (SELECT count(*) FROM lineitem WHERE l_partkey = p_partkey) AS inbound FROM part WHERE p_size > 40""")
def correlated_scalar(t: Tables) -> DataFrame:
    inbound = t.lineitem.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("inbound"))
    return t.part.where("p_size > 40").join(inbound, F.col("p_partkey") == F.col("l_partkey"), "left").select("p_partkey", "p_retailprice", F.coalesce("inbound", F.lit(0)).alias("inbound"))


@query("join_union_of_sources", """
SELECT n_name, count(DISTINCT k) AS reachable FROM (SELECT c_nationkey AS nk, 'c' || c_custkey AS k FROM customer WHERE c_acctbal > 0 UNION SELECT s_nationkey, 's' || s_suppkey FROM supplier WHERE s_acctbal > 0) JOIN nation ON nk = n_nationkey GROUP BY 1""")
def union_of_sources(t: Tables) -> DataFrame:
    c = t.customer.where("c_acctbal > 0").select(F.col("c_nationkey").alias("nk"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("k"))
    s = t.supplier.where("s_acctbal > 0").select(F.col("s_nationkey").alias("nk"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("k"))
    return c.union(s).distinct().join(t.nation, F.col("nk") == F.col("n_nationkey")).groupBy("n_name").agg(F.count_distinct("k").alias("reachable"))


@query("join_hydrate_by_id", """
SELECT x.o_orderkey, c_name FROM (SELECT o_orderkey, o_custkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100) x LEFT JOIN customer ON o_custkey = c_custkey""")
def hydrate_by_id(t: Tables) -> DataFrame:
    page = t.orders.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100).select("o_orderkey", "o_custkey")
    return F.broadcast(page).join(t.customer, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", "c_name")  # 100 rows


# ---- aggregates

@query("agg_filter_counts", """
SELECT l_returnflag, count(*) AS n, count(*) FILTER (WHERE l_quantity > 25) AS big, count(*) FILTER (WHERE l_discount = 0) AS plain, round(sum(l_extendedprice * (1 - l_discount)), 1) AS revenue, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem GROUP BY 1""")
def filter_counts(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_quantity") > 25).alias("big"), F.count_if(F.col("l_discount") == 0).alias("plain"),
        F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 1).alias("revenue"), F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"),
    )


@query("agg_count_distinct_union", """
SELECT count(DISTINCT k) AS n FROM (SELECT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R' UNION SELECT p_partkey FROM part WHERE p_size = 1)""")
def count_distinct_union(t: Tables) -> DataFrame:
    both = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_partkey").alias("k")).union(t.part.where("p_size = 1").select("p_partkey"))
    return both.agg(F.count_distinct("k").alias("n"))


@query("agg_having", "SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) >= 40")
def having(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n")).where("n >= 40")


@query("agg_exact_quantiles", """
SELECT o_orderpriority, quantile_disc(o_totalprice, 0.5) AS p50, quantile_disc(o_totalprice, 0.95) AS p95, round(quantile_cont(o_totalprice, 0.9), 4) AS c90 FROM orders GROUP BY 1""")
def exact_quantiles(t: Tables) -> DataFrame:
    disc = lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY o_totalprice)")
    return t.orders.groupBy("o_orderpriority").agg(disc(0.5).alias("p50"), disc(0.95).alias("p95"), F.round(F.percentile("o_totalprice", 0.9), 4).alias("c90"))


@query("agg_distinct_array", """
SELECT o_custkey, list_sort(list(DISTINCT o_orderpriority)) AS priorities FROM orders GROUP BY 1""")
def distinct_array(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(F.array_sort(F.collect_set("o_orderpriority")).alias("priorities"))


@query("agg_ordered_string", """
SELECT n_regionkey, string_agg(n_name, ', ' ORDER BY n_name) AS names FROM nation GROUP BY 1""")
def ordered_string(t: Tables) -> DataFrame:
    return t.nation.groupBy("n_regionkey").agg(F.expr("listagg(n_name, ', ') WITHIN GROUP (ORDER BY n_name)").alias("names"))


@query("agg_json_objects", """
SELECT r_name, '[' || string_agg('{"key":' || n_nationkey || ',"name":"' || n_name || '"}', ',' ORDER BY n_nationkey) || ']' AS nations FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1""")
def json_objects(t: Tables) -> DataFrame:
    joined = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    items = F.array_sort(F.collect_list(F.struct(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"))))
    return joined.groupBy("r_name").agg(F.to_json(items).alias("nations"))


@query("agg_bool_or", "SELECT l_orderkey, bool_or(l_discount > 0.09) AS any_deep, bool_and(l_tax > 0) AS all_taxed FROM lineitem GROUP BY 1")
def bool_aggregates(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_orderkey").agg(F.bool_or(F.col("l_discount") > 0.09).alias("any_deep"), F.bool_and(F.col("l_tax") > 0).alias("all_taxed"))


@query("agg_exists_in_filter", """
SELECT o_orderpriority, count(*) AS n, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')) AS returned FROM orders GROUP BY 1""")
def exists_in_filter(t: Tables) -> DataFrame:
    returned = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("hit", F.lit(True))
    return t.orders.join(returned, "o_orderkey", "left").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("returned"))


@query("agg_stale_groups", """
SELECT o_custkey, max(o_orderdate) FILTER (WHERE o_orderstatus = 'F') AS last_good, count(*) FILTER (WHERE o_orderstatus <> 'F') AS failing FROM orders GROUP BY 1
HAVING max(o_orderdate) IS DISTINCT FROM max(o_orderdate) FILTER (WHERE o_orderstatus = 'F')""")
def stale_groups(t: Tables) -> DataFrame:
    good = F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")))
    out = t.orders.groupBy("o_custkey").agg(good.alias("last_good"), F.count_if(F.col("o_orderstatus") != "F").alias("failing"), F.max("o_orderdate").alias("last"))
    return out.where(~F.col("last").eqNullSafe(F.col("last_good"))).drop("last")


@query("agg_month_freshness", """
WITH m AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS mon, count(*) AS n FROM orders GROUP BY 1),
b AS (SELECT mon, n, avg(n) OVER w AS base, count(*) OVER w AS have FROM m WINDOW w AS (ORDER BY mon ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING))
SELECT mon, n, CASE WHEN have < 3 THEN 'UNDER_TEST' WHEN n < 0.1 * base THEN 'EFFECTIVELY_ABSENT' WHEN n < 0.6 * base THEN 'PARTIAL' ELSE 'CURRENT' END AS grade FROM b""")
def month_freshness(t: Tables) -> DataFrame:
    from florilege.operators.analytics import month_grades

    return month_grades(t.orders, "o_orderdate")


@query("agg_single_dimensions", """
SELECT CASE WHEN grouping(event_type) = 0 THEN 'type' WHEN grouping(d) = 0 THEN 'day' ELSE 'total' END AS dimension, coalesce(event_type, d::VARCHAR, 'all') AS member, count(*) AS n, round(sum(value), 2) AS total
FROM (SELECT event_type, CAST(ts AS DATE) AS d, value FROM events) GROUP BY GROUPING SETS ((event_type), (d), ())""")
def single_dimensions(t: Tables) -> DataFrame:
    from florilege.operators.analytics import by_each

    e = t.events.select("event_type", F.col("ts").cast("date").cast("string").alias("d"), "value")
    return by_each(e, {"type": "event_type", "day": "d"}, [F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total")])


@query("agg_fold_occurrences", "SELECT l_partkey, l_suppkey, count(*) AS occurrences, min(l_orderkey) AS first_at FROM lineitem GROUP BY 1, 2")
def fold_occurrences(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_partkey", "l_suppkey").agg(F.count(F.lit(1)).alias("occurrences"), F.min("l_orderkey").alias("first_at"))


@query("agg_safe_ratio", """
SELECT c_mktsegment, CASE WHEN count(*) FILTER (WHERE c_acctbal < -900) = 0 THEN NULL ELSE round(count(*) FILTER (WHERE c_acctbal < -950) / count(*) FILTER (WHERE c_acctbal < -900), 6) END AS ratio FROM customer GROUP BY 1""")
def safe_ratio(t: Tables) -> DataFrame:
    low = F.count_if(F.col("c_acctbal") < -900)
    return t.customer.groupBy("c_mktsegment").agg(F.round(F.try_divide(F.count_if(F.col("c_acctbal") < -950), low), 6).alias("ratio"))


@query("agg_worst_state", """
SELECT o_custkey, CASE max(CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END) WHEN 0 THEN 'F' WHEN 1 THEN 'O' ELSE 'P' END AS worst FROM orders GROUP BY 1""")
def worst_state(t: Tables) -> DataFrame:
    severity = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    return t.orders.groupBy("o_custkey").agg(F.max_by("o_orderstatus", severity).alias("worst"))


@query("agg_accounting_partition", """
SELECT count(*) AS total, count(*) FILTER (WHERE c_acctbal < 0) AS negative, count(*) FILTER (WHERE c_acctbal >= 0 AND c_acctbal < 5000) AS middle, count(*) FILTER (WHERE c_acctbal >= 5000) AS high, count(*) = count(*) FILTER (WHERE c_acctbal < 0) + count(*) FILTER (WHERE c_acctbal >= 0 AND c_acctbal < 5000) + count(*) FILTER (WHERE c_acctbal >= 5000) AS balanced FROM customer""")
def accounting_partition(t: Tables) -> DataFrame:
    b = F.col("c_acctbal")
    out = t.customer.agg(F.count(F.lit(1)).alias("total"), F.count_if(b < 0).alias("negative"), F.count_if((b >= 0) & (b < 5000)).alias("middle"), F.count_if(b >= 5000).alias("high"))
    return out.withColumn("balanced", F.expr("total = negative + middle + high"))


# ---- windows

@query("win_top_n_per_group", """
SELECT c_nationkey, c_custkey, c_acctbal, rn FROM (SELECT c_nationkey, c_custkey, c_acctbal, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rn FROM customer) WHERE rn <= 3""")
def top_n(t: Tables) -> DataFrame:
    slim = t.customer.select("c_nationkey", "c_custkey", "c_acctbal")
    return rows.top_n_per_group(slim, ["c_nationkey"], [F.desc("c_acctbal"), F.col("c_custkey")], 3)


@query("win_stratified_sample", """
SELECT o_orderkey, rn FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY CASE WHEN o_totalprice > 200000 THEN 'hi' ELSE 'lo' END, o_orderpriority, (year(o_orderdate) // 10) ORDER BY md5(o_orderkey::VARCHAR), o_orderkey) AS rn FROM orders) WHERE rn <= 5""")
def stratified_sample(t: Tables) -> DataFrame:
    strata = [F.when(F.col("o_totalprice") > 200000, "hi").otherwise("lo"), F.col("o_orderpriority"), F.floor(F.year("o_orderdate") / 10)]
    return rows.stratified_sample(t.orders, strata, "o_orderkey", 5).select("o_orderkey", "rn")


@query("win_rank_by_aggregate", """
SELECT n_regionkey, n_name, n, row_number() OVER (PARTITION BY n_regionkey ORDER BY n DESC, n_name) AS rn FROM (SELECT n_regionkey, n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)""")
def rank_by_aggregate(t: Tables) -> DataFrame:
    counted = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey", "n_name").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("rn", F.row_number().over(Window.partitionBy("n_regionkey").orderBy(F.desc("n"), "n_name")))


@query("win_partition_count", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders")
def partition_count(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", F.count(F.lit(1)).over(Window.partitionBy("o_custkey")).alias("n"))


@query("win_global_ordinal", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS ordinal FROM orders")
def global_ordinal(t: Tables) -> DataFrame:
    from florilege.operators.analytics import ordinal

    return ordinal(t.orders.select("o_orderkey"), "o_orderkey", "ordinal")


@query("win_first_per_group", """
SELECT DISTINCT ON (l_partkey) l_partkey, l_orderkey, l_returnflag FROM lineitem ORDER BY l_partkey, CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END, l_shipdate DESC, l_orderkey, l_linenumber""")
def first_per_group(t: Tables) -> DataFrame:
    severity = F.when(F.col("l_returnflag") == "R", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2)
    slim = t.lineitem.select("l_partkey", "l_orderkey", "l_returnflag", "l_shipdate", "l_linenumber")
    return rows.first_per_group(slim, ["l_partkey"], [severity, F.desc("l_shipdate"), F.col("l_orderkey"), F.col("l_linenumber")]).select("l_partkey", "l_orderkey", "l_returnflag")


@query("win_change_detection", """
SELECT user_id, event_id, event_type, previous FROM (SELECT *, lag(event_type) OVER w AS previous, row_number() OVER w AS rn FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE rn = 1 OR event_type IS DISTINCT FROM previous""")
def change_detection(t: Tables) -> DataFrame:
    return rows.changes(t.events, ["user_id"], ["ts", "event_id"], "event_type").select("user_id", "event_id", "event_type", "previous")


@query("win_run_length", """
WITH s AS (SELECT *, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM s)
SELECT user_id, run::BIGINT AS run, min(event_type) AS event_type, min(ts) AS run_start, max(ts) AS run_end, count(*) AS run_length FROM r GROUP BY 1, 2""")
def run_length(t: Tables) -> DataFrame:
    return rows.runs(t.events, ["user_id"], ["ts", "event_id"], "event_type")


@query("win_conflicts", """
SELECT user_id, CAST(ts AS DATE) AS day, count(DISTINCT event_type) AS n_values, list_sort(list(DISTINCT event_type)) AS "values" FROM events GROUP BY 1, 2 HAVING count(DISTINCT event_type) > 1""")
def conflicts(t: Tables) -> DataFrame:
    return rows.conflicts(t.events.withColumn("day", F.col("ts").cast("date")), ["user_id", "day"], "event_type")


# ---- order, limits, pages

@query("top_total_order_page", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 25 OFFSET 50")
def total_order_page(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", "o_orderdate").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).offset(50).limit(25)


@query("top_page_with_total", """
SELECT o_orderkey, total FROM (SELECT o_orderkey, o_totalprice, count(*) OVER () AS total FROM orders WHERE o_orderpriority = '1-URGENT') ORDER BY o_totalprice DESC, o_orderkey LIMIT 20""")
def page_with_total(t: Tables) -> DataFrame:
    fenced = t.orders.where("o_orderpriority = '1-URGENT'").select("o_orderkey", "o_totalprice")
    page = fenced.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)
    return page.join(F.broadcast(fenced.agg(F.count(F.lit(1)).alias("total")))).select("o_orderkey", "total")  # one row


@query("top_has_more", "SELECT count(*) AS shown, count(*) > 50 AS has_more FROM (SELECT 1 FROM lineitem WHERE l_quantity = 50 LIMIT 51)")
def has_more(t: Tables) -> DataFrame:
    probe = t.lineitem.where("l_quantity = 50").limit(51)
    return probe.agg(F.count(F.lit(1)).alias("shown")).withColumn("has_more", F.col("shown") > 50)


@query("top_case_priority", """
SELECT o_orderkey FROM orders ORDER BY CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_orderdate DESC, o_orderkey LIMIT 40""")
def case_priority(t: Tables) -> DataFrame:
    urgency = F.when(F.col("o_orderstatus") == "P", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    return t.orders.orderBy(urgency, F.desc("o_orderdate"), "o_orderkey").limit(40).select("o_orderkey")


@query("top_nulls_last", """
SELECT c_custkey, last FROM (SELECT c_custkey, max(o_orderdate) AS last FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P' GROUP BY 1) ORDER BY last DESC NULLS LAST, c_custkey LIMIT 200""")
def nulls_last(t: Tables) -> DataFrame:
    last = t.orders.where("o_orderstatus = 'P'").groupBy("o_custkey").agg(F.max("o_orderdate").alias("last"))
    joined = t.customer.join(last, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "last")
    return joined.orderBy(F.col("last").desc_nulls_last(), "c_custkey").limit(200)


@query("top_keyset_page", "SELECT event_id, ts FROM events WHERE (ts, event_id) > (TIMESTAMP '2024-01-10', 500) ORDER BY ts, event_id LIMIT 100")
def keyset_page(t: Tables) -> DataFrame:
    import datetime

    return rows.keyset_page(t.events.select("event_id", "ts"), ["ts", "event_id"], [datetime.datetime(2024, 1, 10), 500], 100)


@query("top_statutory_order", r"""
SELECT p_partkey, row_number() OVER (ORDER BY regexp_extract(p_brand, '(\d+)', 1)::INT, p_name, p_partkey) AS place FROM part""")
def statutory_order(t: Tables) -> DataFrame:
    """Places in the order of the number, then of the name: counted in ranges of (number, first letters of
    the name), then shifted by what stands in the ranges before."""
    number = F.regexp_extract("p_brand", r"(\d+)", 1).cast("int")
    few = t.part.select("p_partkey", number.alias("number"), "p_name", F.substring("p_name", 1, 2).alias("head"))
    before = Window.orderBy("number", "head").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    sizes = few.groupBy("number", "head").agg(F.count(F.lit(1)).alias("n"))
    shifts = sizes.select(F.col("number").alias("_n"), F.col("head").alias("_h"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    within = few.withColumn("rn", F.row_number().over(Window.partitionBy("number", "head").orderBy("p_name", "p_partkey")))
    joined = within.join(shifts, F.col("number").eqNullSafe(F.col("_n")) & F.col("head").eqNullSafe(F.col("_h")))
    return joined.select("p_partkey", (F.col("shift") + F.col("rn")).alias("place"))


@query("top_distinct_values", "SELECT DISTINCT o_orderpriority FROM orders")
def distinct_values(t: Tables) -> DataFrame:
    return t.orders.select("o_orderpriority").distinct()


# ---- set operations

@query("set_union_all_weighted", """
SELECT user_id, sum(w)::BIGINT AS weight, count(*) AS signals FROM (SELECT user_id, 1 AS w FROM events WHERE event_type = 'view' UNION ALL SELECT user_id, 2 FROM events WHERE event_type = 'click' UNION ALL SELECT user_id, 3 FROM events WHERE event_type = 'purchase') GROUP BY 1""")
def union_all_weighted(t: Tables) -> DataFrame:
    arms = [t.events.where(F.col("event_type") == kind).select("user_id", F.lit(w).alias("w")) for kind, w in (("view", 1), ("click", 2), ("purchase", 3))]
    return arms[0].unionByName(arms[1]).unionByName(arms[2]).groupBy("user_id").agg(F.sum("w").alias("weight"), F.count(F.lit(1)).alias("signals"))


@query("set_union_fallback", """
WITH a AS (SELECT l_partkey FROM lineitem WHERE l_quantity > 5000), b AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity = 50) SELECT l_partkey FROM a UNION ALL SELECT l_partkey FROM b WHERE NOT EXISTS (SELECT 1 FROM a)""")
def union_fallback(t: Tables) -> DataFrame:
    strict = t.lineitem.where("l_quantity > 5000").select("l_partkey")
    loose = t.lineitem.where("l_quantity = 50").select("l_partkey").distinct()
    empty = strict.agg((F.count(F.lit(1)) == 0).alias("none"))
    return strict.unionByName(loose.join(F.broadcast(empty), F.col("none"), "left_semi"))  # one row


@query("set_difference", "SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal < 5000")
def difference(t: Tables) -> DataFrame:
    return t.orders.select("o_custkey").distinct().join(t.customer.where("c_acctbal < 5000"), F.col("o_custkey") == F.col("c_custkey"), "left_anti")


@query("set_intersection", "SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A'")
def intersection(t: Tables) -> DataFrame:
    part = lambda flag: t.lineitem.where(F.col("l_returnflag") == flag).select("l_partkey")
    return part("R").intersect(part("A"))
