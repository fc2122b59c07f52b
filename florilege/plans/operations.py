"""Sources and sinks, incremental maintenance in batch form, operational analytics and ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from florilege.operators import analytics, joins, rows
from florilege.plans.catalog import Tables, query
from florilege.sources import tables as files

STEPS = ["view", "signup", "click", "purchase"]
AS_OF = "2024-01-31"


# ---- sources and sinks

@query("source_column_tally", "SELECT trim(o_orderpriority) AS priority, count(*) AS n FROM orders GROUP BY 1")
def column_tally(t: Tables) -> DataFrame:
    return t.orders.groupBy(F.trim("o_orderpriority").alias("priority")).agg(F.count(F.lit(1)).alias("n"))


@query("source_row_count", "SELECT count(*) AS n FROM lineitem")
def row_count(t: Tables) -> DataFrame:
    return t.lineitem.agg(F.count(F.lit(1)).alias("n"))


@query("source_hash_sample", "SELECT o_orderkey FROM orders ORDER BY md5(o_orderkey::VARCHAR), o_orderkey LIMIT 100")
def hash_sample(t: Tables) -> DataFrame:
    return rows.hash_sample(t.orders, "o_orderkey", 100).select("o_orderkey")


@query("source_random_points", """
WITH p AS (SELECT unnest(range(1, 20)) * 701 AS point) SELECT point, (SELECT min(o_orderkey) FROM orders WHERE o_orderkey > point) AS o_orderkey FROM p""")
def random_points(t: Tables) -> DataFrame:
    """Each point with the next id above it: ids are ranged by the points, one aggregate."""
    points = [i * 701 for i in range(1, 20)]
    above = F.aggregate(F.array(*[F.lit(p) for p in points]), F.lit(0), lambda s, p: s + (F.col("o_orderkey") > p).cast("int"))
    least = t.orders.groupBy(above.alias("k")).agg(F.min("o_orderkey").alias("m"))
    named = t.spark.createDataFrame([(i + 1, p) for i, p in enumerate(points)], "k int, point int")
    later = named.join(F.broadcast(least.select(F.col("k").alias("at"), "m")), F.col("at") >= F.col("k"), "left")  # at most 20 rows
    return later.groupBy("point").agg(F.min("m").alias("o_orderkey")).select(F.col("point").cast("long").alias("point"), "o_orderkey")


@query("source_keyset_by_id", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 4000 ORDER BY o_orderkey LIMIT 200")
def keyset_by_id(t: Tables) -> DataFrame:
    return rows.keyset_page(t.orders.select("o_orderkey", "o_totalprice"), ["o_orderkey"], [4000], 200)


@query("source_split_rows", "SELECT count(*) AS rows, min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders")
def split_rows(t: Tables) -> DataFrame:
    """Input splits put together again: every row belongs to one file range."""
    located = files.with_location(t.orders.select("o_orderkey", "_metadata"))
    per = located.groupBy("file", "block_start").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("lo"), F.max("o_orderkey").alias("hi"))
    return per.agg(F.sum("n").alias("rows"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


@query("sink_merge", """
WITH n AS (SELECT c_custkey + 100 AS c_custkey, c_acctbal + 1 AS c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 3 = 0)
SELECT coalesce(c.c_custkey, n.c_custkey) AS c_custkey, coalesce(c.c_mktsegment, n.c_mktsegment) AS c_mktsegment, coalesce(n.c_acctbal, c.c_acctbal) AS c_acctbal, CASE WHEN c.c_custkey IS NULL THEN 'inserted' WHEN n.c_custkey IS NULL THEN 'kept' ELSE 'updated' END AS change FROM customer c FULL JOIN n ON c.c_custkey = n.c_custkey""")
def merge(t: Tables) -> DataFrame:
    new = t.customer.where("c_custkey % 3 = 0").select((F.col("c_custkey") + 100).alias("c_custkey"), (F.col("c_acctbal") + 1).alias("c_acctbal"), "c_mktsegment")
    return joins.merge_rows(t.customer, new, "c_custkey", ["c_mktsegment"], ["c_acctbal"])


@query("sink_insert_ignore", """
SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R' AND (l_partkey, l_suppkey) NOT IN (SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'A')""")
def insert_ignore(t: Tables) -> DataFrame:
    key = ["l_partkey", "l_suppkey"]
    part = lambda flag: t.lineitem.where(F.col("l_returnflag") == flag).select(*key)
    return files.new_rows(part("R"), part("A"), key)


@query("sink_first_writer_wins", "SELECT user_id, event_type, min(event_id) AS winner FROM events GROUP BY 1, 2")
def first_writer(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id", "event_type").agg(F.min_by("event_id", F.struct("event_id")).alias("winner"))


@query("sink_failure_ledger", """
SELECT user_id, count(*) AS attempts, arg_max(event_type, event_id) AS last_reason, count(*) >= 3 OR bool_or(event_type = 'purchase') AS permanent FROM events WHERE event_type IN ('error', 'purchase') GROUP BY 1""")
def failure_ledger(t: Tables) -> DataFrame:
    failures = t.events.where("event_type IN ('error', 'purchase')").withColumn("at", F.col("event_id"))
    return files.failure_ledger(failures, "user_id", "event_type", ("purchase",))


@query("sink_table_checksum", r"""
SELECT count(*) AS rows, bit_xor(('0x' || substr(md5(coalesce(o_orderkey::VARCHAR, chr(30)) || chr(31) || coalesce(o_orderstatus, chr(30)) || chr(31) || coalesce(o_orderpriority, chr(30))), 1, 15))::BIGINT) AS checksum FROM orders""")
def table_checksum(t: Tables) -> DataFrame:
    return files.checksum(t.orders, ["o_orderkey", "o_orderstatus", "o_orderpriority"])


@query("sink_export_datasets", """
SELECT dataset, split, count(*) AS n FROM (SELECT 'documents' AS dataset, doc_id AS id FROM documents UNION ALL SELECT 'pages', page_id FROM pages UNION ALL SELECT 'conversations', conv_id FROM conversations WHERE turn = 0),
LATERAL (SELECT CASE WHEN ('0x' || substr(sha256(id::VARCHAR), 1, 8))::BIGINT % 10 = 0 THEN 'eval' ELSE 'train' END AS split) GROUP BY 1, 2""")
def export_datasets(t: Tables) -> DataFrame:
    arms = [t.documents.select(F.lit("documents").alias("dataset"), F.col("doc_id").alias("id")), t.pages.select(F.lit("pages"), "page_id"), t.conversations.where("turn = 0").select(F.lit("conversations"), "conv_id")]
    bucket = F.conv(F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 8), 16, 10).cast("long") % 10
    union = arms[0].union(arms[1]).union(arms[2])
    return union.groupBy("dataset", F.when(bucket == 0, "eval").otherwise("train").alias("split")).agg(F.count(F.lit(1)).alias("n"))


# ---- incremental maintenance, in batch form

@query("incr_frontier_batch", """
SELECT event_id, user_id FROM events WHERE (ts > TIMESTAMP '2024-01-05' OR (ts = TIMESTAMP '2024-01-05' AND event_id > 0)) AND ts < TIMESTAMP '2024-01-12'""")
def frontier(t: Tables) -> DataFrame:
    import datetime

    return rows.after_key(t.events, ["ts", "event_id"], [datetime.datetime(2024, 1, 5), 0]).where("ts < timestamp_ntz'2024-01-12'").select("event_id", "user_id")


@query("incr_late_rows", """
WITH w AS (SELECT event_id, ts, max(ts) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM events) SELECT count(*) FILTER (WHERE ts < seen - INTERVAL 10 DAY) AS late, count(*) AS total FROM w""")
def late_rows(t: Tables) -> DataFrame:
    """Arrival order is the id; the watermark before a row is the maximum over all earlier ids."""
    seen = rows.maximum_before(t.events.select("event_id", "ts"), "event_id", "ts", "seen")
    return seen.agg(F.count_if(F.col("ts") < F.col("seen") - F.expr("INTERVAL 10 DAYS")).alias("late"), F.count(F.lit(1)).alias("total"))


@query("incr_change_capture", """
WITH o AS (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'P'), n AS (SELECT o_custkey + 1 AS k FROM orders WHERE o_orderstatus = 'P') SELECT k, count(*) AS touched FROM (SELECT k FROM o UNION ALL SELECT k FROM n) GROUP BY 1""")
def change_capture(t: Tables) -> DataFrame:
    """Keys to rebuild after an update: the old and the new ones."""
    pending = t.orders.where("o_orderstatus = 'P'")
    keys = pending.select(F.explode(F.array(F.col("o_custkey"), F.col("o_custkey") + 1)).alias("k"))
    return keys.groupBy("k").agg(F.count(F.lit(1)).alias("touched"))


@query("incr_freshness", f"""
SELECT event_type, date_diff('hour', max(ts), TIMESTAMP '{AS_OF}') AS lag_hours, CASE WHEN max(ts) IS NULL THEN 'UNKNOWN' WHEN date_diff('hour', max(ts), TIMESTAMP '{AS_OF}') > 48 THEN 'STALE' ELSE 'CURRENT' END AS state FROM events GROUP BY 1""")
def freshness(t: Tables) -> DataFrame:
    last = t.events.groupBy("event_type").agg(F.max("ts").alias("m"))
    hours = F.expr(f"timestampdiff(HOUR, date_trunc('hour', m), timestamp_ntz'{AS_OF}')")
    return last.select("event_type", hours.alias("lag_hours")).withColumn("state", F.when(F.col("lag_hours").isNull(), "UNKNOWN").when(F.col("lag_hours") > 48, "STALE").otherwise("CURRENT"))


@query("incr_collision_guard", "SELECT DISTINCT n.l_partkey FROM (SELECT DISTINCT l_partkey FROM lineitem WHERE l_orderkey > 12000) n JOIN (SELECT DISTINCT l_partkey FROM lineitem WHERE l_orderkey <= 12000) o USING (l_partkey)")
def collision_guard(t: Tables) -> DataFrame:
    key = t.lineitem.select("l_partkey", "l_orderkey")
    return key.where("l_orderkey > 12000").select("l_partkey").distinct().join(key.where("l_orderkey <= 12000"), "l_partkey", "left_semi")


@query("incr_tumbling_window", """
SELECT time_bucket(INTERVAL 15 MINUTE, ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2""")
def tumbling(t: Tables) -> DataFrame:
    e = t.events.withColumn("ts", F.col("ts").cast("timestamp"))
    out = e.groupBy(F.window("ts", "15 minutes"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


@query("incr_threshold_alerts", """
WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS errors FROM events GROUP BY 1)
SELECT day, n, errors, CASE WHEN n < 20 THEN CASE WHEN errors >= 5 THEN 'page' ELSE 'ok' END WHEN errors > 0.25 * n THEN 'page' WHEN errors > 0.2 * n THEN 'watch' ELSE 'ok' END AS alert FROM d""")
def threshold_alerts(t: Tables) -> DataFrame:
    d = t.events.groupBy(F.col("ts").cast("date").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"))
    n, errors = F.col("n"), F.col("errors")
    alert = F.when(n < 20, F.when(errors >= 5, "page").otherwise("ok")).when(errors > 0.25 * n, "page").when(errors > 0.2 * n, "watch").otherwise("ok")
    return d.withColumn("alert", alert)


@query("incr_observation_projection", """
SELECT user_id, event_id, CASE WHEN previous IS NULL THEN 'LISTED' WHEN event_type = 'purchase' THEN 'DISPOSED' WHEN event_type <> previous THEN 'CHANGED' ELSE 'CONFIRMED' END AS projection FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events)""")
def observation_projection(t: Tables) -> DataFrame:
    previous = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    state = F.when(F.col("previous").isNull(), "LISTED").when(F.col("event_type") == "purchase", "DISPOSED").when(F.col("event_type") != F.col("previous"), "CHANGED").otherwise("CONFIRMED")
    return t.events.withColumn("previous", previous).select("user_id", "event_id", state.alias("projection"))


@query("incr_latest_state", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS state, max(ts) AS at FROM events GROUP BY 1")
def latest_state(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state"), F.max("ts").alias("at"))


@query("incr_idempotent_fanout", "SELECT sha256(user_id || ':' || event_type) AS key, count(*) AS attempts, min(event_id) AS kept FROM events GROUP BY 1")
def idempotent_fanout(t: Tables) -> DataFrame:
    key = F.sha2(F.concat_ws(":", F.col("user_id").cast("string"), "event_type"), 256)
    return t.events.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("attempts"), F.min("event_id").alias("kept"))


@query("incr_coverage_watermark", """
SELECT d.source, count(*) AS docs, count(*) FILTER (WHERE d.doc_id < r.upto) AS covered FROM documents d LEFT JOIN (SELECT source, max(doc_id) - 50 AS upto FROM documents WHERE lang = 'en' GROUP BY 1) r ON d.source = r.source GROUP BY 1""")
def coverage_watermark(t: Tables) -> DataFrame:
    runs = t.documents.where("lang = 'en'").groupBy("source").agg((F.max("doc_id") - 50).alias("upto"))
    joined = t.documents.join(runs, "source", "left")
    return joined.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.count_if(F.coalesce(F.col("doc_id") < F.col("upto"), F.lit(False))).alias("covered"))


@query("incr_rate_limit", """
WITH RECURSIVE s AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
walk AS (SELECT event_id, user_id, rn, ts AS last, NULL::TIMESTAMP AS before, false AS refused FROM s WHERE rn = 1
  UNION ALL SELECT s.event_id, s.user_id, s.rn, CASE WHEN coalesce(w.before > s.ts - INTERVAL 6 HOUR, false) THEN w.last ELSE s.ts END,
    CASE WHEN coalesce(w.before > s.ts - INTERVAL 6 HOUR, false) THEN w.before ELSE w.last END, coalesce(w.before > s.ts - INTERVAL 6 HOUR, false)
  FROM walk w JOIN s ON s.user_id = w.user_id AND s.rn = w.rn + 1)
SELECT event_id, refused FROM walk""")
def rate_limit(t: Tables) -> DataFrame:
    """Two events of a user in six hours; refused ones do not count."""
    return rows.rate_limited(t.events.where("user_id IS NOT NULL AND ts IS NOT NULL"), "user_id", "ts", "event_id", 2, 6 * 3600).select("event_id", "refused")


@query("incr_first_step", "SELECT DISTINCT user_id, event_type AS step FROM events WHERE event_type IN ('signup', 'purchase')")
def first_step(t: Tables) -> DataFrame:
    return t.events.where("event_type IN ('signup', 'purchase')").select("user_id", F.col("event_type").alias("step")).distinct()


# ---- operational analytics

@query("ops_funnel", """
WITH s AS (SELECT * FROM (VALUES (0, 'view'), (1, 'signup'), (2, 'click'), (3, 'purchase')) v(place, step)), c AS (SELECT event_type, count(DISTINCT user_id) AS u FROM events GROUP BY 1), j AS (SELECT place, step, coalesce(u, 0) AS users FROM s LEFT JOIN c ON step = event_type)
SELECT step, users, users / nullif(first_value(users) OVER (ORDER BY place), 0) AS of_first, users / nullif(lag(users) OVER (ORDER BY place), 0) AS of_previous, place FROM j""")
def funnel(t: Tables) -> DataFrame:
    return analytics.funnel(t.events, "user_id", "event_type", STEPS)


@query("ops_experiment_readout", """
WITH a AS (SELECT DISTINCT user_id, (('0x' || substr(sha256('layout:' || user_id), 1, 8))::BIGINT % 3)::INT AS variant FROM events WHERE event_type = 'view'), c AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase')
SELECT variant, count(*) AS exposed, count(c.user_id) AS converted, CASE WHEN count(*) >= 100 THEN round(count(c.user_id) / count(*), 6) END AS rate FROM a LEFT JOIN c USING (user_id) GROUP BY 1""")
def experiment_readout(t: Tables) -> DataFrame:
    seen = t.events.where("event_type = 'view'").select("user_id", analytics.variant("layout", F.col("user_id"), 3).alias("variant"))
    return analytics.readout(seen, t.events.where("event_type = 'purchase'"), "user_id", "variant")


@query("ops_ledger_balance", """
SELECT o_custkey, round(sum(CASE WHEN o_orderstatus = 'F' THEN -o_totalprice ELSE o_totalprice END), 2) AS balance FROM orders GROUP BY 1 HAVING round(sum(CASE WHEN o_orderstatus = 'F' THEN -o_totalprice ELSE o_totalprice END), 2) <> 0""")
def ledger_balance(t: Tables) -> DataFrame:
    delta = F.when(F.col("o_orderstatus") == "F", -F.col("o_totalprice")).otherwise(F.col("o_totalprice"))
    return t.orders.groupBy("o_custkey").agg(F.round(F.sum(delta), 2).alias("balance")).where("balance <> 0")


@query("ops_held_capabilities", """
SELECT c_custkey, capability, min(priority) AS source FROM (SELECT o_custkey AS c_custkey, o_orderpriority AS capability, 0 AS priority FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT o_custkey, o_orderpriority, 1 FROM orders WHERE o_totalprice > 250000) GROUP BY 1, 2""")
def held_capabilities(t: Tables) -> DataFrame:
    pick = lambda cond, p: t.orders.where(cond).select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("capability"), F.lit(p).alias("priority"))
    return pick("o_orderstatus = 'O'", 0).unionByName(pick("o_totalprice > 250000", 1)).groupBy("c_custkey", "capability").agg(F.min("priority").alias("source"))


@query("ops_false_rate", """
SELECT (SELECT count(*) FROM labels WHERE quality = 1 AND toxic = 1) AS wrong, (SELECT count(*) FROM labels WHERE quality = 1) AS verified, CASE WHEN (SELECT count(*) FROM labels WHERE quality = 1) = 0 THEN NULL ELSE round((SELECT count(*) FROM labels WHERE quality = 1 AND toxic = 1) / (SELECT count(*) FROM labels WHERE quality = 1), 6) END AS rate""")
def false_rate(t: Tables) -> DataFrame:
    out = t.labels.agg(F.count_if((F.col("quality") == 1) & (F.col("toxic") == 1)).alias("wrong"), F.count_if(F.col("quality") == 1).alias("verified"))
    return out.withColumn("rate", F.round(F.try_divide("wrong", "verified"), 6))


@query("ops_monitor", """
SELECT CASE WHEN grouping(l_returnflag) = 0 THEN 'state' WHEN grouping(l_linestatus) = 0 THEN 'live' ELSE 'total' END AS dimension, coalesce(l_returnflag, l_linestatus, 'all') AS member, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())""")
def monitor(t: Tables) -> DataFrame:
    return analytics.by_each(t.lineitem.select("l_returnflag", "l_linestatus"), {"state": "l_returnflag", "live": "l_linestatus"}, [F.count(F.lit(1)).alias("n")])


@query("ops_audit_listing", """
SELECT event_id, user_id, event_type FROM events WHERE event_type IN ('error', 'purchase') AND value > 50 AND ts >= TIMESTAMP '2024-01-03' AND event_id < 9000 ORDER BY event_id DESC LIMIT 50""")
def audit_listing(t: Tables) -> DataFrame:
    df = t.events.where(F.col("event_type").isin("error", "purchase")).where("value > 50").where("ts >= timestamp_ntz'2024-01-03'").where("event_id < 9000")
    return df.orderBy(F.desc("event_id")).limit(50).select("event_id", "user_id", "event_type")


@query("ops_drift_check", """
WITH s AS (SELECT l_orderkey, count(*) AS n, round(sum(l_quantity), 2) AS q FROM lineitem WHERE l_shipdate < TIMESTAMP '1997-01-01' GROUP BY 1), c AS (SELECT l_orderkey, count(*) AS n, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY 1)
SELECT l_orderkey, s.n AS sealed, c.n AS current FROM c LEFT JOIN s USING (l_orderkey) WHERE s.n IS DISTINCT FROM c.n OR s.q IS DISTINCT FROM c.q""")
def drift_check(t: Tables) -> DataFrame:
    facts = lambda df: df.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("q"))
    sealed = facts(t.lineitem.where("l_shipdate < timestamp_ntz'1997-01-01'")).toDF("l_orderkey", "sn", "sq")
    j = facts(t.lineitem).join(sealed, "l_orderkey", "left")
    return j.where(~F.col("n").eqNullSafe(F.col("sn")) | ~F.col("q").eqNullSafe(F.col("sq"))).select("l_orderkey", F.col("sn").alias("sealed"), F.col("n").alias("current"))


@query("ops_experiment_buckets", """
SELECT bucket, count(*) AS n FROM (SELECT (('0x' || substr(sha256('price:' || c_custkey), 1, 8))::BIGINT % 5)::INT AS bucket FROM customer) GROUP BY 1""")
def experiment_buckets(t: Tables) -> DataFrame:
    return t.customer.groupBy(analytics.variant("price", F.col("c_custkey"), 5).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("ops_request_fingerprint", """
SELECT event_id, sha256('{"event_type":"' || event_type || '","k":' || json_extract_string(props, '$.k') || ',"user_id":' || user_id || '}') AS fingerprint FROM events""")
def request_fingerprint(t: Tables) -> DataFrame:
    canonical = F.to_json(F.struct("event_type", F.get_json_object("props", "$.k").cast("long").alias("k"), "user_id"))
    return t.events.select("event_id", F.sha2(canonical, 256).alias("fingerprint"))


@query("ops_access_derivation", """
SELECT o_orderkey, CASE WHEN o_custkey = 7 THEN 'owner' WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_suppkey = 7) THEN 'shared' ELSE 'none' END AS access FROM orders""")
def access_derivation(t: Tables) -> DataFrame:
    shared = t.lineitem.where("l_suppkey = 7").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("s", F.lit(True))
    access = F.when(F.col("o_custkey") == 7, "owner").when(F.col("s"), "shared").otherwise("none")
    return t.orders.join(shared, "o_orderkey", "left").select("o_orderkey", access.alias("access"))


@query("ops_unavailable_split", """
SELECT CASE WHEN p_partkey IS NULL THEN 'unavailable' ELSE 'held' END AS state, count(*) AS n FROM lineitem LEFT JOIN (SELECT p_partkey FROM part WHERE p_size > 10) ON l_partkey = p_partkey GROUP BY 1""")
def unavailable_split(t: Tables) -> DataFrame:
    held = t.part.where("p_size > 10").select("p_partkey")
    state = F.when(F.col("p_partkey").isNull(), "unavailable").otherwise("held")
    return t.lineitem.join(held, F.col("l_partkey") == F.col("p_partkey"), "left").groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


@query("ops_json_reasons", """
SELECT event_type, json_extract_string(props, '$.k')::BIGINT % 5 AS reason, count(*) AS n FROM events WHERE props IS NOT NULL GROUP BY 1, 2""")
def json_reasons(t: Tables) -> DataFrame:
    k = F.from_json("props", "k long")["k"]
    return t.events.where("props IS NOT NULL").groupBy("event_type", (k % 5).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("ops_claims_with_ordinality", """
SELECT doc_id, ordinal, claim FROM (SELECT doc_id, generate_subscripts(a, 1) AS ordinal, trim(unnest(a)) AS claim FROM (SELECT doc_id, string_split(text, '.') AS a FROM documents)) WHERE length(claim) >= 80""")
def claims(t: Tables) -> DataFrame:
    each = t.documents.select("doc_id", F.posexplode(F.split("text", r"\.")).alias("p", "c"))
    return each.select("doc_id", (F.col("p") + 1).cast("long").alias("ordinal"), F.trim("c").alias("claim")).where(F.length("claim") >= 80)


@query("ops_briefing", """
WITH last AS (SELECT o_custkey, max(o_orderdate) AS last_order, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last_key FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), pending AS (SELECT o_custkey, count(*) AS pending FROM orders o WHERE o_orderstatus = 'O' GROUP BY 1)
SELECT c_custkey, last_order, last_key, coalesce(pending, 0) AS pending FROM customer LEFT JOIN last ON c_custkey = last.o_custkey LEFT JOIN pending ON c_custkey = pending.o_custkey WHERE c_mktsegment = 'BUILDING'""")
def briefing(t: Tables) -> DataFrame:
    by = t.orders.groupBy("o_custkey").agg(
        F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate"))).alias("last_order"),
        F.max_by(F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey")), F.when(F.col("o_orderstatus") == "F", F.struct("o_orderdate", "o_orderkey"))).alias("last_key"),
        F.count_if(F.col("o_orderstatus") == "O").alias("pending"),
    )
    held = t.customer.where("c_mktsegment = 'BUILDING'").join(by, F.col("c_custkey") == F.col("o_custkey"), "left")
    return held.select("c_custkey", "last_order", "last_key", F.coalesce("pending", F.lit(0)).alias("pending"))


@query("ops_coverage_cells", """
WITH d AS (SELECT source, year, n FROM (SELECT source, (2000 + doc_id % 5)::INT AS year, count(*) AS n FROM documents GROUP BY 1, 2)), e AS (SELECT source, (2000 + doc_id % 7)::INT AS year, count(*) AS e FROM documents WHERE lang = 'en' GROUP BY 1, 2)
SELECT coalesce(d.source, e.source) AS source, coalesce(d.year, e.year) AS year, coalesce(n, 0) AS held, e AS estimate, CASE WHEN n IS NULL THEN 'missing' WHEN e IS NULL THEN 'orphan' WHEN n < e THEN 'short' ELSE 'covered' END AS state FROM d FULL JOIN e ON d.source = e.source AND d.year = e.year""")
def coverage_cells(t: Tables) -> DataFrame:
    cell = lambda df, mod, name: df.groupBy("source", (2000 + F.col("doc_id") % mod).cast("int").alias("year")).agg(F.count(F.lit(1)).alias(name))
    j = cell(t.documents, 5, "n").join(cell(t.documents.where("lang = 'en'"), 7, "estimate"), ["source", "year"], "full_outer")
    state = F.when(F.col("n").isNull(), "missing").when(F.col("estimate").isNull(), "orphan").when(F.col("n") < F.col("estimate"), "short").otherwise("covered")
    return j.select("source", "year", F.coalesce("n", F.lit(0)).alias("held"), "estimate", state.alias("state"))
