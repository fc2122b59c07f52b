"""Identity under several keys, resolver rates, links behind a gate, samples, gates and event times."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from florilege.functions.text import lookup_key, lookup_keys, tokens
from florilege.operators import resolution, rows
from florilege.plans.catalog import Tables, query
from florilege.plans.graph import reference_resolution

KEY = "upper(regexp_replace({}, '[^A-Za-z0-9]', '', 'g'))"


@query("search_identity_keys", f"""
WITH k AS (SELECT p_partkey, {KEY.format("p_brand || '/' || p_size")} AS key, 0 AS tier FROM part UNION ALL SELECT p_partkey, {KEY.format("p_brand || '-' || p_type")}, 1 FROM part
  UNION ALL SELECT p_partkey, {KEY.format("p_type")}, 1 FROM part UNION ALL SELECT p_partkey, {KEY.format("p_name")}, 2 FROM part),
a AS (SELECT DISTINCT unnest([{KEY.format("'Brand#' || (o_custkey % 60) || '/' || (o_orderkey % 55)")}, {KEY.format("'Brand ' || (o_custkey % 60) || ' PROMO'")}, {KEY.format("'part ' || o_custkey")}]) AS asked FROM orders)
SELECT asked, p_partkey, CASE min(tier) WHEN 0 THEN 'neutral' WHEN 1 THEN 'reporter' ELSE 'alias' END AS "by" FROM k JOIN a ON key = asked WHERE key <> '' GROUP BY 1, 2""")
def identity_keys(t: Tables) -> DataFrame:
    text = lambda *parts: F.concat(*[p.cast("string") for p in parts])
    brand, customer = F.lit("Brand#"), F.col("o_custkey")
    asked = F.array(text(brand, customer % 60, F.lit("/"), F.col("o_orderkey") % 55), text(F.lit("Brand "), customer % 60, F.lit(" PROMO")), text(F.lit("part "), customer))
    tiers = [
        ("neutral", F.array(lookup_key(text(F.col("p_brand"), F.lit("/"), F.col("p_size"))))),
        ("reporter", lookup_keys(F.array(text(F.col("p_brand"), F.lit("-"), F.col("p_type")), F.col("p_type")))),
        ("alias", lookup_keys(F.array("p_name"))),
    ]
    return resolution.match_identity(t.orders.select(F.explode(lookup_keys(asked)).alias("asked")), "asked", t.part, "p_partkey", tiers)


@query("graph_collision_split", """
WITH c AS (SELECT l_partkey, l_suppkey % 3 AS key, l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R')
SELECT l_orderkey, l_linenumber, l_partkey, key, n > 1 AS collided FROM c JOIN (SELECT l_partkey, count(DISTINCT key) AS n FROM c GROUP BY 1) USING (l_partkey)""")
def collision_split(t: Tables) -> DataFrame:
    claims = t.lineitem.where("l_returnflag = 'R'").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_suppkey") % 3).alias("key"))
    return resolution.split_collisions(claims, "l_partkey", "key")


@query("graph_resolver_rates", """
WITH k AS (SELECT p_brand || '/' || p_size AS key, count(DISTINCT p_partkey) AS n, min(p_partkey) AS target FROM part GROUP BY 1),
r AS (SELECT l_partkey, 'Brand#' || (l_partkey % 60) || '/' || (l_suppkey % 55) AS key FROM lineitem),
v AS (SELECT CASE WHEN l_partkey % 97 = 0 THEN 'REFUSED' WHEN n IS NULL THEN 'TARGET_NOT_HELD' WHEN n > 1 THEN 'AMBIGUOUS' WHEN target = l_partkey THEN 'SELF_REFERENCE' ELSE 'UNIQUE' END AS s FROM r LEFT JOIN k USING (key)),
c AS (SELECT count(*) AS n, count(*) FILTER (WHERE s = 'REFUSED') AS refused, count(*) FILTER (WHERE s = 'UNIQUE') AS found, count(*) FILTER (WHERE s = 'AMBIGUOUS') AS ambiguous, count(*) FILTER (WHERE s = 'TARGET_NOT_HELD') AS not_held, count(*) FILTER (WHERE s = 'SELF_REFERENCE') AS self_reference FROM v)
SELECT *, n - refused AS formed, (found + ambiguous) / (n - refused) AS hit_rate, found / (n - refused) AS found_rate, ambiguous / (n - refused) AS ambiguous_rate, not_held / (n - refused) AS not_held_rate FROM c""")
def resolver_rates(t: Tables) -> DataFrame:
    return resolution.resolver_rates(reference_resolution(t), "verdict")


@query("graph_new_edges", """
WITH e AS (SELECT DISTINCT l_orderkey AS src, l_partkey AS dst, l_shipdate >= TIMESTAMP '1997-01-01' AS fresh FROM lineitem)
SELECT src, dst FROM e GROUP BY 1, 2 HAVING bool_and(fresh)""")
def new_edges(t: Tables) -> DataFrame:
    """A rescan of the changed lines: only edges that the graph does not hold yet are written."""
    edges = t.lineitem.select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), "l_shipdate")
    day = "timestamp_ntz'1997-01-01'"
    held = edges.where(f"l_shipdate < {day}").select("src", "dst")
    return edges.where(f"l_shipdate >= {day}").select("src", "dst").distinct().join(held, ["src", "dst"], "left_anti")


@query("retrieve_linked_documents", """
WITH e AS (SELECT l_partkey, l_orderkey, min(CASE WHEN l_quantity >= 40 THEN 0 WHEN l_quantity >= 20 THEN 1 ELSE 2 END) AS tier, bool_and(o_orderstatus <> 'P') AS ok FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)
SELECT l_partkey, tier, count(*) FILTER (WHERE ok) AS shown, count(*) FILTER (WHERE NOT ok) AS withheld FROM e GROUP BY 1, 2""")
def linked_documents(t: Tables) -> DataFrame:
    quantity = F.col("l_quantity")
    tier = F.when(quantity >= 40, 0).when(quantity >= 20, 1).otherwise(2)
    # join and links of a document stay in one task, which holds all of its links
    cited = rows.dealt(t.lineitem.select("l_orderkey", "l_partkey", tier.alias("strength")), ["l_orderkey"], t.lineitem.count())
    links = cited.join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus"), "l_orderkey")
    return resolution.linked(links, "l_partkey", "l_orderkey", "strength", F.col("o_orderstatus") != "P")


WORDS = "regexp_extract_all(lower(s), '[a-z0-9]+')"


@query("retrieve_section_search", f"""
WITH x AS (SELECT page_id, generate_subscripts(a, 1) AS ordinal, unnest(a) AS s FROM (SELECT page_id, regexp_extract_all(html, '<p>([^<]*)', 1) AS a FROM pages)),
h AS (SELECT page_id, ordinal, len(list_filter({WORDS}, lambda w: w IN ('the', 'of'))) AS score FROM x WHERE list_contains({WORDS}, 'the') AND list_contains({WORDS}, 'of'))
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, ordinal) AS rn FROM h) WHERE rn <= 3""")
def section_search(t: Tables) -> DataFrame:
    """The three best sections of a page that hold all terms."""
    each = t.pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit("<p>([^<]*)"), F.lit(1))).alias("i", "s"))
    found = each.select("page_id", (F.col("i") + 1).cast("long").alias("ordinal"), tokens(F.col("s")).alias("w")).where(F.array_contains("w", "the") & F.array_contains("w", "of"))
    scored = found.select("page_id", "ordinal", F.size(F.filter("w", lambda w: w.isin("the", "of"))).cast("long").alias("score"))
    return rows.top_n_per_group(scored, ["page_id"], [F.desc("score"), F.col("ordinal")], 3)


@query("retrieve_passage_fill", r"""
SELECT source, lang, row_number() OVER (PARTITION BY source, lang ORDER BY n_chars, doc_id) AS ordinal, doc_id, coalesce(nullif(regexp_extract(text, '[^.\n]*thorre[^.\n]*'), ''), substr(text, 1, 80)) AS passage FROM documents QUALIFY ordinal <= 20""")
def passage_fill(t: Tables) -> DataFrame:
    """The first twenty candidates of a group keep their places; those without a passage that matched show
    how they begin."""
    sentences = F.split(F.col("text"), r"[.\n]")
    hit = t.documents.where(F.contains("text", F.lit("thorre"))).select("doc_id", F.get(F.filter(sentences, lambda x: F.contains(x, F.lit("thorre"))), F.lit(0)).alias("hit"))
    slim = t.documents.select("source", "lang", "n_chars", "doc_id")
    ranked = rows.top_n_per_group(slim, ["source", "lang"], [F.col("n_chars"), F.col("doc_id")], 20).withColumnRenamed("rn", "ordinal")
    return ranked.join(t.documents.select("doc_id", "text"), "doc_id").join(hit, "doc_id", "left").select("source", "lang", "ordinal", "doc_id", F.coalesce("hit", F.substring("text", 1, 80)).alias("passage"))


@query("filter_null_or_listed", "SELECT doc_id, lang FROM documents WHERE lang IS NULL OR lang IN ('en', 'de')")
def null_or_listed(t: Tables) -> DataFrame:
    return t.documents.where(F.col("lang").isNull() | F.col("lang").isin("en", "de")).select("doc_id", "lang")


DRAW = "('0x' || substr(md5('7:' || ({})), 1, 8))::BIGINT / 4294967296.0"


@query("source_sampled_rows", f"SELECT o_orderkey, o_custkey FROM orders WHERE {DRAW.format('o_orderkey')} < 0.1")
def sampled_rows(t: Tables) -> DataFrame:
    return resolution.sample_rows(t.orders, "o_orderkey", 0.1, 7).select("o_orderkey", "o_custkey")


@query("source_sampled_blocks", f"SELECT o_orderkey, o_custkey FROM orders WHERE {DRAW.format('o_orderkey // 100')} < 0.2")
def sampled_blocks(t: Tables) -> DataFrame:
    return resolution.sample_blocks(t.orders, "o_orderkey", 100, 0.2, 7).select("o_orderkey", "o_custkey")


@query("incr_event_time", """
SELECT l_orderkey, arg_max(l_linenumber, (coalesce(CASE WHEN l_returnflag <> 'N' THEN l_shipdate END, o_orderdate), l_linenumber)) AS latest, max(coalesce(CASE WHEN l_returnflag <> 'N' THEN l_shipdate END, o_orderdate)) AS at
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""")
def event_time(t: Tables) -> DataFrame:
    """An event counts at the time its source says, else when it was seen."""
    asserted = F.when(F.col("l_returnflag") != "N", F.col("l_shipdate"))
    j = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).withColumn("at", F.coalesce(asserted, "o_orderdate"))
    return j.groupBy("l_orderkey").agg(F.max_by("l_linenumber", F.struct("at", "l_linenumber")).alias("latest"), F.max("at").alias("at"))


@query("incr_nightly_sweep", """
SELECT user_id, count(*) FILTER (WHERE k IS NOT NULL) AS sent, count(*) FILTER (WHERE k IS NULL) AS failed, min(event_id) FILTER (WHERE k IS NULL) AS first_failure
FROM (SELECT user_id, event_id, try_cast(CASE WHEN event_id % 11 = 0 THEN 'x' ELSE json_extract_string(props, '$.k') END AS BIGINT) AS k FROM events WHERE ts >= TIMESTAMP '2024-01-02' AND ts < TIMESTAMP '2024-01-03') GROUP BY 1""")
def nightly_sweep(t: Tables) -> DataFrame:
    """The rows of the next day; one that cannot be read fails alone and is named."""
    day = t.events.where("ts >= timestamp_ntz'2024-01-02' AND ts < timestamp_ntz'2024-01-03'")
    raw = F.when(F.col("event_id") % 11 == 0, "x").otherwise(F.get_json_object("props", "$.k"))
    k = day.select("user_id", "event_id", raw.try_cast("bigint").alias("k"))
    lost = F.col("k").isNull()
    return k.groupBy("user_id").agg(F.count_if(~lost).alias("sent"), F.count_if(lost).alias("failed"), F.min(F.when(lost, F.col("event_id"))).alias("first_failure"))


@query("doc_tier_eligibility", """
SELECT doc_id, CASE WHEN lang IS NULL THEN 'no_language' WHEN text IS NULL OR length(text) < 200 THEN 'too_short' WHEN length(text) >= 2000 AND lang = 'en' THEN 'first' WHEN length(text) >= 2000 OR source IN ('src0', 'src1') THEN 'second' ELSE 'third' END AS tier FROM documents""")
def tier_eligibility(t: Tables) -> DataFrame:
    """Three axes (language, length, source) and their bands; what fits no band says why."""
    size, lang = F.length("text"), F.col("lang")
    tier = F.when(lang.isNull(), "no_language").when(size.isNull() | (size < 200), "too_short").when((size >= 2000) & (lang == "en"), "first")
    return t.documents.select("doc_id", tier.when((size >= 2000) | F.col("source").isin("src0", "src1"), "second").otherwise("third").alias("tier"))
