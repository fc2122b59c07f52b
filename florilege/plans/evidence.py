"""Recall, fidelity, hard negatives, group types, salient parts and verdicts on single texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from florilege.functions import signals
from florilege.operators import retrieval
from florilege.plans import passages
from florilege.plans.catalog import Tables, query
from florilege.plans.operations import STEPS, funnel
from florilege.plans.search import ASKED, DENSE, DOT, dense

SCORED = f"(SELECT a.vec_id AS query_id, a.label, b.label AS other, b.vec_id, {DOT} AS score FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.{ASKED})"


@query("eval_filtered_recall", f"""
WITH g AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM {SCORED}),
e AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM g WHERE label = other)
SELECT label, count(*) AS exact, count(*) FILTER (WHERE place <= 50) AS found, round(count(*) FILTER (WHERE place <= 50) / count(*), 6) AS recall FROM e WHERE rank <= 10 GROUP BY 1""")
def filtered_recall(t: Tables) -> DataFrame:
    """Of the ten nearest vectors with the query's label, how many a search for the fifty nearest of any label
    that is filtered afterwards would find."""
    asked = t.embeddings.where(ASKED).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), "label")
    exact = retrieval.dense_top(asked, t.embeddings.select("vec_id", "embedding", "label"), 10, within="label").join(asked.select("query_id", "label"), "query_id")
    both = exact.join(dense(t, 50).select("query_id", "vec_id", F.col("rank").alias("place")), ["query_id", "vec_id"], "left")
    found = F.count("place")
    return both.groupBy("label").agg(F.count(F.lit(1)).alias("exact"), found.alias("found"), F.round(found / F.count(F.lit(1)), 6).alias("recall"))


HALF = "CASE WHEN x = 0 THEN 0 ELSE round_even(x / pow(2, greatest(floor(log2(abs(x))), -14) - 10), 0) * pow(2, greatest(floor(log2(abs(x))), -14) - 10) END"


@query("eval_half_precision", f"""
WITH h AS MATERIALIZED (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: {HALF}) AS embedding FROM embeddings),
d AS (SELECT query_id, vec_id FROM {DENSE} WHERE rank <= 10),
e AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (SELECT a.vec_id AS query_id, b.vec_id, {DOT} AS score FROM h a JOIN h b ON a.vec_id <> b.vec_id WHERE a.{ASKED}))
SELECT query_id, count(e.vec_id) AS overlap FROM d LEFT JOIN (SELECT * FROM e WHERE rank <= 10) e USING (query_id, vec_id) GROUP BY 1""")
def half_precision(t: Tables) -> DataFrame:
    """How many of the ten nearest vectors stay when all vectors are held in half precision."""
    halved = t.embeddings.select("vec_id", F.transform("embedding", signals.half).alias("embedding"))
    asked = halved.where(ASKED).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    coarse = retrieval.dense_top(asked, halved, 10).select("query_id", "vec_id", F.lit(1).alias("kept"))
    return dense(t, 10).join(coarse, ["query_id", "vec_id"], "left").groupBy("query_id").agg(F.count("kept").alias("overlap"))


@query("retrieve_hard_negatives", f"""
SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM {DENSE} d JOIN (SELECT vec_id, label FROM embeddings) v USING (vec_id) JOIN (SELECT vec_id AS query_id, label AS gold FROM embeddings) q USING (query_id) WHERE rank <= 20 AND label <> gold QUALIFY place <= 5""")
def hard_negatives(t: Tables) -> DataFrame:
    """Near vectors that are not of the query's label."""
    labels = t.embeddings.select("vec_id", "label")
    near = dense(t, 20).join(labels, "vec_id").join(labels.toDF("query_id", "gold"), "query_id").where("label <> gold")
    return near.select("query_id", "vec_id", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")).alias("place")).where("place <= 5")


@query("doc_hard_negative_swaps", """
SELECT * FROM (SELECT o_orderkey, CASE WHEN length(s) >= 2 AND right(s, 1) <> s[-2] THEN left(s, length(s) - 2) || right(s, 1) || s[-2] END AS swapped FROM (SELECT o_orderkey, o_orderkey::VARCHAR AS s FROM orders)) WHERE swapped IS NOT NULL""")
def hard_negative_swaps(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", signals.swapped_digits(F.col("o_orderkey")).alias("swapped")).where("swapped is not null")


@query("ops_worst_drop", f"""
WITH c AS (SELECT event_type, count(DISTINCT user_id) AS u FROM events GROUP BY 1), j AS (SELECT place, step, coalesce(u, 0) AS users FROM (SELECT generate_subscripts(s, 1) AS place, unnest(s) AS step FROM (SELECT {STEPS} AS s)) LEFT JOIN c ON step = event_type)
SELECT from_step, to_step, retained FROM (SELECT lag(step) OVER w AS from_step, step AS to_step, users / nullif(lag(users) OVER w, 0) AS retained, place FROM j WINDOW w AS (ORDER BY place)) WHERE retained IS NOT NULL ORDER BY retained, place LIMIT 1""")
def worst_drop(t: Tables) -> DataFrame:
    """The step that keeps the smallest share of the step before it; no row where no share is known."""
    steps = funnel(t).withColumn("from_step", F.lag("step").over(Window.orderBy("place")))  # a row for each step
    return steps.where("of_previous is not null").orderBy("of_previous", "place").limit(1).select("from_step", F.col("step").alias("to_step"), F.col("of_previous").alias("retained"))


MARKER = r"[#%$&*]{3}"


@query("doc_font_verdict", rf"""
SELECT doc_id, CASE WHEN text IS NULL THEN 'unknown' WHEN len(regexp_extract_all(text, '[\x{{0900}}-\x{{097F}}]')) = 0 AND coalesce(len(regexp_extract_all(text, '{MARKER}')) * 1000.0 / nullif(length(text), 0), 0) >= {signals.SUSPECT_MARKERS} THEN 'suspect' ELSE 'clean' END AS verdict FROM documents""")
def font_verdict(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", signals.font_verdict(F.col("text"), MARKER).alias("verdict"))


@query("doc_cut_words", f"""
WITH c AS (SELECT doc_id, coalesce(len(list_filter(w, lambda x: x IN {signals.PROBES})), 0) AS whole, coalesce(len(list_filter(w, lambda x: x IN {tuple(p[1:] for p in signals.PROBES)})), 0) AS cut FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM documents))
SELECT doc_id, whole, cut, CASE WHEN whole + cut < {signals.LEAST_PROBES} THEN 'unknown' WHEN cut / (whole + cut) > {signals.CUT_MOST} THEN 'truncated' ELSE 'whole' END AS verdict FROM c""")
def cut_words(t: Tables) -> DataFrame:
    whole, cut = signals.cut_counts(F.col("text"))
    counted = t.documents.select("doc_id", whole.alias("whole"), cut.alias("cut"))
    hits = F.col("whole") + F.col("cut")
    verdict = F.when(hits < signals.LEAST_PROBES, "unknown").when(F.col("cut") / hits > signals.CUT_MOST, "truncated").otherwise("whole")
    return counted.withColumn("verdict", verdict)


@query("graph_group_types", f"""
WITH g AS (SELECT o_custkey, year(o_orderdate)::INT AS year, count(*) AS members, string_agg(o_orderkey::VARCHAR, '|' ORDER BY o_orderkey::VARCHAR) AS ids, count(DISTINCT o_totalprice) AS texts, count(DISTINCT o_orderstatus) AS numbers, count(DISTINCT o_orderdate) AS dates, count(DISTINCT o_orderpriority) AS courts FROM orders GROUP BY 1, 2 HAVING count(*) > 1)
SELECT o_custkey, year, members, list_reduce(list_prepend({signals.FNV_OFFSET}::BIGINT, list_transform(string_split(ids, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (xor(h, c) * {signals.FNV_PRIME}) % 4294967296) AS group_id,
CASE WHEN texts = 1 THEN 'IDENTICAL' WHEN numbers = 1 AND courts = 1 AND dates > 1 THEN 'ORDERS_OF_ONE_CASE' WHEN courts = 1 AND dates = 1 AND numbers > 1 THEN 'COMMON_ORDER' ELSE 'SHARED_REFERENCE' END AS kind FROM g""")
def group_types(t: Tables) -> DataFrame:
    """What a group of orders is, from the distinct values its members have, and an id that depends on the
    members alone. A group is a customer's year."""
    n = F.count_distinct
    g = t.orders.groupBy("o_custkey", F.year("o_orderdate").alias("year")).agg(
        F.count(F.lit(1)).alias("members"), F.array_join(F.array_sort(F.collect_list(F.col("o_orderkey").cast("string"))), "|").alias("ids"),
        n("o_totalprice").alias("texts"), n("o_orderstatus").alias("numbers"), n("o_orderdate").alias("dates"), n("o_orderpriority").alias("courts"))
    kind = F.when(F.expr("texts = 1"), "IDENTICAL").when(F.expr("numbers = 1 AND courts = 1 AND dates > 1"), "ORDERS_OF_ONE_CASE").when(F.expr("courts = 1 AND dates = 1 AND numbers > 1"), "COMMON_ORDER").otherwise("SHARED_REFERENCE")
    return g.where("members > 1").select("o_custkey", "year", "members", signals.fnv1a(F.col("ids")).alias("group_id"), kind.alias("kind"))


@query("doc_salient_parts", """
WITH s AS (SELECT doc_id, generate_subscripts(a, 1) AS i, unnest(a) AS part, len(a) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents)),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, i > 1 AND i < n ORDER BY length(part) DESC, i) AS rn FROM s)
SELECT doc_id, i AS ordinal, length(part) AS chars FROM r WHERE i = 1 OR i = n OR rn <= 4""")
def salient_parts(t: Tables) -> DataFrame:
    """The first and the last part of a text and the four longest between them; parts are lines."""
    parts = F.split("text", "\n")
    s = t.documents.select("doc_id", F.posexplode(parts).alias("p", "part"), F.size(parts).alias("n")).select("doc_id", (F.col("p") + 1).cast("long").alias("i"), F.length("part").cast("long").alias("chars"), "n")
    inner = (F.col("i") > 1) & (F.col("i") < F.col("n"))
    best = Window.partitionBy("doc_id", "inner").orderBy(F.desc("chars"), "i")
    ranked = s.withColumn("inner", inner).withColumn("rn", F.row_number().over(best))
    return ranked.where("NOT inner OR rn <= 4").select("doc_id", F.col("i").alias("ordinal"), "chars")


@query("top_section_numbers", f"""
WITH f AS (SELECT unnest(regexp_extract_all(text, {passages.quoted(passages.passages.SECTION)}, 1)) AS s, unnest(regexp_extract_all(text, {passages.quoted(passages.passages.SECTION)}, 2)) AS a FROM {passages.REPORTS}),
c AS (SELECT DISTINCT CASE {passages.SPELLINGS} ELSE c END AS act, section FROM (SELECT upper(s) AS section, {passages.CLEAN} AS c FROM f))
SELECT act, section, row_number() OVER (PARTITION BY act ORDER BY regexp_extract(section, '^[0-9]+')::INT, regexp_extract(section, '^[0-9]+(.*)$', 1)) AS place FROM c""")
def section_numbers(t: Tables) -> DataFrame:
    """The cited sections of an act in printed order: by number, then by what follows it."""
    cited = passages.section_references(t).select("act", "section").distinct()
    number, rest = F.regexp_extract("section", "^[0-9]+", 0).cast("int"), F.regexp_extract("section", "^[0-9]+(.*)$", 1)
    return cited.select("act", "section", F.row_number().over(Window.partitionBy("act").orderBy(number, rest)).alias("place"))
