"""Fielded and lexical search over documents, dense search over embeddings, fusion, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from florilege.functions.text import jaccard, lookup_key, tokens, trigrams
from florilege.operators import evaluation, retrieval
from florilege.plans.catalog import Tables, query

TOKENS = "regexp_extract_all(lower(text), '[a-z0-9]+')"
POSTINGS = f"(SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({TOKENS}) AS term FROM documents) GROUP BY 1, 2)"
DF = f"(SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({TOKENS}) AS term FROM documents) GROUP BY 1)"
DOT = "round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6)"
#: The stated query set of the dense examples.
ASKED = "vec_id % 25 = 0"
DENSE = f"""(SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank
  FROM (SELECT a.vec_id AS query_id, b.vec_id, {DOT} AS score FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.{ASKED}))"""


def dense(t: Tables, depth: int) -> DataFrame:
    asked = t.embeddings.where(ASKED).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return retrieval.dense_top(asked, t.embeddings.select("vec_id", "embedding"), depth)


@query("search_fielded_boolean", f"""
SELECT doc_id FROM documents WHERE (source = 'src1' OR source = 'src2') AND list_contains({TOKENS}, 'the') AND NOT list_contains({TOKENS}, 'from') AND lang = 'en'""")
def fielded_boolean(t: Tables) -> DataFrame:
    words = tokens(F.col("text"))
    cheap = F.col("source").isin("src1", "src2") & (F.col("lang") == "en")
    return t.documents.where(cheap).where(F.array_contains(words, "the") & ~F.array_contains(words, "from")).select("doc_id")


@query("search_phrase", f"""
SELECT doc_id FROM documents WHERE contains(' ' || array_to_string({TOKENS}, ' ') || ' ', ' of the ')""")
def phrase(t: Tables) -> DataFrame:
    line = F.concat(F.lit(" "), F.array_join(tokens(F.col("text")), " "), F.lit(" "))
    return t.documents.where(F.contains(line, F.lit(" of the "))).select("doc_id")


@query("search_prefix_term", f"SELECT doc_id FROM documents WHERE len(list_filter({TOKENS}, lambda w: starts_with(w, 'thou'))) > 0")
def prefix_term(t: Tables) -> DataFrame:
    return t.documents.where(F.exists(tokens(F.col("text")), lambda w: F.startswith(w, F.lit("thou")))).select("doc_id")


@query("search_near_exact_distance", f"""
WITH p AS (SELECT doc_id, generate_subscripts(w, 1) AS pos, unnest(w) AS term FROM (SELECT doc_id, {TOKENS} AS w FROM documents))
SELECT DISTINCT a.doc_id FROM p a JOIN p b ON a.doc_id = b.doc_id AND b.pos = a.pos + 3 WHERE a.term = 'the' AND b.term = 'of'""")
def near(t: Tables) -> DataFrame:
    places = lambda word: F.filter(F.transform(F.col("w"), lambda x, i: F.when(x == word, i)), lambda i: i.isNotNull())
    held = t.documents.select("doc_id", tokens(F.col("text")).alias("w")).where(F.array_contains("w", "the") & F.array_contains("w", "of"))
    held = held.select("doc_id", places("the").alias("a"), places("of").alias("b"))
    return held.where(F.arrays_overlap(F.transform("a", lambda i: i + 3), F.col("b"))).select("doc_id")


@query("search_lookup_key", "SELECT p_partkey, upper(regexp_replace(p_brand || '-' || p_type, '[^A-Za-z0-9]', '', 'g')) AS key FROM part")
def key(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", lookup_key(F.concat_ws("-", "p_brand", "p_type")).alias("key"))


@query("search_case_number_parse", r"""
SELECT c_custkey, upper(regexp_extract(c_name, '^([A-Za-z]+)#0*(\d+)$', 1)) AS kind, regexp_extract(c_name, '^([A-Za-z]+)#0*(\d+)$', 2)::BIGINT AS serial FROM customer WHERE regexp_matches(c_name, '^([A-Za-z]+)#0*(\d+)$')""")
def case_number(t: Tables) -> DataFrame:
    shape = r"^([A-Za-z]+)#0*(\d+)$"
    return t.customer.where(F.col("c_name").rlike(shape)).select("c_custkey", F.upper(F.regexp_extract("c_name", shape, 1)).alias("kind"), F.regexp_extract("c_name", shape, 2).cast("long").alias("serial"))


@query("search_shape_classifier", r"""
SELECT item_id, CASE WHEN regexp_matches(text, '\d{4}') THEN 'citation' WHEN regexp_matches(lower(text), '\bsection \d+') THEN 'section' WHEN regexp_matches(text, ' v\.? ') THEN 'case_name' WHEN len(regexp_extract_all(text, '\S+')) <= 4 THEN 'party_name' ELSE 'concept' END AS shape FROM benchmark""")
def shape(t: Tables) -> DataFrame:
    x = F.col("text")
    few = F.size(F.regexp_extract_all(x, F.lit(r"\S+"), F.lit(0))) <= 4
    kind = F.when(x.rlike(r"\d{4}"), "citation").when(F.lower(x).rlike(r"\bsection \d+"), "section").when(x.rlike(r" v\.? "), "case_name").when(few, "party_name").otherwise("concept")
    return t.benchmark.select("item_id", kind.alias("shape"))


@query("search_identity_outcome", """
SELECT key, CASE WHEN n = 0 THEN 'no_match' WHEN n = 1 THEN 'matched' ELSE 'ambiguous' END AS outcome FROM (SELECT q.key, count(c_custkey) AS n FROM (SELECT DISTINCT n_name AS key, n_nationkey FROM nation) q LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 9900 GROUP BY 1)""")
def identity_outcome(t: Tables) -> DataFrame:
    rich = t.customer.where("c_acctbal > 9900").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    asked = t.nation.join(rich, F.col("n_nationkey") == F.col("c_nationkey"), "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return asked.select(F.col("n_name").alias("key"), F.when(F.col("n") == 0, "no_match").when(F.col("n") == 1, "matched").otherwise("ambiguous").alias("outcome"))


@query("search_category_expansion", """
SELECT category, string_agg(source, ',' ORDER BY source) AS members FROM (SELECT DISTINCT source, CASE WHEN source IN ('src0', 'src1', 'src2') THEN 'apex' WHEN source LIKE 'src1_' THEN 'high' ELSE 'other' END AS category FROM documents) GROUP BY 1""")
def category_expansion(t: Tables) -> DataFrame:
    s = F.col("source")
    category = F.when(s.isin("src0", "src1", "src2"), "apex").when(s.like("src1_"), "high").otherwise("other")
    named = t.documents.select("source").distinct().withColumn("category", category)
    return named.groupBy("category").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("members"))


@query("search_trigram_similarity", """
WITH t AS (SELECT p_partkey, p_name, list_distinct(list_transform(range(1, length('  ' || lower(p_name) || ' ') - 1), lambda i: substr('  ' || lower(p_name) || ' ', i, 3))) AS g FROM part),
q AS (SELECT list_distinct(list_transform(range(1, length('  ' || 'part 17' || ' ') - 1), lambda i: substr('  ' || 'part 17' || ' ', i, 3))) AS g)
SELECT p_partkey, round(len(list_intersect(t.g, q.g)) / len(list_distinct(list_concat(t.g, q.g))), 6) AS similarity FROM t, q WHERE len(list_intersect(t.g, q.g)) / len(list_distinct(list_concat(t.g, q.g))) >= 0.35""")
def trigram_similarity(t: Tables) -> DataFrame:
    score = jaccard(trigrams(F.col("p_name")), trigrams(F.lit("part 17")))
    return t.part.select("p_partkey", score.alias("s")).where("s >= 0.35").select("p_partkey", F.round("s", 6).alias("similarity"))


# ---- lexical arms

@query("retrieve_document_frequency", f"SELECT term, df FROM {DF} WHERE df >= 5")
def document_frequency(t: Tables) -> DataFrame:
    return retrieval.document_frequency(t.documents, "text", "doc_id").where("df >= 5")


@query("retrieve_match_all", f"""
SELECT doc_id, sum(tf)::BIGINT AS score FROM {POSTINGS} WHERE term IN ('the', 'of', 'thing') GROUP BY 1 HAVING count(*) = 3 ORDER BY score DESC, doc_id LIMIT 50""")
def match_all(t: Tables) -> DataFrame:
    return retrieval.match_all(retrieval.postings(t.documents, "doc_id", "text"), "doc_id", ["the", "of", "thing"])


@query("retrieve_match_any_discriminating", f"""
WITH known AS (SELECT term, df, df <= 0.5 * (SELECT count(*) FROM documents) AS rare FROM {DF} WHERE term IN ('the', 'of', 'thing', 'thou', 'elle')),
chosen AS (SELECT term FROM known WHERE rare OR NOT (SELECT bool_or(rare) FROM known) ORDER BY df, length(term) DESC, term LIMIT 40)
SELECT doc_id, sum(tf)::BIGINT AS score FROM {POSTINGS} WHERE term IN (SELECT term FROM chosen) GROUP BY 1 ORDER BY score DESC, doc_id LIMIT 50""")
def match_any(t: Tables) -> DataFrame:
    df = retrieval.document_frequency(t.documents, "text", "doc_id")
    chosen = retrieval.discriminating(["the", "of", "thing", "thou", "elle"], df, t.documents.count())
    return retrieval.match_any(retrieval.postings(t.documents, "doc_id", "text"), "doc_id", chosen)


@query("retrieve_rarest_terms", f"""
SELECT item_id, term, df, rn FROM (SELECT item_id, term, df, row_number() OVER (PARTITION BY item_id ORDER BY df, term) AS rn FROM (SELECT DISTINCT item_id, unnest({TOKENS}) AS term FROM benchmark) JOIN {DF} USING (term)) WHERE rn <= 3""")
def rarest_terms(t: Tables) -> DataFrame:
    terms = t.benchmark.select("item_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    joined = terms.join(retrieval.document_frequency(t.documents, "text", "doc_id"), "term")
    ranked = joined.withColumn("rn", F.row_number().over(Window.partitionBy("item_id").orderBy("df", "term")))
    return ranked.where("rn <= 3").select("item_id", "term", "df", "rn")


@query("retrieve_admission", f"""
SELECT item_id, CASE WHEN min(coalesce(df, 0)) <= 0.008 * (SELECT count(*) FROM documents) THEN 'candidates' WHEN min(df) <= 0.2 * (SELECT count(*) FROM documents) THEN 'probe' ELSE 'unbounded' END AS plan
FROM (SELECT DISTINCT item_id, unnest({TOKENS}) AS term FROM benchmark) LEFT JOIN {DF} USING (term) GROUP BY 1""")
def admission(t: Tables) -> DataFrame:
    n = t.documents.count()
    terms = t.benchmark.select("item_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    joined = terms.join(retrieval.document_frequency(t.documents, "text", "doc_id"), "term", "left")
    rarest = joined.groupBy("item_id").agg(F.min(F.coalesce("df", F.lit(0))).alias("df"))
    plan = F.when(F.col("df") <= retrieval.ADMIT_DF * n, "candidates").when(F.col("df") <= 0.2 * n, "probe").otherwise("unbounded")
    return rarest.select("item_id", plan.alias("plan"))


# ---- dense arm

@query("retrieve_dense_top", f"SELECT query_id, vec_id, score, rank FROM {DENSE} WHERE rank <= 10")
def dense_top(t: Tables) -> DataFrame:
    return dense(t, 10)


@query("retrieve_quality_rescore", f"""
SELECT query_id, vec_id, round((1 - score) * (2 - least(label / 10.0, 1)), 6) AS distance FROM {DENSE} d JOIN (SELECT vec_id AS v, label FROM embeddings) l ON d.vec_id = l.v WHERE rank <= 20""")
def quality_rescore(t: Tables) -> DataFrame:
    top = dense(t, 20).join(t.embeddings.select("vec_id", "label"), "vec_id")
    return top.select("query_id", "vec_id", F.round((1 - F.col("score")) * (2 - F.least(F.col("label") / 10, F.lit(1))), 6).alias("distance"))


@query("retrieve_chunks_to_documents", f"""
SELECT query_id, doc, row_number() OVER (PARTITION BY query_id ORDER BY best, doc) AS rank FROM (SELECT query_id, vec_id // 4 AS doc, min(rank) AS best FROM {DENSE} WHERE rank <= 40 GROUP BY 1, 2) QUALIFY rank <= 15""")
def chunks_to_documents(t: Tables) -> DataFrame:
    chunks = dense(t, 40).withColumn("doc", F.floor(F.col("vec_id") / 4))
    return retrieval.best_per_document(chunks, "query_id", "doc", 15)


FUSED = f"""
WITH d AS (SELECT query_id, vec_id, rank FROM {DENSE} WHERE rank <= 30),
s AS (SELECT query_id, vec_id, rank FROM (SELECT a.vec_id AS query_id, b.vec_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY abs(a.vec_id - b.vec_id), b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.{ASKED}) WHERE rank <= 30),
f AS (SELECT query_id, vec_id, round(sum(part), 9) AS score FROM (SELECT query_id, vec_id, {{0}} / (60 + rank) AS part FROM d UNION ALL SELECT query_id, vec_id, {{1}} / (60 + rank) FROM s) GROUP BY 1, 2)
SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM f QUALIFY rank <= 20"""


def label_arm(t: Tables) -> DataFrame:
    """A second ranked list: vectors of the query's label, nearest ids first.

    Ids are numbered within their label; a query meets the thirty places before its own and the thirty
    behind it, by an equi-join, and no others.
    """
    slim = t.embeddings.select("label", "vec_id")
    placed = slim.withColumn("place", F.row_number().over(Window.partitionBy("label").orderBy("vec_id")))
    asked = placed.where(ASKED).select(F.col("vec_id").alias("query_id"), "label", F.explode(F.sequence(F.col("place") - 30, F.col("place") + 30)).alias("place"))
    pairs = asked.join(placed, ["label", "place"]).where("vec_id <> query_id")
    order = Window.partitionBy("query_id").orderBy(F.abs(F.col("query_id") - F.col("vec_id")), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where("rank <= 30").select("query_id", "vec_id", "rank")


@query("retrieve_rank_fusion", FUSED.format("1.0", "1.0"))
def rank_fusion(t: Tables) -> DataFrame:
    return retrieval.fuse([(dense(t, 30), 1.0), (label_arm(t), 1.0)], "query_id", "vec_id", 20)


@query("retrieve_weighted_fusion", FUSED.format("0.3", "0.7"))
def weighted_fusion(t: Tables) -> DataFrame:
    return retrieval.fuse([(dense(t, 30), 0.3), (label_arm(t), 0.7)], "query_id", "vec_id", 20)


@query("retrieve_fusion_sweep", f"""
WITH d AS (SELECT query_id, vec_id, rank FROM {DENSE} WHERE rank <= 20), g AS (SELECT a.vec_id AS query_id, b.vec_id, 1 AS gold FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.{ASKED}),
w AS (SELECT unnest(range(0, 5)) / 4.0 AS weight), s AS (SELECT weight, query_id, vec_id, weight / (60 + rank) + (1 - weight) / (60 + 21 - rank) AS score FROM d, w),
r AS (SELECT weight, query_id, vec_id, row_number() OVER (PARTITION BY weight, query_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM s)
SELECT weight, round(avg(CASE WHEN gold IS NULL THEN 0.0 ELSE 1.0 END), 6) AS precision5 FROM r LEFT JOIN g USING (query_id, vec_id) WHERE rank <= 5 GROUP BY 1""")
def fusion_sweep(t: Tables) -> DataFrame:
    label = t.embeddings.select("vec_id", F.col("label").alias("l"))
    top = dense(t, 20).join(label, "vec_id").join(label.toDF("query_id", "ql"), "query_id")
    weights = top.withColumn("weight", F.explode(F.array(*[F.lit(i / 4) for i in range(5)])))
    score = F.round(F.col("weight") / (60 + F.col("rank")) + (1 - F.col("weight")) / (60 + 21 - F.col("rank")), 9)
    again = weights.withColumn("s", score).withColumn("r", F.row_number().over(Window.partitionBy("weight", "query_id").orderBy(F.desc("s"), "vec_id"))).where("r <= 5")
    return again.groupBy("weight").agg(F.round(F.avg(F.when(F.col("l") == F.col("ql"), 1.0).otherwise(0.0)), 6).alias("precision5"))


@query("retrieve_group_policy", f"""
SELECT CASE WHEN label < 5 THEN 'dense' ELSE 'label' END AS policy, query_id, vec_id FROM {DENSE} d JOIN (SELECT vec_id AS q, label FROM embeddings) l ON d.query_id = l.q WHERE rank <= CASE WHEN label < 5 THEN 10 ELSE 3 END""")
def group_policy(t: Tables) -> DataFrame:
    label = t.embeddings.select(F.col("vec_id").alias("query_id"), "label")
    top = dense(t, 10).join(label, "query_id")
    low = F.col("label") < 5
    return top.where(F.col("rank") <= F.when(low, 10).otherwise(3)).select(F.when(low, "dense").otherwise("label").alias("policy"), "query_id", "vec_id")


@query("retrieve_graph_expansion", """
WITH seeds AS (SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 200),
sup AS (SELECT l_partkey, count(DISTINCT l_orderkey) AS support FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM seeds) GROUP BY 1 HAVING count(DISTINCT l_orderkey) >= 2),
inb AS (SELECT l_partkey, count(*) AS inbound FROM lineitem GROUP BY 1)
SELECT l_partkey, support, inbound, round(support / log2(greatest(inbound, 2) + 2), 9) AS score FROM sup JOIN inb USING (l_partkey)""")
def graph_expansion(t: Tables) -> DataFrame:
    seeds = t.orders.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(200).select("o_orderkey")
    return retrieval.expand(t.lineitem.select("l_orderkey", "l_partkey"), "l_orderkey", "l_partkey", seeds)


@query("retrieve_tail_append", """
WITH page AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS ord FROM orders QUALIFY ord <= 10),
more AS (SELECT o_orderkey, 10 + row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS ord FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM page) QUALIFY ord <= 15)
SELECT * FROM page UNION ALL SELECT * FROM more""")
def tail_append(t: Tables) -> DataFrame:
    page = t.orders.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)
    page = page.select("o_orderkey", F.row_number().over(Window.orderBy(F.desc("o_totalprice"), "o_orderkey")).alias("ord"))
    rest = t.orders.join(F.broadcast(page.select("o_orderkey")), "o_orderkey", "left_anti").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(5)
    return page.unionByName(rest.select("o_orderkey", (F.row_number().over(Window.orderBy(F.desc("o_orderdate"), "o_orderkey")) + 10).alias("ord")))


@query("retrieve_feature_rerank", f"""
WITH d AS (SELECT query_id, vec_id, score, rank, (SELECT label FROM embeddings e WHERE e.vec_id = x.vec_id) AS l, (SELECT label FROM embeddings e WHERE e.vec_id = x.query_id) AS ql FROM {DENSE} x WHERE rank <= 20),
n AS (SELECT *, coalesce((score - min(score) OVER q) / nullif(max(score) OVER q - min(score) OVER q, 0), 0) AS dn FROM d WINDOW q AS (PARTITION BY query_id))
SELECT query_id, vec_id, round(0.7 * dn + 0.2 * CASE WHEN l = ql THEN 1 ELSE 0 END + 0.1 * CASE WHEN vec_id < query_id THEN 1 ELSE 0 END, 6) AS score FROM n""")
def feature_rerank(t: Tables) -> DataFrame:
    label = t.embeddings.select("vec_id", F.col("label").alias("l"))
    top = dense(t, 20).join(label, "vec_id").join(label.toDF("query_id", "ql"), "query_id")
    flag = lambda c: F.when(c, 1).otherwise(0)
    score = 0.7 * retrieval.min_max(top, "query_id", "score") + 0.2 * flag(F.col("l") == F.col("ql")) + 0.1 * flag(F.col("vec_id") < F.col("query_id"))
    return top.select("query_id", "vec_id", F.round(score, 6).alias("score"))


@query("retrieve_outcome", f"""
SELECT query_id, CASE WHEN max(score) IS NULL THEN 'coverage_unknown' WHEN max(score) < 0.3 THEN 'abstained' WHEN max(score) - min(score) < 0.02 THEN 'review_required' WHEN max(score) < 0.4 THEN 'degraded' ELSE 'answered' END AS outcome FROM {DENSE} WHERE rank <= 2 GROUP BY 1""")
def outcome(t: Tables) -> DataFrame:
    top = dense(t, 2).groupBy("query_id").agg(F.max("score").alias("a"), F.min("score").alias("b"))
    a, b = F.col("a"), F.col("b")
    state = F.when(a.isNull(), "coverage_unknown").when(a < 0.3, "abstained").when(a - b < 0.02, "review_required").when(a < 0.4, "degraded").otherwise("answered")
    return top.select("query_id", state.alias("outcome"))


@query("retrieve_abstention_thresholds", f"""
WITH d AS (SELECT query_id, score, (SELECT label FROM embeddings e WHERE e.vec_id = x.vec_id) = (SELECT label FROM embeddings e WHERE e.vec_id = x.query_id) AS good FROM {DENSE} x WHERE rank = 1),
g AS (SELECT unnest(range(20, 61, 5)) / 100.0 AS threshold)
SELECT threshold, sum(CASE WHEN score < threshold THEN 0 WHEN good THEN 1 ELSE -4 END)::BIGINT AS utility, count(*) FILTER (WHERE score >= threshold) AS answered FROM d, g GROUP BY 1""")
def abstention_thresholds(t: Tables) -> DataFrame:
    label = t.embeddings.select("vec_id", F.col("label").alias("l"))
    first = dense(t, 1).join(label, "vec_id").join(label.toDF("query_id", "ql"), "query_id")
    grid = first.withColumn("threshold", F.explode(F.array(*[F.lit(i / 100) for i in range(20, 61, 5)])))
    said = F.col("score") >= F.col("threshold")
    gain = F.when(~said, 0).when(F.col("l") == F.col("ql"), 1).otherwise(-4)
    return grid.groupBy("threshold").agg(F.sum(gain).alias("utility"), F.count_if(said).alias("answered"))


@query("retrieve_saved_feed", """
SELECT doc_id, source FROM documents WHERE source = 'src3' AND doc_id > 200 ORDER BY doc_id DESC LIMIT 20""")
def saved_feed(t: Tables) -> DataFrame:
    return t.documents.where("source = 'src3' AND doc_id > 200").orderBy(F.desc("doc_id")).limit(20).select("doc_id", "source")


@query("retrieve_coverage_report", """
SELECT source, lang, count(*) AS held, CASE WHEN count(*) < 5 THEN 'absent' WHEN count(*) < 12 THEN 'partial' ELSE 'covered' END AS state FROM documents GROUP BY 1, 2""")
def coverage_report(t: Tables) -> DataFrame:
    cells = t.documents.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("held"))
    return cells.withColumn("state", F.when(F.col("held") < 5, "absent").when(F.col("held") < 12, "partial").otherwise("covered"))


# ---- evaluation

GOLD = f"(SELECT query_id, min(rank) AS rank FROM {DENSE} d JOIN (SELECT vec_id AS v, label FROM embeddings) a ON d.vec_id = a.v JOIN (SELECT vec_id AS q, label FROM embeddings) b ON d.query_id = b.q WHERE d.rank <= 20 AND a.label = b.label GROUP BY 1)"
ASKED_GOLD = f"(SELECT vec_id AS query_id, label, rank FROM embeddings LEFT JOIN {GOLD} g ON vec_id = g.query_id WHERE {ASKED})"


def gold_ranks(t: Tables) -> DataFrame:
    label = t.embeddings.select("vec_id", F.col("label").alias("l"))
    hits = dense(t, 20).join(label, "vec_id").join(label.toDF("query_id", "ql"), "query_id").where("l = ql").groupBy("query_id").agg(F.min("rank").alias("rank"))
    return t.embeddings.where(ASKED).select(F.col("vec_id").alias("query_id"), "label").join(hits, "query_id", "left")


@query("eval_ranked_lists", f"""
SELECT label, count(*) AS n, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END), 6) AS success5, round(avg(CASE WHEN rank <= 20 THEN 1.0 ELSE 0.0 END), 6) AS recall20, round(avg(coalesce(1.0 / rank, 0)), 6) AS rr, round(avg(CASE WHEN rank <= 20 THEN 1 / log2(rank + 1) ELSE 0 END), 6) AS ndcg20 FROM {ASKED_GOLD} GROUP BY 1""")
def ranked_lists(t: Tables) -> DataFrame:
    ranks = gold_ranks(t)
    return evaluation.summary(evaluation.per_query(ranks).join(ranks.select("query_id", "label"), "query_id"), ["label"])


@query("eval_precision_at_5", f"""
SELECT query_id, sum(CASE WHEN a.label = b.label THEN 1 ELSE 0 END)::BIGINT AS hits, round(avg(CASE WHEN a.label = b.label THEN 1.0 ELSE 0.0 END), 6) AS precision5 FROM {DENSE} d JOIN (SELECT vec_id AS v, label FROM embeddings) a ON d.vec_id = a.v JOIN (SELECT vec_id AS q, label FROM embeddings) b ON d.query_id = b.q WHERE rank <= 5 GROUP BY 1""")
def precision_at_5(t: Tables) -> DataFrame:
    label = t.embeddings.select("vec_id", F.col("label").alias("l"))
    top = dense(t, 5).join(label, "vec_id").join(label.toDF("query_id", "ql"), "query_id")
    good = F.col("l") == F.col("ql")
    return top.groupBy("query_id").agg(F.count_if(good).alias("hits"), F.round(F.avg(F.when(good, 1.0).otherwise(0.0)), 6).alias("precision5"))


@query("eval_gate_grades", f"""
SELECT 'success5' AS gate, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END), 6) AS value, avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END) >= 0.6 AS passed FROM {ASKED_GOLD}
UNION ALL SELECT 'misses', round(avg(CASE WHEN rank IS NULL THEN 1.0 ELSE 0.0 END), 6), avg(CASE WHEN rank IS NULL THEN 1.0 ELSE 0.0 END) <= 0.2 FROM {ASKED_GOLD}""")
def gate_grades(t: Tables) -> DataFrame:
    ranks = gold_ranks(t).agg(F.avg(F.when(F.col("rank") <= 5, 1.0).otherwise(0.0)).alias("s"), F.avg(F.when(F.col("rank").isNull(), 1.0).otherwise(0.0)).alias("m"))
    row = lambda name, c, limit, most: ranks.select(F.lit(name).alias("gate"), F.round(c, 6).alias("value"), evaluation.grade(F.col(c), limit, most).alias("passed"))
    return row("success5", "s", 0.6, False).unionByName(row("misses", "m", 0.2, True))


@query("eval_topk_overlap", f"""
WITH d AS (SELECT query_id, list(vec_id) AS a FROM {DENSE} WHERE rank <= 10 GROUP BY 1),
h AS (SELECT query_id, list(vec_id) AS b FROM (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 2) DESC, vec_id) AS rank FROM {DENSE}) WHERE rank <= 10 GROUP BY 1)
SELECT query_id, len(list_intersect(a, b))::BIGINT AS overlap FROM d JOIN h USING (query_id)""")
def topk_overlap(t: Tables) -> DataFrame:
    asked = t.embeddings.where(ASKED).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    top = lambda digits, name: retrieval.dense_top(asked, t.embeddings.select("vec_id", "embedding"), 10, digits).select("query_id", "vec_id", F.lit(1).alias(name))
    both = top(6, "fine").join(top(2, "coarse"), ["query_id", "vec_id"], "left")
    return both.groupBy("query_id").agg(F.count("coarse").alias("overlap"))


@query("eval_displacement", f"""
WITH f AS ({FUSED.format('1.0', '1.0')})
SELECT CASE WHEN d.rank <= 5 AND (f.rank IS NULL OR f.rank > 5) THEN 'displaced' WHEN (d.rank IS NULL OR d.rank > 5) AND f.rank <= 5 THEN 'gained' WHEN f.rank <= 5 THEN 'kept' ELSE 'outside' END AS effect, count(*) AS n
FROM (SELECT query_id, vec_id, rank FROM {DENSE} WHERE rank <= 30) d FULL JOIN f USING (query_id, vec_id) GROUP BY 1""")
def displacement(t: Tables) -> DataFrame:
    d = dense(t, 30).select("query_id", "vec_id", F.col("rank").alias("a"))
    f = retrieval.fuse([(dense(t, 30), 1.0), (label_arm(t), 1.0)], "query_id", "vec_id", 20).select("query_id", "vec_id", F.col("rank").alias("b"))
    a, b = F.coalesce("a", F.lit(99)), F.coalesce("b", F.lit(99))
    effect = F.when((a <= 5) & (b > 5), "displaced").when((a > 5) & (b <= 5), "gained").when(b <= 5, "kept").otherwise("outside")
    return d.join(f, ["query_id", "vec_id"], "full_outer").groupBy(effect.alias("effect")).agg(F.count(F.lit(1)).alias("n"))


@query("eval_family_split", """
SELECT c_custkey, CASE WHEN ('0x' || substr(sha256(c_mktsegment || ':' || c_nationkey), 1, 8))::BIGINT % 10 = 0 THEN 'eval' ELSE 'train' END AS split FROM customer""")
def family_split(t: Tables) -> DataFrame:
    family = F.concat_ws(":", "c_mktsegment", F.col("c_nationkey").cast("string"))
    bucket = F.conv(F.substring(F.sha2(family, 256), 1, 8), 16, 10).cast("long") % 10
    return t.customer.select("c_custkey", F.when(bucket == 0, "eval").otherwise("train").alias("split"))


@query("eval_denominators", """
SELECT 'line' AS denominator, count(*) AS n, round(avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END), 6) AS rate FROM lineitem
UNION ALL SELECT 'order', count(*), round(avg(r), 6) FROM (SELECT l_orderkey, max(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END) AS r FROM lineitem GROUP BY 1)
UNION ALL SELECT 'part', count(*), round(avg(r), 6) FROM (SELECT l_partkey, max(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END) AS r FROM lineitem GROUP BY 1)""")
def denominators(t: Tables) -> DataFrame:
    hit = F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0)
    count = lambda df, name, c: df.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(c), 6).alias("rate")).select(F.lit(name).alias("denominator"), "n", "rate")
    by = lambda k: t.lineitem.groupBy(k).agg(F.max(hit).alias("r"))
    return count(t.lineitem, "line", hit).unionByName(count(by("l_orderkey"), "order", F.col("r"))).unionByName(count(by("l_partkey"), "part", F.col("r")))


@query("eval_conditional_rate", f"""
SELECT round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0.0 END), 6) AS end_to_end, round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0.0 END) FILTER (WHERE rank IS NOT NULL), 6) AS given_found FROM {ASKED_GOLD}""")
def conditional_rate(t: Tables) -> DataFrame:
    first = F.when(F.col("rank") <= 1, 1.0).otherwise(0.0)
    return gold_ranks(t).agg(F.round(F.avg(first), 6).alias("end_to_end"), F.round(F.avg(F.when(F.col("rank").isNotNull(), first)), 6).alias("given_found"))


@query("eval_paired_error", """
SELECT o_orderpriority, round(avg(d), 4) AS mean, round(stddev_samp(d) / sqrt(count(*)), 4) AS stderr FROM (SELECT o_orderpriority, o_totalprice - x AS d FROM orders JOIN (SELECT l_orderkey, sum(l_extendedprice) AS x FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey) GROUP BY 1""")
def paired_error(t: Tables) -> DataFrame:
    lines = t.lineitem.groupBy("l_orderkey").agg(F.sum("l_extendedprice").alias("x"))
    d = t.orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).withColumn("d", F.col("o_totalprice") - F.col("x"))
    return d.groupBy("o_orderpriority").agg(F.round(F.avg("d"), 4).alias("mean"), F.round(F.stddev_samp("d") / F.sqrt(F.count(F.lit(1))), 4).alias("stderr"))


@query("eval_mcnemar", """
WITH c AS (SELECT o_orderpriority, count(*) FILTER (WHERE o_totalprice > 300000 AND o_orderstatus <> 'F') AS a, count(*) FILTER (WHERE o_totalprice <= 30000 AND o_orderstatus = 'F') AS b FROM orders GROUP BY 1)
SELECT o_orderpriority, a, b, CASE WHEN a + b = 0 THEN 1.0 ELSE round(least(1.0, 2 * (SELECT sum(exp(lgamma(a + b + 1) - lgamma(i + 1) - lgamma(a + b - i + 1) - (a + b) * ln(2))) FROM range(0, least(a, b) + 1) r(i))), 6) END AS p FROM c""")
def mcnemar(t: Tables) -> DataFrame:
    a = F.count_if((F.col("o_totalprice") > 300000) & (F.col("o_orderstatus") != "F"))
    b = F.count_if((F.col("o_totalprice") <= 30000) & (F.col("o_orderstatus") == "F"))
    counts = t.orders.groupBy("o_orderpriority").agg(a.alias("a"), b.alias("b"))
    return counts.select("o_orderpriority", "a", "b", F.round(evaluation.mcnemar(F.col("a"), F.col("b")), 6).alias("p"))


@query("eval_sample_size", """
WITH s AS (SELECT l_linestatus, avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END) AS p1, avg(CASE WHEN l_discount >= 0.05 THEN 1.0 ELSE 0.0 END) AS p2 FROM lineitem GROUP BY 1)
SELECT l_linestatus, ceil(pow(1.959963984540054 * sqrt(2 * (p1 + p2) / 2 * (1 - (p1 + p2) / 2)) + 0.8416212335729143 * sqrt(p1 * (1 - p1) + p2 * (1 - p2)), 2) / pow(p1 - p2, 2))::BIGINT AS n FROM s""")
def sample_size(t: Tables) -> DataFrame:
    p1, p2 = F.avg(F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0)), F.avg(F.when(F.col("l_discount") >= 0.05, 1.0).otherwise(0.0))
    rates = t.lineitem.groupBy("l_linestatus").agg(p1.alias("p1"), p2.alias("p2"))
    return rates.select("l_linestatus", evaluation.sample_size(F.col("p1"), F.col("p2")).cast("long").alias("n"))


@query("eval_bootstrap", f"""
WITH units AS (SELECT o_custkey, avg(o_totalprice) AS v FROM orders GROUP BY 1),
hashed AS (SELECT v, b, md5(o_custkey || ':' || b || ':7') AS h FROM units, (SELECT unnest(range(0, {evaluation.DRAWS // evaluation.PER_HASH})) AS b)),
drawn AS (SELECT v, b * {evaluation.PER_HASH} + k AS i, ('0x' || substr(h, 4 * k + 1, 4))::INT AS u FROM hashed, (SELECT unnest(range(0, {evaluation.PER_HASH})) AS k)),
means AS (SELECT i, sum(v * w) / sum(w) AS m FROM (SELECT i, v, {" + ".join(f"(u >= {c})::INT" for c in evaluation.POISSON)} AS w FROM drawn) GROUP BY 1)
SELECT (SELECT round(avg(v), 4) FROM units) AS mean, (SELECT count(*) FROM units) AS n, round(quantile_cont(m, 0.025), 4) AS low, round(quantile_cont(m, 0.975), 4) AS high FROM means""")
def bootstrap(t: Tables) -> DataFrame:
    """Customers are the units, with the mean price of their orders."""
    units = t.orders.groupBy("o_custkey").agg(F.avg("o_totalprice").alias("v"))
    found = evaluation.bootstrap(units, "o_custkey", "v")
    return found.select(*[F.round(c, 4).alias(c) for c in ("mean", "low", "high")], "n")


@query("eval_latency_percentiles", "SELECT event_type, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95, max(value) AS worst FROM events GROUP BY 1")
def latency_percentiles(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(F.percentile("value", 0.5).alias("p50"), F.percentile("value", 0.95).alias("p95"), F.max("value").alias("worst"))


@query("eval_field_precision", """
SELECT o_orderpriority, count(*) AS expected, count(*) FILTER (WHERE l.n IS NOT NULL AND l.n >= 1) AS matched, bool_and(l.n IS NOT NULL) AS exact FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) l ON o_orderkey = l_orderkey GROUP BY 1""")
def field_precision(t: Tables) -> DataFrame:
    lines = t.lineitem.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    joined = t.orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return joined.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("expected"), F.count_if(F.coalesce(F.col("n") >= 1, F.lit(False))).alias("matched"), F.bool_and(F.col("n").isNotNull()).alias("exact"))
