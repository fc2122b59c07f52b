"""The vector index: filtered and unfiltered search, its recall, and the fidelity of half precision."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from florilege.functions import signals
from florilege.operators import retrieval, vector_index
from florilege.plans.catalog import Tables, query
from florilege.plans.evidence import HALF
from florilege.plans.search import ASKED, DENSE, DOT, dense


def index(t: Tables) -> vector_index.Index:
    return vector_index.build(t.embeddings, "vec_id", "embedding", "label", f"vector-index-{uuid.uuid4().hex}")


def asked(t: Tables, filtered: bool) -> DataFrame:
    wanted = F.col("label") if filtered else F.lit(None)
    return t.embeddings.where(ASKED).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), wanted.cast("long").alias("wanted"))


def near(t: Tables, at: vector_index.Index, filtered: bool, k: int = 10) -> DataFrame:
    return vector_index.search(at, t.embeddings, "vec_id", "embedding", asked(t, filtered), k)


@query("retrieve_indexed_top")
def indexed_top(t: Tables) -> DataFrame:
    """The ten nearest that the index finds. No oracle: approximate; tests hold recall and scores."""
    return near(t, index(t), False).select("query_id", F.col("key").alias("vec_id"), F.round("score", 6).alias("score"), "rank")


@query("retrieve_indexed_filtered_top")
def indexed_filtered_top(t: Tables) -> DataFrame:
    """The ten nearest of the query's own label: lists are read until ten are found."""
    return near(t, index(t), True).select("query_id", F.col("key").alias("vec_id"), F.round("score", 6).alias("score"), "rank")


@query("eval_index_recall")
def index_recall(t: Tables) -> DataFrame:
    """Recall of one index, without a filter and with one, against exact search."""
    at = index(t)
    labelled = t.embeddings.where(ASKED).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), "label")
    exact = {False: dense(t, 10), True: retrieval.dense_top(labelled, t.embeddings.select("vec_id", "embedding", "label"), 10, within="label")}
    arms = [vector_index.recall(near(t, at, filtered), exact[filtered].select("query_id", F.col("vec_id").alias("key"))).select(F.lit("filtered" if filtered else "whole").alias("arm"), "exact", "found", "recall") for filtered in (False, True)]
    both = arms[0].unionByName(arms[1])
    return both.groupBy("arm").agg(F.count(F.lit(1)).alias("queries"), F.round(F.sum("found") / F.sum("exact"), 6).alias("recall"), F.round(F.min("recall"), 6).alias("poorest"))


@query("eval_half_precision_rank", f"""
WITH h AS MATERIALIZED (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: {HALF}) AS embedding FROM embeddings),
d AS (SELECT query_id, vec_id, rank, score - min(score) OVER (PARTITION BY query_id) AS gain FROM {DENSE} WHERE rank <= 10),
e AS (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM (SELECT a.vec_id AS query_id, b.vec_id, {DOT} AS score FROM h a JOIN h b ON a.vec_id <> b.vec_id WHERE a.{ASKED})),
p AS (SELECT query_id, vec_id, place, score = lag(score) OVER (PARTITION BY query_id ORDER BY place) AS tie FROM e WHERE place <= 10),
i AS (SELECT query_id, sum(gain / log2(1 + rank)) AS ideal FROM d GROUP BY 1)
SELECT p.query_id, count(gain) AS overlap, count(*) FILTER (WHERE tie) AS ties, round(CASE WHEN ideal > 0 THEN coalesce(sum(gain / log2(1 + place)), 0) / ideal ELSE 1 END, 6) AS ndcg
FROM p JOIN i USING (query_id) LEFT JOIN d ON d.query_id = p.query_id AND d.vec_id = p.vec_id GROUP BY p.query_id, ideal""")
def half_precision_rank(t: Tables) -> DataFrame:
    """What half precision does to the ten nearest: common ones, equal scores next to each other, and the
    discounted gain of its order."""
    halved = t.embeddings.select("vec_id", F.transform("embedding", signals.half).alias("embedding"))
    queries = halved.where(ASKED).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    named = lambda df: df.withColumnRenamed("vec_id", "key")
    return vector_index.agreement(named(dense(t, 10)), named(retrieval.dense_top(queries, halved, 10)), 10)
