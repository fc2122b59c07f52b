"""Lexical and vector retrieval, rank fusion, graph expansion, reranking. Ranks start at 1."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from florilege.functions.text import tokens

#: Constants of the retrieval layer.
RRF_K = 60
SPARSE_DEPTH, DENSE_DEPTH = 50, 200
COMMON_DF = 0.5
TERM_CAP = 40
ADMIT_DF = 0.008
#: Sides of a tile of :func:`dense_top`, and queries that it scores at a time.
TILE_VECTORS, TILE_QUERIES, QUERY_ROWS = 16_384, 4_096, 256


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, term, tf``: how often each term occurs in each document."""
    return docs.select(key, F.explode(tokens(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def document_frequency(docs: DataFrame, text: str, key: str) -> DataFrame:
    """``term, df``: documents that hold each term."""
    return docs.select(key, F.explode(F.array_distinct(tokens(F.col(text)))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def match_all(post: DataFrame, key: str, terms: list[str], depth: int = SPARSE_DEPTH) -> DataFrame:
    """Documents with every term, by the sum of term frequencies (no IDF), ties to the smaller key."""
    held = post.where(F.col("term").isin(terms)).groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.sum("tf").alias("score"))
    return held.where(F.col("_n") == len(set(terms))).drop("_n").orderBy(F.desc("score"), key).limit(depth)


def discriminating(terms: list[str], df: DataFrame, n_docs: int, cap: int = TERM_CAP) -> DataFrame:
    """Query terms in at most half of the documents, rarest first, longer first among equals; all of
    them when all are common."""
    known = df.where(F.col("term").isin(terms))
    rare = known.withColumn("rare", F.col("df") <= COMMON_DF * n_docs)
    any_rare = F.max("rare").over(Window.partitionBy(F.lit(1)))  # over the query's terms
    return rare.withColumn("_any", any_rare).where(F.col("rare") | ~F.col("_any")).orderBy("df", F.desc(F.length("term")), "term").limit(cap).select("term", "df")


def match_any(post: DataFrame, key: str, chosen: DataFrame, depth: int = SPARSE_DEPTH) -> DataFrame:
    """Documents with any of the ``chosen`` terms (at most TERM_CAP), by summed term frequency."""
    held = post.join(F.broadcast(chosen.select("term")), "term", "left_semi").groupBy(key).agg(F.sum("tf").alias("score"))
    return held.orderBy(F.desc("score"), key).limit(depth)


def _nearest(depth: int, margin: float):
    """For one tile: what of its vectors can be among the ``depth`` best of each of its queries."""

    def score(queries: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or vectors.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        stack = lambda column: np.stack(column.to_numpy()).astype(np.float64)
        q_ids, v_ids, v = queries["query_id"].to_numpy(), vectors["vec_id"].to_numpy(), stack(vectors["embedding"]).T
        out = []
        for at in range(0, len(queries), QUERY_ROWS):
            dots = stack(queries["q"].iloc[at : at + QUERY_ROWS]) @ v
            dots[q_ids[at : at + QUERY_ROWS, None] == v_ids[None, :]] = -np.inf
            least = np.partition(dots, -depth, axis=1)[:, -depth] if dots.shape[1] > depth else np.full(len(dots), -np.inf)
            i, j = np.nonzero((dots >= least[:, None] - margin) & np.isfinite(dots))
            out.append(pd.DataFrame({"query_id": q_ids[at + i], "vec_id": v_ids[j], "score": dots[i, j]}))
        return pd.concat(out)

    return score


def dense_top(queries: DataFrame, vectors: DataFrame, depth: int, digits: int = 6, within: str | None = None) -> DataFrame:
    """``query_id, vec_id, score, rank``: the nearest vectors by dot product (6 decimals), the query's own
    aside; ranked by the score rounded to ``digits``, ties to the smaller id. With ``within``, a column of
    both sides, only vectors that have the query's value there are candidates.

    A stated query set against all vectors, in tiles of ``TILE_QUERIES`` x ``TILE_VECTORS``: a tile is a
    matrix product, from which only the best of each query leave. A vector travels once for each tile
    of queries, a query once for each tile of vectors; nothing is broadcast.
    """
    same = [F.col(within).alias("_same")] if within else []
    known = vectors.where("embedding is not null").select("vec_id", "embedding", *same)
    across, down = (max(1, -(-df.count() // size)) for df, size in ((known, TILE_VECTORS), (queries, TILE_QUERIES)))
    tile = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.where("q is not null").select(F.col("query_id").cast("long").alias("query_id"), "q", tile("query_id", down).alias("qt"), every(across).alias("vt"), *same)
    keys = ["qt", "vt", "_same"] if within else ["qt", "vt"]
    v = known.select(*known.columns[2:], F.col("vec_id").cast("long").alias("vec_id"), "embedding", tile("vec_id", across).alias("vt"), every(down).alias("qt"))
    near = q.groupBy(*keys).cogroup(v.groupBy(*keys)).applyInPandas(_nearest(depth, 1.01 * 10.0**-digits + 1e-6), "query_id long, vec_id long, score double")
    scored = near.withColumn("score", F.round("score", 6))
    order = [F.desc(F.round("score", digits)), F.col("vec_id")]
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= depth)


def best_per_document(hits: DataFrame, query: str, doc: str, cap: int) -> DataFrame:
    """Chunks to documents: the best rank of each, the first ``cap``, ranked anew."""
    best = hits.groupBy(query, doc).agg(F.min("rank").alias("_best"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy("_best", doc))).where(F.col("rank") <= cap).drop("_best")


def fuse(lists: list[tuple[DataFrame, float]], query: str, doc: str, depth: int, k: int = RRF_K) -> DataFrame:
    """Weighted reciprocal rank fusion: the sum of weight / (k + rank) over the lists."""
    arms = [df.select(query, doc, (F.lit(w) / (F.lit(k) + F.col("rank"))).alias("part")) for df, w in lists if w]
    union = arms[0]
    for arm in arms[1:]:
        union = union.unionByName(arm)
    scored = union.groupBy(query, doc).agg(F.round(F.sum("part"), 9).alias("score"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(F.desc("score"), doc))).where(F.col("rank") <= depth)


def expand(edges: DataFrame, src: str, dst: str, seeds: DataFrame, least: int = 2) -> DataFrame:
    """Neighbours cited by ``least`` seeds or more: support / log2(max(inbound, 2) + 2)."""
    few = F.broadcast(seeds.select(F.col(seeds.columns[0]).alias(src)).distinct())  # a result page
    support = edges.join(few, src, "left_semi").groupBy(dst).agg(F.count_distinct(src).alias("support")).where(F.col("support") >= least)
    inbound = edges.join(support.select(dst), dst, "left_semi").groupBy(dst).agg(F.count(F.lit(1)).alias("inbound"))
    score = F.round(F.col("support") / F.log2(F.greatest(F.col("inbound"), F.lit(2)) + 2), 9)
    return support.join(inbound, dst).withColumn("score", score)


def min_max(df: DataFrame, query: str, value: str) -> Column:
    """A value scaled to 0..1 within its query; 0 where all are equal."""
    w = Window.partitionBy(query)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return F.coalesce(F.try_divide(F.col(value) - low, high - low), F.lit(0.0))
