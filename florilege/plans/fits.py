"""Thresholds and fusions chosen on development queries, with their figures on the others."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from florilege.operators import fits
from florilege.plans.catalog import Tables, query
from florilege.plans.search import ASKED, DENSE, dense

DEV = "('0x' || substr(md5(query_id::VARCHAR), 1, 4))::INT % 2 = 0"
LABELLED = "(SELECT vec_id AS query_id, label AS gold FROM embeddings) q USING (query_id) JOIN (SELECT vec_id, label FROM embeddings) v USING (vec_id)"


def graded(t: Tables, ranked: DataFrame) -> DataFrame:
    """``ranked`` with ``hit``: whether a vector has its query's label, and ``gold``, that label."""
    labels = t.embeddings.select("vec_id", "label")
    return ranked.join(labels, "vec_id").join(labels.toDF("query_id", "gold"), "query_id").withColumn("hit", F.col("label") == F.col("gold"))


@query("eval_abstention_fit", f"""
WITH a AS (SELECT query_id, round(score, 3) AS s, label = gold AS hit, {DEV} AS dev FROM {DENSE} d JOIN {LABELLED} WHERE rank <= 3),
c AS (SELECT DISTINCT s AS threshold, sum(hit::INT) OVER w - 4 * (count(*) OVER w - sum(hit::INT) OVER w) AS utility FROM a WHERE dev WINDOW w AS (ORDER BY s DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
b AS (SELECT arg_max(threshold, (utility, threshold)) AS threshold FROM c WHERE utility > 0),
h AS (SELECT (SELECT threshold FROM b) AS threshold, count(*) AS questions, count(*) FILTER (WHERE s >= (SELECT threshold FROM b)) AS answered, count(*) FILTER (WHERE hit AND s >= (SELECT threshold FROM b)) AS "right" FROM a WHERE NOT dev)
SELECT *, "right" - 4 * (answered - "right") AS utility FROM h""")
def abstention_fit(t: Tables) -> DataFrame:
    """The three nearest of each query as answers: right if they have its label. Fitted on one half of the queries."""
    answers = graded(t, dense(t, 3)).withColumn("dev", fits.is_dev(F.col("query_id")))
    chosen = fits.best_threshold(fits.threshold_curve(answers.where("dev"), "score", "hit"))
    return fits.held_out_utility(answers.where("not dev"), "score", "hit", chosen)


IDS = f"(SELECT a.vec_id AS query_id, b.vec_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY abs(a.vec_id - b.vec_id), b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON b.vec_id BETWEEN a.vec_id - 15 AND a.vec_id + 15 AND a.vec_id <> b.vec_id WHERE a.{ASKED})"
FUSED = f"""
WITH w AS (SELECT unnest(range(0, 14)) AS fusion), j AS (SELECT query_id, vec_id, d.rank AS ra, i.rank AS rb FROM (SELECT * FROM {DENSE} WHERE rank <= 30) d FULL JOIN {IDS} i USING (query_id, vec_id)),
s AS (SELECT fusion, query_id, vec_id, round(CASE WHEN fusion > 0 AND ra IS NOT NULL THEN round(fusion / 13, 4) / (60 + ra) ELSE 0.0 END + CASE WHEN fusion < 13 AND rb IS NOT NULL THEN (1 - round(fusion / 13, 4)) / (60 + rb) ELSE 0.0 END, 9) AS s FROM j, w),
p AS (SELECT *, row_number() OVER (PARTITION BY fusion, query_id ORDER BY s DESC, vec_id) AS place FROM s WHERE s > 0),
g AS (SELECT fusion, query_id, gold, avg((label = gold)::INT) AS gain FROM p JOIN {LABELLED} WHERE place <= 5 GROUP BY ALL)"""


def gains(t: Tables) -> DataFrame:
    """The part of the first five that has the query's label, for each query and fusion of two arms: nearest
    vectors, and nearest ids."""
    ids = t.embeddings.where(ASKED).select(F.col("vec_id").alias("query_id"), F.explode(F.sequence(F.col("vec_id") - 15, F.col("vec_id") + 15)).alias("vec_id")).where("vec_id <> query_id")
    near = ids.join(t.embeddings.select("vec_id"), "vec_id", "left_semi")
    order = Window.partitionBy("query_id").orderBy(F.abs(F.col("query_id") - F.col("vec_id")), "vec_id")
    two = near.withColumn("rank", F.row_number().over(order))
    fused = fits.fusions(dense(t, 30), two, "query_id", "vec_id", 5)
    return graded(t, fused).groupBy("fusion", "query_id", "gold").agg(F.avg(F.col("hit").cast("int")).alias("gain"))


@query("eval_fourteen_fusions", f"{FUSED} SELECT fusion, round(avg(CASE WHEN {DEV} THEN gain END), 6) AS dev_gain, round(avg(CASE WHEN NOT {DEV} THEN gain END), 6) AS held_gain FROM g GROUP BY 1")
def fourteen_fusions(t: Tables) -> DataFrame:
    dev = fits.is_dev(F.col("query_id"))
    return gains(t).groupBy("fusion").agg(F.round(F.avg(F.when(dev, F.col("gain"))), 6).alias("dev_gain"), F.round(F.avg(F.when(~dev, F.col("gain"))), 6).alias("held_gain"))


@query("eval_group_policies", f"""{FUSED},
x AS (SELECT gold % 3 AS family, fusion, {DEV} AS dev, gain FROM g), m AS (SELECT family, fusion, round(avg(gain), 6) AS dev_gain FROM x WHERE dev GROUP BY 1, 2),
b AS (SELECT family, arg_max(fusion, (dev_gain, -fusion)) AS fusion, max(dev_gain) AS dev_gain FROM m GROUP BY 1), r AS (SELECT family, fusion, count(*) AS held_queries, round(avg(gain), 6) AS held_gain FROM x WHERE NOT dev GROUP BY 1, 2)
SELECT b.family, b.fusion, b.dev_gain, r.held_queries, r.held_gain, f.held_gain AS fixed_gain FROM b LEFT JOIN r ON r.family = b.family AND r.fusion = b.fusion LEFT JOIN (SELECT * FROM r WHERE fusion = 13) f ON f.family = b.family""")
def group_policies(t: Tables) -> DataFrame:
    """The best fusion of each family of labels on development queries, with its gain on the others."""
    return fits.group_policies(gains(t).withColumn("family", F.col("gold") % 3), "family", "query_id", "gain")
