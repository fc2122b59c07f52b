"""Choices fitted on a development split and judged on the rest: thresholds, fusions, policies of groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What a wrong answer costs against what a right one brings.
PENALTY = 4
#: Scores are rounded to so many decimals, so that a curve has a bounded number of thresholds.
DIGITS = 3
#: Weights of the first arm; the second has the rest. One arm alone stands at either end.
WEIGHTS = tuple(round(i / 13, 4) for i in range(14))
RRF_K = 60


def is_dev(key: Column) -> Column:
    """Whether a row belongs to the development half: by the MD5 of its key, the same in every run."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 4), 16, 10).cast("int") % 2 == 0


def threshold_curve(answers: DataFrame, score: str, right: str) -> DataFrame:
    """``threshold, answered, right, utility``: what answering from each score on brings. Rows are summed by
    rounded score before the one running sum; no row meets a grid."""
    at = answers.groupBy(F.round(F.col(score), DIGITS).alias("threshold")).agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col(right)).alias("_r"))
    down = Window.orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, 0)  # a row for each rounded score
    curve = at.select("threshold", F.sum("_n").over(down).alias("answered"), F.sum("_r").over(down).alias("right"))
    return curve.withColumn("utility", F.col("right") - PENALTY * (F.col("answered") - F.col("right")))


def best_threshold(curve: DataFrame) -> DataFrame:
    """The threshold of the greatest utility, of equal ones the higher; none if answering never pays. One row."""
    return curve.where("utility > 0").agg(F.max_by("threshold", F.struct("utility", "threshold")).alias("threshold"))


def held_out_utility(answers: DataFrame, score: str, right: str, chosen: DataFrame) -> DataFrame:
    """``threshold, questions, answered, right, utility`` of a threshold on other rows."""
    joined = answers.join(F.broadcast(chosen))  # one row
    given = F.coalesce(F.round(F.col(score), DIGITS) >= F.col("threshold"), F.lit(False))
    told = joined.agg(F.first("threshold").alias("threshold"), F.count(F.lit(1)).alias("questions"), F.count_if(given).alias("answered"), F.count_if(given & F.col(right)).alias("right"))
    return told.withColumn("utility", F.col("right") - PENALTY * (F.col("answered") - F.col("right")))


def fusions(one: DataFrame, two: DataFrame, query: str, key: str, depth: int) -> DataFrame:
    """``fusion, query, key, place``: the first ``depth`` of both arms (``query, key, rank``) under each of the
    fourteen weights, by weighted reciprocal ranks. A weight of nothing leaves an arm out."""
    both = one.select(query, key, F.col("rank").alias("_a")).join(two.select(query, key, F.col("rank").alias("_b")), [query, key], "full_outer")
    part = lambda w, rank: F.when((w > 0) & rank.isNotNull(), w / (RRF_K + rank)).otherwise(F.lit(0.0))
    each = both.select(query, key, "_a", "_b", F.posexplode(F.array(*[F.lit(w) for w in WEIGHTS])).alias("fusion", "_w"))
    scored = each.withColumn("_s", F.round(part(F.col("_w"), F.col("_a")) + part(1 - F.col("_w"), F.col("_b")), 9)).where("_s > 0")
    place = F.row_number().over(Window.partitionBy("fusion", query).orderBy(F.desc("_s"), key))
    return scored.withColumn("place", place).where(F.col("place") <= depth).select("fusion", query, key, "place")


def group_policies(graded: DataFrame, group: str, query: str, gain: str) -> DataFrame:
    """``group, fusion, dev_gain, held_queries, held_gain, fixed_gain``: for each group the fusion with the greatest mean gain on the development
    queries (of equal ones the first), that gain, and on the held-out queries its gain beside that of fusion 13, the first arm alone."""
    split = graded.withColumn("_dev", is_dev(F.col(query)))
    means = split.where("_dev").groupBy(group, "fusion").agg(F.round(F.avg(gain), 6).alias("dev_gain"))
    best = means.groupBy(group).agg(F.max(F.struct("dev_gain", (-F.col("fusion")).alias("f"))).alias("_b")).select(group, (-F.col("_b.f")).alias("fusion"), "_b.dev_gain")
    rest = split.where("not _dev").groupBy(group, "fusion").agg(F.count(F.lit(1)).alias("held_queries"), F.round(F.avg(gain), 6).alias("held_gain"))
    fixed = rest.where("fusion = 13").select(group, F.col("held_gain").alias("fixed_gain"))
    return best.join(rest, [group, "fusion"], "left").join(fixed, group, "left")
