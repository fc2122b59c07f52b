"""Aggregate analytics: grades over months, single-dimension reports, ordinals, funnels, readouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A month under this part of its baseline is partial, or effectively absent.
PARTIAL, ABSENT = 0.6, 0.1
BASE_MONTHS, LEAST_MONTHS = 6, 3
#: A rate is withheld below so many exposed users.
LEAST_EXPOSED = 100


def month_grades(df: DataFrame, at: str) -> DataFrame:
    """``mon, n, grade``: each month's count against the mean of the six months before it."""
    months = df.groupBy(F.trunc(F.col(at).cast("date"), "month").alias("mon")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy("mon").rowsBetween(-BASE_MONTHS, -1)  # over months, not rows
    base, have = F.avg("n").over(w), F.count(F.lit(1)).over(w)
    grade = F.when(have < LEAST_MONTHS, "UNDER_TEST").when(F.col("n") < ABSENT * base, "EFFECTIVELY_ABSENT").when(F.col("n") < PARTIAL * base, "PARTIAL").otherwise("CURRENT")
    return months.select("mon", "n", grade.alias("grade"))


def by_each(df: DataFrame, dimensions: dict[str, str], measures: list[Column]) -> DataFrame:
    """One report for each dimension by itself and one in total, in one pass (grouping sets)."""
    columns = list(dimensions.values())
    sets = df.groupingSets([[F.col(c)] for c in columns] + [[]], *columns)
    name, member = F.lit("total"), F.lit("all")
    grouped = sets.agg(*measures, *[F.grouping(c).alias(f"_g_{c}") for c in columns])
    for label, c in dimensions.items():
        name = F.when(F.col(f"_g_{c}") == 0, label).otherwise(name)
        member = F.when(F.col(f"_g_{c}") == 0, F.col(c)).otherwise(member)
    kept = [m for m in grouped.columns if m not in columns and not m.startswith("_g_")]
    return grouped.select(name.alias("dimension"), member.alias("member"), *kept)


def ordinal(df: DataFrame, key: str, out: str, parts: int = 64) -> DataFrame:
    """A 1-based ordinal in the order of ``key`` (unique), without one task for all rows: rows are
    put into ranges of the key by approximate quantiles, numbered in each, and shifted."""
    cuts = df.select(F.percentile_approx(key, [i / parts for i in range(1, parts)], 10_000)).first()[0] or []  # parts - 1 values
    bucket = F.lit(0)
    for cut in sorted(set(cuts)):
        bucket = bucket + (F.col(key) > F.lit(cut)).cast("int")
    cut_up = df.withColumn("_b", bucket)
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = cut_up.groupBy("_b").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).select("_b", "_before")
    numbered = cut_up.withColumn("_rn", F.row_number().over(Window.partitionBy("_b").orderBy(key)))
    return numbered.join(F.broadcast(counts), "_b").withColumn(out, F.col("_before") + F.col("_rn")).drop("_b", "_rn", "_before")  # at most `parts` rows


def funnel(df: DataFrame, user: str, step: str, steps: list[str]) -> DataFrame:
    """``step, users, of_first, of_previous``: users who reached each step, whatever the order."""
    counts = df.where(F.col(step).isin(steps)).groupBy(F.col(step).alias("step")).agg(F.count_distinct(user).alias("users"))
    named = df.sparkSession.createDataFrame([(i, s) for i, s in enumerate(steps)], "place int, step string")
    full = named.join(counts, "step", "left").withColumn("users", F.coalesce("users", F.lit(0)))
    w = Window.orderBy("place")  # a row for each step
    first = F.first("users").over(w)
    return full.select("step", "users", F.try_divide("users", first).alias("of_first"), F.try_divide(F.col("users"), F.lag("users").over(w)).alias("of_previous"), "place")


def variant(experiment: str, user: Column, n: int) -> Column:
    """The variant of a user: the first four bytes of SHA-256 of ``experiment:user``, modulo n."""
    return (F.conv(F.substring(F.sha2(F.concat(F.lit(f"{experiment}:"), user.cast("string")), 256), 1, 8), 16, 10).cast("long") % n).cast("int")


def readout(exposed: DataFrame, converted: DataFrame, user: str, group: str) -> DataFrame:
    """``group, exposed, converted, rate`` of distinct users; no rate below LEAST_EXPOSED."""
    users = exposed.select(user, group).distinct().join(converted.select(user).distinct().withColumn("_hit", F.lit(1)), user, "left")
    out = users.groupBy(group).agg(F.count(F.lit(1)).alias("exposed"), F.count("_hit").alias("converted"))
    return out.withColumn("rate", F.when(F.col("exposed") >= LEAST_EXPOSED, F.round(F.col("converted") / F.col("exposed"), 6)))
