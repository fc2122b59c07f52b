"""Joins that Spark has no operator for: as-of, range, any-of-several keys, unique keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, since: str, payload: list[str]) -> DataFrame:
    """Each left row with the ``payload`` of the latest right row with ``since <= at``, else nulls.

    Both sides are put in one stream per key, and the last right row seen is carried forward: one
    shuffle, no pairs. Right rows at the same instant as a left row count.
    """
    tag = F.struct(*[F.col(c) for c in payload])
    names = [f"_k{i}" for i in range(len(keys))]
    l = left.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col(at).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"), F.lit(None).cast(right.select(tag.alias("x")).schema[0].dataType).alias("_pay"))
    r = right.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col(since).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(left.select(F.struct(*left.columns).alias("x")).schema[0].dataType).alias("_row"), tag.alias("_pay"))
    order = Window.partitionBy(*names).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    carried = l.unionByName(r).withColumn("_last", F.last("_pay", ignorenulls=True).over(order)).where("_side = 1")
    return carried.select("_row.*", *[F.col("_last")[c].alias(c) for c in payload])


def in_interval(points: DataFrame, intervals: DataFrame, at: str, start: str, end: str, width: int) -> DataFrame:
    """Points with the intervals ``[start, end)`` that hold them, through bins of ``width``."""
    p = points.withColumn("_bin", F.floor(F.col(at) / width))
    bins = F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width))
    i = intervals.where(F.col(end) > F.col(start)).withColumn("_bin", F.explode(bins))
    return p.join(i, "_bin").where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("_bin")


def semi_any(df: DataFrame, arms: list[tuple[str, DataFrame]]) -> DataFrame:
    """Rows that match in any arm ``(column of df, keys)``: a disjunction of EXISTS. Each arm is a left
    join with its distinct keys that sets a flag, so rows are neither multiplied nor folded."""
    out, flags = df, []
    for i, (column, keys) in enumerate(arms):
        key, flag = f"_key{i}", f"_arm{i}"
        distinct = keys.select(F.col(keys.columns[0]).alias(key)).where(F.col(key).isNotNull()).distinct().withColumn(flag, F.lit(True))
        out = out.join(distinct, F.col(column) == F.col(key), "left")
        flags.append(F.coalesce(flag, F.lit(False)))
    return out.where(reduce(Column.__or__, flags)).select(*df.columns)


def unique_keys(df: DataFrame, key: str, target: str) -> DataFrame:
    """``key, target`` for keys that name exactly one target; a key that names several names none."""
    return df.groupBy(key).agg(F.count_distinct(target).alias("_n"), F.min(target).alias(target)).where("_n = 1").drop("_n")


def both_directions(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """Edges as ``node, neighbour, direction``, each from both ends."""
    out = edges.select(F.col(src).alias("node"), F.col(dst).alias("neighbour"), F.lit("out").alias("direction"))
    return out.unionByName(edges.select(F.col(dst).alias("node"), F.col(src).alias("neighbour"), F.lit("in").alias("direction")))


def merge_rows(old: DataFrame, new: DataFrame, key: str, keep: list[str], take: list[str]) -> DataFrame:
    """Upsert: of ``keep`` the old value where there is one, of ``take`` the new one; with ``change``
    (inserted, updated or kept)."""
    o = old.select(key, *keep, *take, F.lit(True).alias("_old"))
    n = new.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in keep + take], F.lit(True).alias("_new"))
    joined = o.join(n, F.col(key) == F.col("_key"), "full_outer")
    change = F.when(F.col("_old").isNull(), "inserted").when(F.col("_new").isNull(), "kept").otherwise("updated")
    first: list[Column] = [F.coalesce(key, "_key").alias(key)]
    return joined.select(*first, *[F.coalesce(c, f"_{c}").alias(c) for c in keep], *[F.coalesce(f"_{c}", c).alias(c) for c in take], change.alias("change"))
