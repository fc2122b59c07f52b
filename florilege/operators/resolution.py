"""Resolving what documents refer to: identities under several keys, collisions, rates, links behind a gate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def identities(df: DataFrame, target: str, tiers: list[tuple[str, Column]]) -> DataFrame:
    """``key, target, tier``: every key a row answers to, with the number of its tier. A tier is a name
    and an array of keys; null arrays and null or empty keys name nothing."""
    arms = [df.select(F.explode(keys).alias("key"), target, F.lit(i).alias("tier")) for i, (_, keys) in enumerate(tiers)]
    return reduce(DataFrame.unionByName, arms).where("key <> ''").groupBy("key", target).agg(F.min("tier").alias("tier"))


def match_identity(asked: DataFrame, key: str, df: DataFrame, target: str, tiers: list[tuple[str, Column]]) -> DataFrame:
    """``key, target, by``: rows that answer to an asked key under any tier, once, with the name of the
    strongest one. One join over all tiers instead of a disjunction, which would be a nested loop."""
    wanted = asked.select(F.col(key).alias("key")).where(F.col(key).isNotNull()).distinct()
    names = F.array(*[F.lit(name) for name, _ in tiers])
    return identities(df, target, tiers).join(wanted, "key").select(F.col("key").alias(key), target, F.get(names, F.col("tier")).alias("by"))


def split_collisions(candidates: DataFrame, target: str, key: str) -> DataFrame:
    """``candidates`` with ``collided``: the target is claimed under more than one key. Candidates of one
    target may be a third of all, so the keys are counted first and joined back; a null target stands
    for itself."""
    counts = candidates.groupBy(F.col(target).alias("_target")).agg((F.count_distinct(key) > 1).alias("collided"))
    return candidates.join(counts, F.col(target).eqNullSafe(F.col("_target"))).drop("_target")


def resolver_rates(results: DataFrame, state: str) -> DataFrame:
    """One row of counts by state, and rates over the references that were not refused (0 without any)."""
    of = lambda name: F.count_if(F.col(state) == name)
    row = results.agg(F.count(F.lit(1)).alias("n"), of("REFUSED").alias("refused"), of("UNIQUE").alias("found"), of("AMBIGUOUS").alias("ambiguous"), of("TARGET_NOT_HELD").alias("not_held"), of("SELF_REFERENCE").alias("self_reference"))
    formed = F.col("n") - F.col("refused")
    over = lambda c: F.when(formed == 0, 0.0).otherwise(c / formed)
    return row.select("*", formed.alias("formed"), over(F.col("found") + F.col("ambiguous")).alias("hit_rate"), over(F.col("found")).alias("found_rate"), over(F.col("ambiguous")).alias("ambiguous_rate"), over(F.col("not_held")).alias("not_held_rate"))


def linked(links: DataFrame, source: str, document: str, tier: str, shown: Column) -> DataFrame:
    """``source, tier, shown, withheld``: documents linked to a source, each under its strongest (smallest)
    tier, and how many of them the gate ``shown`` withholds. A null gate withholds."""
    each = links.groupBy(source, document).agg(F.min(tier).alias("tier"), F.bool_and(F.coalesce(shown, F.lit(False))).alias("_shown"))
    return each.groupBy(source, "tier").agg(F.count_if("_shown").alias("shown"), F.count_if(~F.col("_shown")).alias("withheld"))


def seeded(keys: Column, seed: int) -> Column:
    """A number in [0, 1) from a key and a seed, the same on every run and partitioning."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), keys.cast("string"))), 1, 8), 16, 10).cast("double") / float(1 << 32)


def sample_rows(df: DataFrame, key: str, fraction: float, seed: int) -> DataFrame:
    """Each row with probability ``fraction``; equal keys go or stay together, null keys too."""
    return df.where(seeded(F.coalesce(F.col(key).cast("string"), F.lit("")), seed) < fraction)


def sample_blocks(df: DataFrame, key: str, size: int, fraction: float, seed: int) -> DataFrame:
    """Whole blocks of ``size`` consecutive keys, each with probability ``fraction``; null keys go."""
    return df.where(seeded(F.floor(F.col(key) / size), seed) < fraction)
