"""When two rows may be one decision: strengths of identity as classes of equal keys, never as pairs.

A row has a registry number of its case (``cnr``), a citation, a court, a day, a case number and a caption; any
may be null, and a null agrees with nothing. The strengths, strongest first:

* ``CNR_EXACT``: registry number and day; ``CITATION_EXACT``: citation; these two may be acted upon;
* ``REGISTRY_STRONG``: court, day and case number;
* ``CAPTION_WEAK``: court, day and caption, with different case numbers: one order in many matters;
* ``SAME_CASE_ADJACENT_DATE``: registry number, days next to each other: one day is probably wrong;
* ``SAME_CASE_DIFFERENT_DATE``: registry number, days further apart: one case at two stages.

A class is counted, with the number of pairs that it stands for; members find their class by its key. So a key
that a third of all rows share costs what its rows cost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STRENGTHS = ("CNR_EXACT", "CITATION_EXACT", "REGISTRY_STRONG", "CAPTION_WEAK", "SAME_CASE_ADJACENT_DATE", "SAME_CASE_DIFFERENT_DATE")
PROMOTABLE = STRENGTHS[:2]

KEYS = {"CNR_EXACT": ["cnr", "day"], "CITATION_EXACT": ["citation"], "REGISTRY_STRONG": ["court", "day", "case_no"], "CAPTION_WEAK": ["court", "day", "caption"], "SAME_CASE_ADJACENT_DATE": ["cnr"], "SAME_CASE_DIFFERENT_DATE": ["cnr"]}


def plain(value: Column) -> Column:
    """What formatting leaves: upper case, letters and digits; null if nothing is left."""
    bare = F.upper(F.regexp_replace(value, "[^A-Za-z0-9]", ""))
    return F.when(bare != "", bare)


def _pairs(n: Column) -> Column:
    return (n * (n - 1) / 2).cast("long")


def _key(strength: str) -> Column:
    return F.concat_ws("|", *[F.col(k).cast("string") for k in KEYS[strength]])


def _held(strength: str) -> Column:
    held = F.lit(True)
    for k in KEYS[strength]:
        held = held & F.col(k).isNotNull()
    return held


def classes(rows: DataFrame) -> DataFrame:
    """``strength, class, members, links`` of each class that links any two rows."""
    n = F.count(F.lit(1)).alias("n")

    def equal(strength: str) -> DataFrame:
        return rows.where(_held(strength)).groupBy(_key(strength).alias("class")).agg(n).select(F.lit(strength).alias("strength"), "class", F.col("n").alias("members"), _pairs(F.col("n")).alias("links"))

    # rows of one caption: all pairs, less those of one case number; a row without one differs from all
    by_case = rows.where(_held("CAPTION_WEAK") & F.col("case_no").isNotNull()).groupBy(_key("CAPTION_WEAK").alias("class"), "case_no").agg(n)
    weak = by_case.groupBy("class").agg(F.sum("n").alias("members"), F.sum(_pairs(F.col("n"))).alias("_same"))
    weak = weak.select(F.lit("CAPTION_WEAK").alias("strength"), "class", "members", (_pairs(F.col("members")) - F.col("_same")).alias("links"))
    # a case by its days: what stands next to each day is one row away
    days = rows.where(_held("CNR_EXACT")).groupBy(F.col("cnr").cast("string").alias("class"), "day").agg(n)
    following = Window.partitionBy("class").orderBy("day")
    next_to = F.when(F.datediff(F.lead("day").over(following), F.col("day")) == 1, F.col("n") * F.lead("n").over(following)).otherwise(F.lit(0))
    cases = days.withColumn("_next", next_to).groupBy("class").agg(F.sum("n").alias("members"), F.sum(_pairs(F.col("n"))).alias("_same"), F.sum("_next").alias("_next"))
    adjacent = cases.select(F.lit("SAME_CASE_ADJACENT_DATE").alias("strength"), "class", "members", F.col("_next").cast("long").alias("links"))
    apart = cases.select(F.lit("SAME_CASE_DIFFERENT_DATE").alias("strength"), "class", "members", (_pairs(F.col("members")) - F.col("_same") - F.col("_next")).cast("long").alias("links"))
    every = equal("CNR_EXACT").unionByName(equal("CITATION_EXACT")).unionByName(equal("REGISTRY_STRONG")).unionByName(weak).unionByName(adjacent).unionByName(apart)
    return every.where("links > 0")


def strongest(rows: DataFrame, row_id: str, found: DataFrame) -> DataFrame:
    """``row_id, strength, class``: the strongest class of each row that any class holds. Membership of the two
    relations between days is that of the case."""
    keyed = F.explode(F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(s).alias("strength"), F.when(_held(s), _key(s)).alias("class")) for i, s in enumerate(STRENGTHS)])).alias("k")
    each = rows.select(row_id, keyed).select(row_id, "k.*").where("class is not null")
    held = each.join(found.select("strength", "class"), ["strength", "class"])
    best = held.groupBy(row_id).agg(F.min(F.struct("rank", "strength", "class")).alias("b"))
    return best.select(row_id, "b.strength", "b.class")
