"""References resolved to targets: seven states of a reference, edges resolved anew, effects from status and edges.

A reference is refused before it is looked up if its key cannot be one. A key that one target holds is ``UNIQUE``
only if what was looked through was whole: where the index has not read all of the target's cohort, or the corpus
holds less of it than is declared, another target may exist, and the match stays unconfirmed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from florilege.functions.text import lookup_key

STATES = ("REFUSED", "TARGET_NOT_HELD", "AMBIGUOUS", "SELF_REFERENCE", "UNIQUE_UNCONFIRMED_STALE_INDEX", "UNIQUE_UNCONFIRMED_COHORT", "UNIQUE")
LEAST_KEY, MOST_KEY = 6, 40


def refusal(raw: Column) -> Column:
    """Why ``raw`` cannot be a reference; null if it can."""
    key = lookup_key(raw)
    return (
        F.when(F.trim(F.coalesce(raw, F.lit(""))) == "", "empty").when(F.length(key) < LEAST_KEY, "short").when(F.length(key) > MOST_KEY, "long")
        .when(~key.rlike("[0-9]"), "no digit").when(~key.rlike("[A-Z]"), "no letter")
    )


def _apart(key: Column, columns: list[str]) -> Column:
    """``key``, and for rows without one a value of their own that no key is, so that they are no hot group of the join."""
    return F.coalesce(key, F.concat(F.lit("?"), F.xxhash64(*columns).cast("string")))


def resolve(references: DataFrame, raw: str, own: str, index: DataFrame, cohorts: DataFrame) -> DataFrame:
    """``references`` with ``state`` and ``target``. ``index``: ``key, target, cohort``; ``cohorts``: ``cohort,
    declared, held, unread``; ``own``: the column of the row that refers."""
    keys = index.groupBy("key").agg(F.count_distinct("target").alias("_n"), F.min("target").alias("_target"), F.min("cohort").alias("_cohort"))
    asked = references.withColumns({"_why": refusal(F.col(raw)), "_key": _apart(F.when(refusal(F.col(raw)).isNull(), lookup_key(F.col(raw))), references.columns)})
    found = asked.join(keys, F.col("_key") == F.col("key"), "left").join(cohorts.select(F.col("cohort").alias("_c"), "declared", "held", "unread"), F.col("_cohort") == F.col("_c"), "left")
    state = (
        F.when(F.col("_why").isNotNull(), "REFUSED").when(F.col("_n").isNull(), "TARGET_NOT_HELD").when(F.col("_n") > 1, "AMBIGUOUS").when(F.col("_target") == F.col(own), "SELF_REFERENCE")
        .when(F.coalesce(F.col("unread") > 0, F.lit(True)), "UNIQUE_UNCONFIRMED_STALE_INDEX").when(F.col("held") < F.col("declared"), "UNIQUE_UNCONFIRMED_COHORT").otherwise("UNIQUE")
    )
    target = F.when(F.col("state").isin("UNIQUE", "UNIQUE_UNCONFIRMED_STALE_INDEX", "UNIQUE_UNCONFIRMED_COHORT"), F.col("_target"))
    return found.withColumn("state", state).withColumn("target", target).select(*references.columns, "state", "target")


def reresolve(edges: DataFrame, index: DataFrame) -> DataFrame:
    """``edges`` (``source, cited, target``) with ``verdict`` and the ``target`` they now have. A target that
    is there stays, whatever the index says. Others get the one target of their key if the year printed in
    the citation is among the target's ``years`` and the target is not the source. ``index``: ``key, target, years``."""
    # nothing grows with the targets of a key: years count only where there is one target, and its years are a set
    one = index.groupBy("key", "target").agg(F.array_distinct(F.flatten(F.collect_set("years"))).alias("_y"))
    single = F.min("target") == F.max("target")
    keys = one.groupBy("key").agg(F.when(single | F.max("target").isNull(), F.count("target")).otherwise(2).cast("long").alias("_n"), F.min("target").alias("_found"), F.when(single, F.min("_y")).alias("_years"))
    year = F.regexp_extract("cited", r"(1[89][0-9]{2}|20[0-9]{2})", 1)
    own = F.when(F.col("target").isNull() & (F.col("cited") != ""), lookup_key(F.col("cited")))
    asked = edges.withColumn("_key", _apart(own, edges.columns)).withColumn("_year", F.when(year != "", year.cast("int")))
    found = asked.join(keys, F.col("_key") == F.col("key"), "left")
    verdict = (
        F.when(F.col("target").isNotNull(), "kept").when(F.coalesce(F.col("cited"), F.lit("")) == "", "cites_nothing").when(F.col("_n").isNull(), "not_held").when(F.col("_n") > 1, "several_targets")
        .when(F.col("_year").isNull(), "no_year").when(~F.array_contains("_years", F.col("_year")), "year_guard").when(F.col("_found") == F.col("source"), "self_reference").otherwise("resolved")
    )
    now = F.when(F.col("verdict") == "resolved", F.col("_found")).otherwise(F.col("target"))
    return found.withColumn("verdict", verdict).withColumn("_now", now).select(*[c for c in edges.columns if c != "target"], F.col("_now").alias("target"), "verdict")


def in_time(day: Column, year: Column, enacted: Column, act_year: Column) -> Column:
    """Whether a document can refer to an act: by days where both are known, else by years."""
    return F.when(day.isNotNull() & enacted.isNotNull(), day >= enacted).otherwise(F.coalesce(year, F.year(day)) >= F.coalesce(act_year, F.year(enacted)))


#: Treatments on edges, strongest first, with the effect each speaks for; and the status that matches it.
EDGE_EFFECTS = {"overruled": "set_aside", "overruled_in_part": "partly_set_aside", "doubted": "doubted"}
STATUS_RANK = {"set_aside": 1, "partly_set_aside": 2, "doubted": 3}


def effects(targets: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """``key, effect`` from ``key, status`` and edges ``key, relationship, defect``.

    Status ``none`` has no effect, whatever edges say. Edges with a known defect drive nothing; if all adverse
    edges have one, a status that rests on them is ``evidence_defect``. A status without adverse edges is taken
    at its word. Else the strongest edge speaks, unless it is weaker than the status: that is for review.
    """
    rank = F.lit(None).cast("int")
    for i, name in enumerate(EDGE_EFFECTS, 1):
        rank = F.when(F.col("relationship") == name, i).otherwise(rank)
    adverse = edges.withColumn("_rank", rank).where("_rank is not null")
    best = adverse.groupBy(F.col(key).alias("_k")).agg(F.min(F.when(~F.col("defect"), F.col("_rank"))).alias("_best"))
    joined = targets.join(best, F.col(key) == F.col("_k"), "left")
    stored, from_edge = F.lit(3), F.lit(None).cast("string")
    for status, n in STATUS_RANK.items():
        stored = F.when(F.col("status") == status, n).otherwise(stored)
    for i, effect in enumerate(EDGE_EFFECTS.values(), 1):
        from_edge = F.when(F.col("_best") == i, effect).otherwise(from_edge)
    word = F.when(F.col("status").isin("set_aside", "partly_set_aside"), F.col("status")).otherwise("doubted")
    effect = F.when(F.col("status") == "none", "none").when(F.col("_k").isNotNull() & F.col("_best").isNull(), "evidence_defect").when(F.col("_best").isNull(), word).when(F.col("_best") > stored, "review_required").otherwise(from_edge)
    return joined.select(key, effect.alias("effect"))
