"""The corpus pipeline: from raw documents to balanced shards of a mixed, clean corpus.

Each stage works on all that the stage before it kept, and its result is written to the shared
folder and read again, so a lost executor costs one stage at most. A table goes once the stage that
reads it is written.

* language ID keeps documents in a language learned from the corpus; those without letters, or that
  no learned language explains, go;
* the Jaccard join keeps one row (smallest id, null ids last) of each group of near copies;
* decontamination drops documents that hold benchmark passages;
* mixing repeats or drops documents until sources meet their target weights;
* sharding deals the mix into shards of equal counts with copies of a text together.

All stages but the last return the columns of ``documents``; the last returns the columns of the
sharding operator.

Defined results, in every stage: a null, empty or blank text goes with the first stage, as it has no
letter; a null id is kept and judged by its text; a null source is a source of its own; repeated rows
are near copies, of which one stays; extra columns come along to the last stage but one, whatever
their names; texts of any length are taken whole; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from florilege.llm import decontamination, jaccard_join, language_id, mixing, sharding
from florilege.llm.scratch import Scratch


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_known(docs)


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_first(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard(docs)


STAGES = [
    ("language_id", language_stage),
    ("jaccard_join", near_copy_stage),
    ("decontamination", benchmark_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: The language model and the graph stages are not expressible in SQL; tests hold run() against a
#: brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for before, (name, stage) in zip([None, *(name for name, _ in STAGES)], STAGES, strict=False):
        docs = scratch.write(stage(spark, docs, sf_dir), name)
        if before:
            scratch.drop(before)
    return docs
