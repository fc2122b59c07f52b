"""Clusters of rows that share targets."""

from __future__ import annotations

import uuid
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from florilege.session import shared_folder


def shared_target_clusters(edges: DataFrame, left: str, right: str) -> DataFrame:
    """``left, cluster``: the smallest ``left`` reachable through shared ``right`` values.

    Labels go from rows to targets and back by minima, so a target that many rows share makes no
    pairs; labels jump to their own label's label, so rounds stay few on long chains. The rounds end when
    no label changes. Each is written to the shared folder.
    """
    spark = edges.sparkSession
    root = f"{shared_folder(spark)}/clusters-{uuid.uuid4().hex}"

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{root}/{name}")
        return spark.read.schema(df.schema).parquet(f"{root}/{name}")

    e = kept(edges.select(F.col(left).alias("l"), F.col(right).alias("r")).distinct(), "edges")
    labels = e.select("l").distinct().withColumn("c", F.col("l"))
    for turn in count():
        targets = e.join(labels, "l").groupBy("r").agg(F.min("c").alias("c"))
        new = e.join(targets, "r").groupBy("l").agg(F.min("c").alias("n"))
        jumped = new.join(new.select(F.col("l").alias("n"), F.col("n").alias("j")), "n", "left")
        step = labels.join(jumped.select("l", F.coalesce("j", "n").alias("n")), "l").select("l", F.least("c", "n").alias("c"), (F.col("c") > F.col("n")).alias("moved"))
        step = kept(step, f"labels-{turn}")
        labels = step.select("l", "c")
        if step.where("moved").isEmpty():
            break
    return labels.select(F.col("l").alias(left), F.col("c").alias("cluster"))
