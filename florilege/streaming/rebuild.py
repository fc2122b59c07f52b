"""Derived rows kept up to date by rebuilding what changes touch.

Changes are rows ``key, seq`` and whatever they carry; a row whose ``gone`` is true deletes its key. Each
micro-batch is kept as ``log/batch=n``; the keys it touches are the dirty set, and only their derived rows are
built anew, from all of the log up to that batch, into ``built/batch=n``. A key that is gone leaves a
row that says so. :func:`current` takes of each key what the last batch that touched it built.

A batch writes folders that its number names, over what is there: a batch that was killed half-way and
comes again leaves what one that ran once leaves. Nothing else is written or deleted, so no reader
sees half a rebuild; a batch counts once ``built/batch=n/_SUCCESS`` stands. Late changes (with a smaller ``seq`` than others of the key)
need nothing of their own, as a key is built from all its changes in their order.

:func:`freshness` says how far the built rows are behind: in rows, and in hours of event time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Derived rows of a key from its changes: gets and returns DataFrames with ``key``.
Build = Callable[[DataFrame], DataFrame]


def _there(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the batches under ``path`` that are whole."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/batch=*/_SUCCESS")
    found = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(place) or []
    return sorted(int(f.getPath().getParent().getName().partition("=")[2]) for f in found)


def log(spark: SparkSession, root: str, schema: str, upto: int | None = None) -> DataFrame:
    """The changes of all whole batches, or of those up to one."""
    known = [n for n in _there(spark, f"{root}/log") if upto is None or n <= upto]
    if not known:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{root}/log/batch={n}" for n in known])


def rebuild(changes: DataFrame, number: int, root: str, schema: str, build: Build) -> None:
    """One micro-batch: keep its changes, build the keys that they touch."""
    spark = changes.sparkSession
    changes.write.mode("overwrite").parquet(f"{root}/log/batch={number}")
    kept = spark.read.schema(schema).parquet(f"{root}/log/batch={number}")
    dirty = kept.select("key").distinct()
    touched = log(spark, root, schema, number).join(dirty, "key", "left_semi")
    last = touched.groupBy("key").agg(F.max_by("gone", "seq").alias("gone"))
    live = touched.join(last.where("not gone").select("key"), "key", "left_semi")
    built = last.select("key", "gone").join(build(live), "key", "left")
    built.write.mode("overwrite").parquet(f"{root}/built/batch={number}")


def run(stream: DataFrame, root: str, schema: str, build: Build) -> None:
    """Run over all changes that are there now; a second call goes on where the first one ended."""
    sink = lambda batch, number: rebuild(batch, number, root, schema, build)
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def current(spark: SparkSession, root: str) -> DataFrame:
    """The derived rows as they stand: of each key those of the last batch that touched it."""
    built = spark.read.option("basePath", f"{root}/built").option("mergeSchema", "true").parquet(*[f"{root}/built/batch={n}" for n in _there(spark, f"{root}/built")])
    last = built.groupBy("key").agg(F.max("batch").alias("batch"))
    return built.join(last, ["key", "batch"], "left_semi").where("not gone").drop("gone", "batch")


def compact(spark: SparkSession, root: str, to: str) -> None:
    """The current rows as one table at ``to``."""
    current(spark, root).write.mode("overwrite").parquet(to)


#: Behind by no more than so many rows and hours, derived rows count as current.
MOST_ROWS, MOST_HOURS = 0, 24.0


def freshness(changes: DataFrame, spark: SparkSession, root: str, schema: str, at: str) -> DataFrame:
    """``lag_rows, lag_hours, state``: how many of ``changes`` (all that there are) the built batches lack, and how
    far the newest built change is behind the newest of all, by the time ``at``. One row."""
    done = [n for n in _there(spark, f"{root}/built")]
    built = log(spark, root, schema, max(done) if done else -1).agg(F.count(F.lit(1)).alias("n"), F.max(at).alias("newest"))
    there = changes.agg(F.count(F.lit(1)).alias("all"), F.max(at).alias("last"))
    hours = (F.unix_micros(F.col("last").cast("timestamp")) - F.unix_micros(F.col("newest").cast("timestamp"))) / 3.6e9
    both = there.join(F.broadcast(built)).select((F.col("all") - F.col("n")).alias("lag_rows"), F.round(hours, 6).alias("lag_hours"))  # one row each
    state = F.when(F.col("lag_hours").isNull(), "UNKNOWN").when((F.col("lag_rows") <= MOST_ROWS) & (F.col("lag_hours") <= MOST_HOURS), "CURRENT").otherwise("STALE")
    return both.withColumn("state", state)
