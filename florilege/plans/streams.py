"""Streaming queries over the events table, run to the end of what is there."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from florilege.plans.catalog import Tables, query
from florilege.session import shared_folder
from florilege.streaming import events as ev
from florilege.streaming import rebuild


def folder(t: Tables) -> str:
    return shared_folder(t.spark)


def stream(t: Tables) -> DataFrame:
    return ev.read_events(t.spark, f"{t.sf_dir}/events.parque[t]")  # a glob, so that one file will do as well as a folder


@query("stream_projections", """
SELECT user_id, event_id, CASE WHEN previous IS NULL THEN 'LISTED' WHEN event_type = 'purchase' THEN 'DISPOSED' WHEN event_type <> previous THEN 'CHANGED' ELSE 'CONFIRMED' END AS projection FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events)""")
def projections(t: Tables) -> DataFrame:
    return ev.run_available(ev.projections(stream(t)), folder(t))


#: The windows that the watermark has closed at the end: those that end by the last event less 10 minutes.
CLOSED = "(SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"


@query("stream_tumbling_window", f"""
SELECT time_bucket(INTERVAL 15 MINUTE, ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2 HAVING time_bucket(INTERVAL 15 MINUTE, ts) + INTERVAL 15 MINUTE <= {CLOSED}""")
def tumbling(t: Tables) -> DataFrame:
    """Windows that the watermark has not closed are not written, so that none is written twice."""
    out = ev.run_available(ev.windowed(stream(t), "15 minutes"), folder(t))
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("stream_sliding_window", f"""
SELECT start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM (SELECT time_bucket(INTERVAL 30 MINUTE, ts) - back AS start, event_type, value FROM events, (VALUES (INTERVAL 0 MINUTE), (INTERVAL 30 MINUTE)) b(back)) GROUP BY 1, 2 HAVING start + INTERVAL 1 HOUR <= {CLOSED}""")
def sliding(t: Tables) -> DataFrame:
    out = ev.run_available(ev.windowed(stream(t), "1 hour", "30 minutes"), folder(t))
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("stream_sessions", f"""
WITH m AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens, row_number() OVER w AS rn FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY rn) AS session FROM m)
SELECT min(ts) AS start, user_id, count(*) AS n FROM s GROUP BY user_id, session HAVING max(ts) + INTERVAL 30 MINUTE <= {CLOSED}""")
def sessions(t: Tables) -> DataFrame:
    out = ev.run_available(ev.sessions(stream(t), "30 minutes"), folder(t))
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("stream_first_of", "SELECT DISTINCT user_id, event_type FROM events")
def first_of(t: Tables) -> DataFrame:
    return ev.run_available(ev.first_of(stream(t), ["user_id", "event_type"], "60 days").select("user_id", "event_type"), folder(t))


CHANGE = "key long, seq long, ts timestamp, kind string, value double, gone boolean"


def user_rows(changes: DataFrame) -> DataFrame:
    """Of each user the events counted, the last one, and what was bought."""
    return changes.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.max_by("kind", "seq").alias("last_kind"), F.round(F.sum(F.when(F.col("kind") == "purchase", F.col("value")).otherwise(0.0)), 2).alias("bought")
    )


def changes(t: Tables) -> tuple[DataFrame, DataFrame]:
    """The events as changes of users, as a table and as a stream of eight files; an error deletes its user until
    the next event. Every seventh event comes with the files of the day before it came."""
    gone = F.col("event_type") == "error"
    told = t.events.where("user_id IS NOT NULL").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("kind"), "value", gone.alias("gone"))
    root = f"{folder(t)}/changes-{uuid.uuid4().hex}"
    part = F.pmod(F.floor(F.col("seq") / 500) + F.when(F.col("seq") % 7 == 0, 3).otherwise(0), F.lit(8))
    told.repartition(8, part).write.parquet(root)
    return t.spark.read.schema(CHANGE).parquet(root), t.spark.readStream.schema(CHANGE).option("maxFilesPerTrigger", 1).parquet(root)


@query("stream_dirty_rebuild", """
SELECT user_id AS key, count(*) AS n, arg_max(event_type, event_id) AS last_kind, round(sum(CASE WHEN event_type = 'purchase' THEN value ELSE 0 END), 2) AS bought
FROM events WHERE user_id IS NOT NULL GROUP BY 1 HAVING arg_max(event_type, event_id) <> 'error'""")
def dirty_rebuild(t: Tables) -> DataFrame:
    """Derived rows after several micro-batches that each rebuild what they touch; the SQL builds them from nothing."""
    _, stream = changes(t)
    root = f"{folder(t)}/rebuild-{uuid.uuid4().hex}"
    rebuild.run(stream, root, CHANGE, user_rows)
    return rebuild.current(t.spark, root)


@query("incr_rebuild_freshness", """
WITH e AS (SELECT event_id, ts FROM events WHERE user_id IS NOT NULL), b AS (SELECT * FROM e WHERE event_id % 4 <> 3)
SELECT (SELECT count(*) FROM e) - (SELECT count(*) FROM b) AS lag_rows, round((SELECT epoch_us(max(ts)) FROM e) / 3.6e9 - (SELECT epoch_us(max(ts)) FROM b) / 3.6e9, 6) AS lag_hours,
  CASE WHEN (SELECT count(*) FROM b) = 0 THEN 'UNKNOWN' WHEN (SELECT count(*) FROM e) = (SELECT count(*) FROM b) THEN 'CURRENT' ELSE 'STALE' END AS state""")
def rebuild_freshness(t: Tables) -> DataFrame:
    """How far derived rows are behind that were built from three of four changes."""
    told, _ = changes(t)
    root = f"{folder(t)}/rebuild-{uuid.uuid4().hex}"
    rebuild.rebuild(told.where("seq % 4 <> 3"), 0, root, CHANGE, user_rows)
    return rebuild.freshness(told, t.spark, root, CHANGE, "ts")
