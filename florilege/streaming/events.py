"""Structured Streaming forms of the incremental operators.

Each takes a streaming DataFrame with an event-time column and returns one; :func:`run_available`
runs it over all that is there now, with its checkpoint in the shared folder, and returns what it
wrote. Watermarks bound the state: late rows beyond them are dropped by Spark, and
:func:`split_late` keeps them aside.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, schema: str = EVENTS) -> DataFrame:
    """A stream over the Parquet files of a table; ``ts`` as a timestamp, which watermarks need."""
    stream = spark.readStream.schema(schema).parquet(path)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(stream: DataFrame, size: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums by window and event type, tumbling or sliding."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    out = stream.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(stream: DataFrame, gap: str, late: str = "10 minutes") -> DataFrame:
    """Sessions of a user: activity without a pause of ``gap``."""
    out = stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("session_window.start").alias("start"), "user_id", "n")


def first_of(stream: DataFrame, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """The first row of each key within the watermark: idempotent delivery."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def _project(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
    last = state.get[0] if state.exists else None
    out = []
    for event_id, kind in zip(rows["event_id"], rows["event_type"], strict=True):
        name = "LISTED" if last is None else "DISPOSED" if kind == "purchase" else "CHANGED" if kind != last else "CONFIRMED"
        out.append((key[0], event_id, name))
        last = kind
    state.update((last,))
    yield pd.DataFrame(out, columns=["user_id", "event_id", "projection"])


def projections(stream: DataFrame) -> DataFrame:
    """An append-only log to projections, with the last value of each user as state. Rows of one
    micro-batch are put in event-time order first."""
    return stream.groupBy("user_id").applyInPandasWithState(_project, "user_id long, event_id long, projection string", "last string", "append", GroupStateTimeout.NoTimeout)


def run_available(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Run ``stream`` over what is there and read back what it wrote under ``folder``."""
    root = f"{folder.rstrip('/')}/stream-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{root}/out")


def split_late(batch: DataFrame, frontier: str, ids: str = "event_id") -> tuple[DataFrame, DataFrame]:
    """(rows at or above ``frontier``, rows below it): late rows for a dirty set."""
    limit = F.lit(frontier).cast("timestamp")
    return batch.where(F.col("ts") >= limit), batch.where(F.col("ts") < limit).select(ids)
