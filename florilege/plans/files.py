"""Files written and read back: partitions, JSON checkpoints, ordered exports, a ledger that clears."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from florilege.plans.catalog import Tables, query
from florilege.session import shared_folder
from florilege.sources import tables as files


def folder(t: Tables, name: str) -> str:
    return f"{shared_folder(t.spark)}/{name}-{uuid.uuid4().hex}"


@query("source_partition_scan", "SELECT o_orderkey, o_orderpriority, year(o_orderdate) AS year FROM orders WHERE year(o_orderdate) = 1996 AND o_orderstatus = 'F'")
def partition_scan(t: Tables) -> DataFrame:
    """Orders written by year and status, of which one partition is listed and read."""
    at = folder(t, "partitions")
    files.write_by(t.orders.select("o_orderkey", "o_orderpriority", F.year("o_orderdate").alias("year"), F.col("o_orderstatus").alias("status")), at, ["year", "status"])
    return files.partitioned(t.spark, at, year=1996, status="F").select("o_orderkey", "o_orderpriority", "year")


@query("source_json_checkpoint", """
SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events WHERE event_id % 13 <> 0 AND user_id IS NOT NULL GROUP BY 1""")
def json_checkpoint(t: Tables) -> DataFrame:
    """Events as JSON lines, every thirteenth cut off; of each user the last line that can be read."""
    at = folder(t, "checkpoint")
    line = F.to_json(F.struct("user_id", "event_id", "event_type", "value"))
    cut = F.when(F.col("event_id") % 13 == 0, F.substring(line, F.lit(1), F.length(line) - 6)).otherwise(line)
    t.events.where("user_id IS NOT NULL").select(cut.alias("value")).write.text(at)
    return files.json_lines(t.spark, at, "user_id long, event_id long, event_type string, value double", "user_id", "event_id")


@query("sink_ordered_export", "SELECT doc_id, lang, source, text FROM documents")
def ordered_export(t: Tables) -> DataFrame:
    """Documents exported as CSV in the order of their ids and read back whole: quotes, line ends and nulls stay."""
    at = folder(t, "export")
    files.export_ordered(t.documents.select("doc_id", "lang", "source", "text"), at, ["doc_id"])
    return files.import_csv(t.spark, at, "doc_id long, lang string, source string, text string")


@query("sink_failure_ledger_cleared", """
WITH ok AS (SELECT user_id, max(event_id) AS done FROM events WHERE event_type = 'signup' GROUP BY 1)
SELECT e.user_id, count(*) AS attempts, arg_max(event_type, event_id) AS last_reason, count(*) >= 3 OR bool_or(event_type = 'purchase') AS permanent
FROM events e LEFT JOIN ok ON ok.user_id = e.user_id WHERE event_type IN ('error', 'purchase') AND (done IS NULL OR event_id > done) AND e.user_id IS NOT NULL GROUP BY 1""")
def failure_ledger_cleared(t: Tables) -> DataFrame:
    """Errors and purchases as failures, which a later signup clears."""
    timed = t.events.where("user_id IS NOT NULL").withColumn("at", F.col("event_id"))
    return files.failure_ledger(timed.where("event_type IN ('error', 'purchase')"), "user_id", "event_type", ("purchase",), succeeded=timed.where("event_type = 'signup'").select("user_id", "at"))
