"""Amendment notes made of order lines, read back, and asked for a day."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from florilege.operators import amendments
from florilege.plans.catalog import Tables, query

#: Each order is a provision; each of its lines an entry of its note. A line of status F names its act as ibid
#: if the line before it has no such status, a quantity that seven divides leaves the day out.
ENTRIES = """
numbered AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem),
entries AS (SELECT l_orderkey, n, CASE l_returnflag WHEN 'A' THEN 'inserted' WHEN 'R' THEN 'omitted' ELSE 'substituted' END AS event,
  l_linestatus = 'F' AND n % 2 = 0 AS ibid, l_suppkey % 900 + 1 AS no, 1950 + l_partkey % 70 AS yr, l_partkey % 40 + 1 AS sec, CASE WHEN l_quantity::INT % 7 <> 0 THEN l_shipdate::DATE END AS effective FROM numbered),
read AS (SELECT *, last_value(CASE WHEN NOT ibid THEN n END IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS src FROM entries),
events AS (SELECT r.l_orderkey, r.n AS ordinal, r.event, e.no AS act_number, e.yr AS act_year, r.sec::VARCHAR AS section, r.effective, CASE WHEN r.ibid THEN 'resolved' END AS ibid
  FROM read r JOIN entries e ON e.l_orderkey = r.l_orderkey AND e.n = r.src)"""


def events(t: Tables, fields: tuple[str, ...] = tuple(amendments.FIELDS)) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    line = t.lineitem.withColumn("n", F.row_number().over(order))
    verb = F.when(F.col("l_returnflag") == "A", "Ins.").when(F.col("l_returnflag") == "R", 'The words "or any other" omitted').otherwise("Subs.")
    section = F.concat(F.lit("s. "), (F.col("l_partkey") % 40 + 1).cast("string"))
    named = F.concat(F.lit("Act "), (F.col("l_suppkey") % 900 + 1).cast("string"), F.lit(" of "), (F.lit(1950) + F.col("l_partkey") % 70).cast("string"))
    by = F.when((F.col("l_linestatus") == "F") & (F.col("n") % 2 == 0), F.concat(section, F.lit(", ibid ."))).otherwise(F.concat(named, F.lit(", "), section))
    day = F.when(F.col("l_quantity").cast("int") % 7 != 0, F.concat(F.lit(" (w.e.f. "), F.date_format("l_shipdate", "d- M-yyyy"), F.lit(")"))).otherwise("")
    entry = F.concat(F.col("n").cast("string"), F.lit(". "), verb, F.lit(" by "), by, day, F.lit("."))
    # an order has a few lines
    notes = line.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", entry.alias("e")))), lambda s: s["e"]), " ").alias("note"))
    return amendments.events(notes, "note", fields)


@query("ref_amendment_events", f"WITH {ENTRIES} SELECT l_orderkey, ordinal, event, act_number, act_year, section, effective, ibid FROM events")
def amendment_events(t: Tables) -> DataFrame:
    """Notes composed of order lines, read entry by entry; the SQL has the events from the columns."""
    return events(t).select("l_orderkey", F.col("ordinal").cast("long").alias("ordinal"), "event", F.col("act_number").cast("long").alias("act_number"), F.col("act_year").cast("long").alias("act_year"), "section", "effective", "ibid")


VERSIONS = f"""{ENTRIES},
daily AS (SELECT l_orderkey, effective AS valid_from, count(*) AS n_events, max(CASE WHEN event = 'omitted' THEN ordinal END) AS e, max(CASE WHEN event <> 'omitted' THEN ordinal END) AS b FROM events WHERE effective IS NOT NULL GROUP BY 1, 2),
versions AS (SELECT l_orderkey, row_number() OVER w AS version, valid_from, lead(valid_from) OVER w - 1 AS valid_to, CASE WHEN coalesce(e, -1) > coalesce(b, -1) THEN 'out' ELSE 'in' END AS standing, n_events
  FROM daily WINDOW w AS (PARTITION BY l_orderkey ORDER BY valid_from))"""


@query("ref_amendment_intervals", f"WITH {VERSIONS} SELECT * FROM versions")
def amendment_intervals(t: Tables) -> DataFrame:
    return amendments.intervals(events(t, amendments.DATED), ["l_orderkey"]).withColumn("version", F.col("version").cast("long"))


@query("ref_provision_in_force", f"""
WITH {VERSIONS} SELECT o_orderkey, coalesce(version, 0) AS version, coalesce(standing, 'in') AS standing FROM orders LEFT JOIN versions ON l_orderkey = o_orderkey AND o_orderdate::DATE + 60 BETWEEN valid_from AND coalesce(valid_to, DATE '9999-12-31')""")
def provision_in_force(t: Tables) -> DataFrame:
    """Which version of each provision holds sixty days after its order."""
    versions = amendments.intervals(events(t, amendments.DATED).withColumnRenamed("l_orderkey", "o_orderkey"), ["o_orderkey"])
    asked = t.orders.select("o_orderkey", F.date_add(F.col("o_orderdate").cast("date"), 60).alias("day"))
    return amendments.in_force(asked, ["o_orderkey"], F.col("day"), versions).select("o_orderkey", F.col("version").cast("long").alias("version"), "standing")
