"""Fielded boolean search over tables: conditions of many queries against the fields of many rows.

A query is its conditions, rows of ``query_id, cond_no, field, op, value, upto, negated``, all of which have to
hold, so nothing is parsed and any number of queries is one plan. An inverted index from (field, key) to rows
answers them by equi-joins:

* ``is``: the whole value, as a key (upper case, letters and digits);
* ``word``: a word of the value; ``prefix``: the beginning of a word, of ``HEAD`` characters or more;
* ``caseno``: a case number; with a type it has to agree, without one serial and year do;
* ``between``: a day, both ends included; days meet by month.

A query of negations only is refused, and one that matches nothing says so; neither is answered by something
else.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from florilege.functions.text import lookup_key, tokens
from florilege.session import shared_folder

FIELDS = ("party", "judge", "cite", "caseno", "cnr", "court", "date", "act", "section", "type", "text")
#: Fields that are searched by word; the others by their whole value.
WORDED = ("party", "judge", "text")
HEAD = 3

_SHAPE = r"^(.*)/([0-9]{1,7})/((?:19|20)[0-9]{2})$"


def case_number(value: Column) -> Column:
    """``kind, serial, year`` of a case number in any of its printed forms (``W.P. 12 of 2001``, ``WP/12/2001``,
    ``WP-12-2001``, ``/12/2001``); null for anything else, such as a bare ``12/2001``."""
    flat = F.regexp_replace(F.upper(F.trim(value)), r"[\s/-]+(?:OF[\s/-]+)?", "/")
    kind = F.regexp_replace(F.regexp_extract(flat, _SHAPE, 1), "[^A-Z0-9]", "")
    anchored = F.startswith(flat, F.lit("/"))
    shaped = flat.rlike(_SHAPE) & ~kind.rlike("^[0-9]+$") & ((kind != "") | anchored)
    return F.when(shaped, F.struct(kind.alias("kind"), F.regexp_extract(flat, _SHAPE, 2).cast("long").alias("serial"), F.regexp_extract(flat, _SHAPE, 3).cast("int").alias("year")))


def _month(day: Column) -> Column:
    return F.date_format(day, "yyyyMM")


def index(rows: DataFrame, row_id: str) -> DataFrame:
    """``row_id, field, key, head, day``: an entry for each word or value of each of ``FIELDS`` that ``rows`` has."""
    none = F.lit(None)
    entry = lambda field, key, head=none, day=none: F.struct(F.lit(field).alias("field"), key.alias("key"), head.cast("string").alias("head"), day.cast("date").alias("day"))
    worded = lambda field, c: F.transform(F.array_distinct(tokens(c)), lambda w: entry(field, w, F.left(w, F.lit(HEAD))))
    parts = []
    for field in [f for f in FIELDS if f in rows.columns]:
        c = F.col(field)
        if field in WORDED:
            parts.append(worded(field, c))
        elif field == "date":
            parts.append(F.when(c.isNotNull(), F.array(entry(field, _month(c), day=c))))
        elif field == "caseno":
            n = case_number(c)
            tail = F.concat_ws("/", n["serial"].cast("string"), n["year"].cast("string"))
            parts.append(F.when(n.isNotNull(), F.array(entry(field, F.concat(F.lit("/"), tail)), entry(field, F.concat_ws("/", n["kind"], tail)))))
        else:
            parts.append(F.when(c.isNotNull(), F.array(entry(field, lookup_key(c)))))
    filled = [F.coalesce(p, F.array().cast("array<struct<field:string,key:string,head:string,day:date>>")) for p in parts]
    return rows.select(row_id, F.explode(F.concat(*filled)).alias("e")).select(row_id, "e.*")


def _keys(conditions: DataFrame) -> DataFrame:
    """The conditions with the key, or the keys, that they ask the index for."""
    value, op = F.col("value"), F.col("op")
    n = case_number(value)
    number = F.when(n.isNotNull(), F.concat(F.when(n["kind"] == "", F.lit("/")).otherwise(F.concat(n["kind"], F.lit("/"))), n["serial"].cast("string"), F.lit("/"), n["year"].cast("string")))
    first, last = F.try_to_date(value), F.try_to_date("upto")
    months = F.when(first <= last, F.transform(F.sequence(F.trunc(first, "month"), last, F.expr("interval 1 month")), _month))
    key = F.when(op == "is", F.array(lookup_key(value))).when(op == "word", F.array(F.lower(value))).when(op == "prefix", F.array(F.left(F.lower(value), F.lit(HEAD)))).when(op == "caseno", F.array(number)).when(op == "between", months)
    return conditions.withColumns({"_first": first, "_last": last}).select("*", F.explode(key).alias("_key")).where("_key is not null")


#: Conditions are broadcast to the index up to so many keys, sets of them and queries up to so many rows.
BROADCAST_KEYS = 200_000


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_KEYS else df


def _matched(entries: DataFrame, row_id: str, conditions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``_set, row_id`` of the rows that meet a set of conditions, and ``query_id, _set``.

    Queries that ask for the same are one set, and conditions that many queries share are met once. A row
    knows the conditions that it meets; it is a candidate of the sets whose rarest condition it meets, and no others.
    """
    shared = ["field", "op", "value", "upto"]
    named = conditions.withColumn("_cond", F.xxhash64(F.to_json(F.struct(*shared))))  # names keep nulls apart
    asked = _keys(named.select(*shared, "_cond").distinct())
    # one pass over the index: an entry is asked for by its key, and by its head
    ways = F.array(F.struct(F.lit(False).alias("by_head"), F.col("key").alias("_key")), F.struct(F.lit(True).alias("by_head"), F.col("head").alias("_key")))
    each = entries.select(row_id, "field", F.col("key").alias("_word"), "day", F.explode(ways).alias("w")).select("*", "w.*").drop("w").where("_key is not null")
    pairs = each.join(_small(asked.withColumn("by_head", F.col("op") == "prefix")), ["field", "by_head", "_key"])
    begun = F.startswith(F.col("_word"), F.lower(F.col("value"))) & (F.length("value") >= HEAD)
    held = F.when(F.col("op") == "prefix", begun).when(F.col("op") == "between", F.col("day").between(F.col("_first"), F.col("_last"))).otherwise(True)
    met = pairs.where(held).select("_cond", row_id)
    rows = met.groupBy(row_id).agg(F.collect_set("_cond").alias("_met"))
    path = f"{shared_folder(entries.sparkSession)}/fielded-{uuid.uuid4().hex}"
    rows.write.parquet(path)  # read twice: for the rarest conditions, and for candidates
    rows = entries.sparkSession.read.schema(rows.schema).parquet(path)

    several = lambda negated: F.sort_array(F.collect_set(F.when(F.col("negated") == F.lit(negated), F.col("_cond"))))
    queries = named.groupBy("query_id").agg(several(False).alias("_all"), several(True).alias("_none")).where(F.size("_all") > 0).withColumn("_set", F.xxhash64(F.size("_all"), "_all", "_none"))
    sets = queries.groupBy("_set").agg(F.first("_all").alias("_all"), F.first("_none").alias("_none"))
    often = _small(rows.select(F.explode("_met").alias("_c")).groupBy("_c").agg(F.count(F.lit(1)).alias("_n")))
    each = sets.select("_set", F.explode("_all").alias("_c")).join(often, "_c", "left")
    rarest = each.groupBy("_set").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_c").alias("c")))["c"].alias("_rarest"))
    held = rows.select(row_id, "_met", F.explode("_met").alias("_rarest")).join(_small(sets.join(rarest, "_set")), "_rarest")
    found = held.where((F.size(F.array_except("_all", "_met")) == 0) & ~F.arrays_overlap("_none", "_met"))
    return found.select("_set", row_id), queries.select("query_id", "_set")


def search(entries: DataFrame, row_id: str, conditions: DataFrame) -> DataFrame:
    """``query_id, row_id`` of each row that meets all conditions of a query."""
    found, queries = _matched(entries, row_id, conditions)
    return found.join(_small(queries), "_set").select("query_id", row_id)


def counts(entries: DataFrame, row_id: str, conditions: DataFrame) -> DataFrame:
    """``query_id, n``: how many rows :func:`search` finds, where it finds any. Rows are counted by set."""
    found, queries = _matched(entries, row_id, conditions)
    return queries.join(found.groupBy("_set").agg(F.count(F.lit(1)).alias("n")), "_set").select("query_id", "n")


def outcomes(conditions: DataFrame, found: DataFrame) -> DataFrame:
    """``query_id, outcome, n``: ``refused`` (negations only), ``no_match`` or ``matched``."""
    return named(conditions, found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")))


def named(conditions: DataFrame, counted: DataFrame) -> DataFrame:
    """:func:`outcomes` from :func:`counts`."""
    asked = conditions.groupBy("query_id").agg(F.bool_and("negated").alias("_none"))
    n = F.coalesce("n", F.lit(0))
    return asked.join(counted, "query_id", "left").select("query_id", F.when(F.col("_none"), "refused").when(n == 0, "no_match").otherwise("matched").alias("outcome"), n.alias("n"))
