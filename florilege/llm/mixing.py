"""Mixing sources to target weights.

Tokens are summed per source; sources ordered by code point (null last) weigh 1, 2, 3, repeating,
and share the words of all sources by weight, except that a source is never asked for more than
three times what it holds; what it cannot give is shared anew among the others, by weight. The
rate of a source is its target over its size. Each document is emitted floor(rate) times, plus one
Bernoulli copy with a probability equal to the fraction: it draws a number from 0 to 1 by the MD5 of
its id, source, text and number among rows that are equal in these, and is copied if that lies below
the fraction.

Such draws leave a source of ``n`` documents off its target by some ``1 / sqrt(n)`` of it. So the
draws next to the fraction, within ``REPAIR / sqrt(n)``, are repaired: in the order of their numbers
they are copied until the words copied come nearest to what the target lacks. All other documents
keep their draw; a source of few documents lies within the reach as a whole. A rerun draws the same.

The numbers are a function of the row, so nothing is ranked but the few rows in reach. Only rows that
are equal in id, source and text need a number: they are counted by (row, partition of the written
input), and numbered within these, so that a third of all rows may be equal.

Defined results: a null text has size 0 and is emitted as others of its source are; a null source
is a source of its own; a source of size 0 has target 0 and nothing of it is emitted. Rows that
repeat, null ids among them, are drawn one by one. An empty table gives an empty result. :func:`mix` keeps all columns,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from florilege.llm.scratch import BROADCAST_ROWS, Scratch

WORD = r"[^\x20\x09-\x0D]+"
MOST_REPEATS = 3
WEIGHTS = 3
#: Draws within so many times ``1 / sqrt(documents of the source)`` of the fraction are repaired.
REPAIR = 8
#: Hex digits of a hash that make a draw: 52 bits, which a double holds.
DIGITS = 13


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame) -> DataFrame:
    """``_src, source_size, n, target`` from rows with ``_src`` and ``_size``. One row for each source.

    The windows without keys run over the sources, not the documents.
    """
    totals = sized.groupBy("_src").agg(F.sum("_size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    named = totals.withColumn("rn", F.row_number().over(Window.orderBy(F.col("_src").asc_nulls_last())))
    weighed = named.withColumns({"w": ((F.col("rn") - 1) % WEIGHTS + 1).cast("double"), "cap": (F.col("source_size") * MOST_REPEATS).cast("double")})
    filling = Window.orderBy(F.col("cap") / F.col("w"), "rn").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum(F.col("source_size").cast("double")).over(everything) - F.coalesce(F.sum("cap").over(filling), F.lit(0.0))
    share = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(filling), F.lit(0.0))
    levelled = weighed.withColumn("level", left / share)
    fits = F.when(F.col("level") <= F.col("cap") / F.col("w"), F.struct((F.col("cap") / F.col("w")).alias("r"), "rn", "level"))
    level = F.min(fits).over(everything)["level"]
    return levelled.withColumn("target", F.least("cap", level * F.col("w"))).select("_src", "source_size", "n", "target")


def _few(df: DataFrame) -> DataFrame:
    """``df``, a row for each source, with a broadcast hint while it has few rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _numbered(rows: DataFrame, several: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Add ``_no``: 0, 1, ... among rows of one ``_key``, in any order. ``several``: the keys of more rows
    than one."""
    if several.isEmpty():
        return rows.withColumn("_no", F.lit(0).cast("long"))
    parted = scratch.write(rows.withColumn("_part", F.spark_partition_id()), f"{name}-parted")
    marked = parted.join(_few(several), F.col("_key") == F.col("_several"), "left")
    equal = marked.where("_several is not null").drop("_several")
    before = Window.partitionBy("_of").orderBy("_in").rowsBetween(Window.unboundedPreceding, -1)
    counts = equal.groupBy(F.col("_key").alias("_of"), F.col("_part").alias("_in")).agg(F.count(F.lit(1)).alias("_n"))
    offsets = scratch.write(counts.select("_of", "_in", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")), f"{name}-offsets")
    within = equal.withColumn("_rn", F.row_number().over(Window.partitionBy("_key", "_part").orderBy("_size")))
    numbered = within.join(_few(offsets), (F.col("_key") == F.col("_of")) & (F.col("_part") == F.col("_in")))
    numbered = numbered.withColumn("_no", F.col("_before") + F.col("_rn") - 1)
    return marked.where("_several is null").withColumn("_no", F.lit(0).cast("long")).select(*rows.columns, "_no").unionByName(numbered.select(*rows.columns, "_no"))


def _draw(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("double") / F.lit(float(1 << 4 * DIGITS))


def with_copies(rows: DataFrame, scratch: Scratch, slim: DataFrame) -> DataFrame:
    """Add ``source_size, target, copies`` to rows with ``_src, _size, _key``. ``slim``: a written table of
    the same rows with these columns, to count from."""
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    targets = source_targets(slim).withColumn("whole", F.floor(rate)).withColumn("fraction", rate - F.col("whole")).withColumn("reach", F.lit(float(REPAIR)) / F.sqrt("n"))
    targets = scratch.write(targets.withColumn("lacks", F.col("target") - F.col("whole") * F.col("source_size")).withColumnRenamed("_src", "_to"), "targets")
    several = scratch.write(slim.groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(F.col("_key").alias("_several")), "several")
    near = F.abs(F.col("_u") - F.col("fraction")) <= F.col("reach")
    under = F.col("_u") < F.col("fraction")

    def drawn(df: DataFrame, name: str) -> DataFrame:
        digest = F.md5(F.concat("_key", F.lit(":"), F.col("_no").cast("string")))
        return _numbered(df, several, scratch, name).withColumn("_digest", digest).withColumn("_u", _draw(F.col("_digest"))).join(_few(targets), F.col("_src").eqNullSafe(F.col("_to")), "left").drop("_to")

    every = scratch.write(drawn(slim, "counted"), "drawn") if rows is slim else drawn(slim, "counted")
    counted = every.where("lacks > 0")
    sure = counted.groupBy("_src").agg(F.coalesce(F.sum(F.when(under & ~near, F.col("_size"))), F.lit(0)).alias("sure")).withColumnRenamed("_src", "_to")
    reached = counted.where(near).join(_few(scratch.write(sure, "sure")), F.col("_src").eqNullSafe(F.col("_to")))
    order = Window.partitionBy("_src").orderBy("_digest").rowsBetween(Window.unboundedPreceding, -1)
    middle = F.col("sure") + F.coalesce(F.sum("_size").over(order), F.lit(0)) + F.col("_size") / F.lit(2.0)
    cuts = reached.withColumn("_fits", middle <= F.col("lacks")).where("_fits").groupBy("_src").agg(F.max("_digest").alias("cut"))
    cuts = scratch.write(cuts.withColumnRenamed("_src", "_to"), "cuts")
    both = (every if rows is slim else drawn(rows, "rows")).join(_few(cuts), F.col("_src").eqNullSafe(F.col("_to")), "left").drop("_to")
    copied = F.when(F.col("lacks") > 0, F.when(near, F.coalesce(F.col("_digest") <= F.col("cut"), F.lit(False))).otherwise(under)).otherwise(F.lit(False))
    return both.withColumn("copies", (F.col("whole") + copied.cast("long")).cast("long"))


def _columns(docs: DataFrame) -> dict[str, Column]:
    blank = lambda c: F.coalesce(docs[c].cast("string"), F.lit(""))
    key = F.md5(F.concat_ws("\n", blank("doc_id"), F.md5(blank("source")), F.md5(blank("text"))))
    return {"_id": docs["doc_id"], "_src": docs["source"], "_size": n_words(docs["text"]), "_key": key}


def mix(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it."""
    scratch = Scratch(docs.sparkSession, "mixing")
    columns = _columns(docs)
    slim = scratch.write(docs.select(*[c.alias(k) for k, c in columns.items() if k != "_id"]), "sizes")
    full = docs.select(*[c.alias(k) for k, c in columns.items() if k != "_id"], F.struct(*[docs[c] for c in docs.columns]).alias("_row"))
    drawn = with_copies(full, scratch, slim).where("copies > 0")
    return drawn.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("_row.*")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "mixing")
    slim = scratch.write(docs.select(*[c.alias(k) for k, c in _columns(docs).items()]), "sizes")
    drawn = with_copies(slim, scratch, slim)
    return drawn.select(F.col("_id").alias("doc_id"), F.col("_size").alias("size"), "source_size", "target", (F.col("copies") * F.col("_size")).alias("taken"))


OP9_SQL = r"""
WITH keyed AS (SELECT doc_id, source, md5(coalesce(doc_id::VARCHAR, '') || chr(10) || md5(coalesce(source, '')) || chr(10) || md5(coalesce(text, ''))) AS k,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
sized AS (SELECT *, md5(k || ':' || (row_number() OVER (PARTITION BY k) - 1)) AS h FROM keyed),
totals AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n FROM sized GROUP BY source),
weighed AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w, (3 * source_size)::DOUBLE AS cap,
    row_number() OVER (ORDER BY source NULLS LAST) AS rn FROM totals),
levels AS (SELECT *, (sum(source_size::DOUBLE) OVER () - coalesce(sum(cap) OVER before, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS lvl
    FROM weighed WINDOW before AS (ORDER BY cap / w, rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
chosen AS (SELECT first(lvl ORDER BY cap / w, rn) AS lvl FROM levels WHERE lvl <= cap / w),
targets AS (SELECT source, source_size, n, least(cap, w * (SELECT lvl FROM chosen)) AS target FROM weighed),
rates AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0.0 END AS whole,
    CASE WHEN source_size > 0 THEN target / source_size - floor(target / source_size) ELSE 0.0 END AS fraction, 8.0::DOUBLE / sqrt(n) AS reach FROM targets),
drawn AS (SELECT s.doc_id, s.source, s.size, s.h, r.source_size, r.target, r.whole, r.fraction, r.target - r.whole * r.source_size AS lacks,
    ('0x' || substr(h, 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u, abs(('0x' || substr(h, 1, 13))::BIGINT / 4503599627370496.0::DOUBLE - r.fraction) <= r.reach AS near
    FROM sized s JOIN rates r ON s.source IS NOT DISTINCT FROM r.source),
placed AS (SELECT *, coalesce(sum(size) FILTER (WHERE u < fraction AND NOT near) OVER (PARTITION BY source), 0)
    + coalesce(sum(size) FILTER (WHERE near) OVER (PARTITION BY source ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + size / 2.0::DOUBLE AS middle FROM drawn)
SELECT doc_id, size, source_size, target,
    (size * (whole + CASE WHEN lacks > 0 AND (CASE WHEN near THEN middle <= lacks ELSE u < fraction END) THEN 1 ELSE 0 END))::BIGINT AS taken FROM placed
"""
