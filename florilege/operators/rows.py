"""Selecting rows: first of a group, top n, keyset pages, samples, changes and runs."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType


#: Rows that a task gets of tables of small rows, of which it keeps most in memory.
TASK_ROWS = 1_000_000


def dealt(df: DataFrame, keys: list[str], count: int) -> DataFrame:
    """``df`` dealt by ``keys`` into so many parts that one of ``count`` rows in all has at most some ``TASK_ROWS``. Partitions of
    a fixed number, or coalesced by their bytes, would let what a task holds grow with the table."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-count // TASK_ROWS)), *keys)


def first_per_group(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group in a total ``order``. An aggregate of structs when the order is
    ascending plain columns would shuffle less; this form takes any order."""
    ranked = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("_rn = 1").drop("_rn")


def latest_per_group(df: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """The row with the greatest ``by`` in each group: an aggregate, combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*by)).alias("_best"))
    return best.select(*keys, *[F.col("_best")[c].alias(c) for c in rest])


def top_n_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rn") -> DataFrame:
    """The first ``n`` rows of each group; the window filter becomes a group limit before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= n)


def after_key(df: DataFrame, keys: list[str], values: list) -> DataFrame:
    """Rows whose ``keys`` are lexicographically greater than ``values`` (a keyset cursor)."""
    condition = F.lit(False)
    for i, (key, value) in enumerate(zip(keys, values, strict=True)):
        equal = F.lit(True)
        for k, v in zip(keys[:i], values[:i], strict=True):
            equal = equal & (F.col(k) == F.lit(v))
        condition = condition | (equal & (F.col(key) > F.lit(value)))
    return df.where(condition)


def keyset_page(df: DataFrame, keys: list[str], values: list | None, size: int) -> DataFrame:
    """One page in the order of ``keys`` after the cursor ``values``."""
    rest = df if values is None else after_key(df, keys, values)
    return rest.orderBy(*keys).limit(size)


def hash_sample(df: DataFrame, key: str, n: int) -> DataFrame:
    """``n`` rows in the order of the MD5 of ``key``: the same rows on every run."""
    return df.orderBy(F.md5(F.col(key).cast("string")), key).limit(n)


def stratified_sample(df: DataFrame, strata: list[Column], key: str, n: int) -> DataFrame:
    """``n`` rows of each stratum in MD5 order, with their rank ``rn``."""
    names = [f"_s{i}" for i in range(len(strata))]
    tagged = df.withColumns(dict(zip(names, strata, strict=True)))
    return top_n_per_group(tagged, names, [F.md5(F.col(key).cast("string")), F.col(key)], n).drop(*names)


def changes(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Rows whose ``value`` differs from the row before it (the first of a group included), with
    ``previous``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    lagged = df.withColumns({"previous": F.lag(value).over(w), "_first": F.row_number().over(w) == 1})
    return lagged.where(F.col("_first") | ~F.col(value).eqNullSafe(F.col("previous"))).drop("_first")


def runs(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Runs of equal ``value``: ``run``, ``value``, first and last of ``order[0]``, and length."""
    w = Window.partitionBy(*keys).orderBy(*order)
    starts = df.withColumn("_new", F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1), 0).otherwise(1))
    numbered = starts.withColumn("run", F.sum("_new").over(w))
    return numbered.groupBy(*keys, "run").agg(
        F.first(value).alias(value), F.min(order[0]).alias("run_start"), F.max(order[0]).alias("run_end"), F.count(F.lit(1)).alias("run_length")
    )


def maximum_before(df: DataFrame, key: str, value: str, out: str, size: int = 1000, levels: int = 2) -> DataFrame:
    """``df`` with ``out``: the greatest ``value`` of all rows with a smaller integer ``key`` (unique), null
    for the first. Ranges of ``size`` keys are summed up ``levels`` times, so that the last window, which
    is one task, sees one row for ``size ** levels`` keys; rows without a key come first."""
    if not levels:
        return df.withColumn(out, F.max(value).over(Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)))
    part = f"_range{levels}"
    ranged = df.withColumn(part, F.floor(F.col(key) / size))
    sums = ranged.groupBy(part).agg(F.max(value).alias("_most"))
    carried = maximum_before(sums, part, "_most", "_carried", size, levels - 1).select(F.col(part).alias("_q"), "_carried")
    within = F.max(value).over(Window.partitionBy(part).orderBy(key).rowsBetween(Window.unboundedPreceding, -1))
    joined = ranged.withColumn("_within", within).join(carried, F.col(part).eqNullSafe(F.col("_q")))
    return joined.withColumn(out, F.greatest("_within", "_carried")).select(*df.columns, out)


def conflicts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Groups with more than one distinct ``value``."""
    return df.groupBy(*keys).agg(F.count_distinct(value).alias("n_values"), F.array_sort(F.collect_set(value)).alias("values")).where("n_values > 1")


def rate_limited(df: DataFrame, key: str, at: str, order: str, limit: int, seconds: int) -> DataFrame:
    """``order, refused, after_us`` for each row: a sliding log of the admitted rows of a key. A row is
    refused while ``limit`` admitted rows lie less than ``seconds`` before it (a row exactly that old
    no longer counts), and ``after_us`` says how many microseconds remain until it would not be.

    Rows are shuffled by key and sorted by time, and one pass over a partition carries the log of the
    present key, ``limit`` times at most, from batch to batch: no group is built, so neither many short
    stretches nor a key that never pauses cost more than their rows. A null key is a key of its own.
    """
    span = seconds * 1_000_000
    timed = df.select(F.col(key).alias("_key"), F.col(order).alias("_id"), F.unix_micros(F.col(at).cast("timestamp")).alias("_us"))

    def admit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        present, log = object(), deque()
        for batch in batches:
            refused, after = [], []
            for name, us in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if name != present:
                    present, log = name, deque()
                while log and log[0] <= us - span:
                    log.popleft()
                full = len(log) >= limit
                refused.append(full)
                after.append(log[0] + span - us if full else 0)
                if not full:
                    log.append(us)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(refused, pa.bool_()), pa.array(after, pa.int64())], [order, "refused", "after_us"])

    schema = StructType([StructField(order, df.schema[order].dataType), StructField("refused", BooleanType()), StructField("after_us", LongType())])
    return timed.repartition("_key").sortWithinPartitions("_key", "_us", "_id").mapInArrow(admit, schema)
