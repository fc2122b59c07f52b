"""Scans and writes over files: partitions, row groups, tolerant JSON lines, merges, checksums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def partitioned(spark: SparkSession, path: str, **equal) -> DataFrame:
    """A Hive-partitioned Parquet table; ``equal`` prunes partitions before anything is listed deep."""
    df = spark.read.parquet(path)
    for key, value in equal.items():
        df = df.where(F.col(key) == value)
    return df


def with_location(df: DataFrame) -> DataFrame:
    """Rows with the file they came from and its place in it (``file``, ``block_start``)."""
    return df.select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block_start"))


def json_lines(spark: SparkSession, path: str, schema: str, key: str, order: str) -> DataFrame:
    """A JSONL checkpoint: lines that cannot be read are dropped, the last line of a key wins."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    rest = [c for c in rows.columns if c != key]
    best = rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_b"))
    return best.select(key, *[F.col("_b")[c].alias(c) for c in rest])


def new_rows(df: DataFrame, held: DataFrame, keys: list[str]) -> DataFrame:
    """Insert-ignore: the rows of ``df`` whose keys are not held, the first of each key."""
    return df.dropDuplicates(keys).join(held.select(*keys), keys, "left_anti")


def row_hash(columns: list[str]) -> Column:
    """MD5 of a canonical row: values as text between unit separators, nulls as a mark of their own."""
    return F.md5(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x1e")) for c in columns]))


def checksum(df: DataFrame, columns: list[str]) -> DataFrame:
    """``rows, checksum``: an XOR of row hashes, the same for any order of rows and partitions."""
    part = F.conv(F.substring(row_hash(columns), 1, 15), 16, 10).cast("long")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.bit_xor(part).alias("checksum"))


def write_by(df: DataFrame, path: str, keys: list[str], rows_per_file: int = 1_000_000) -> None:
    """Write a partitioned table, clustered so that each task writes few partitions."""
    df.repartition(*keys).write.option("maxRecordsPerFile", rows_per_file).partitionBy(*keys).mode("overwrite").parquet(path)


def export_ordered(df: DataFrame, path: str, keys: list[str], rows_per_file: int = 1_000_000) -> None:
    """CSV files with a header, ordered by ``keys`` within each file and from file to file: rows are dealt by
    ranges of the keys, so nothing is sorted in one task."""
    df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.option("header", True).option("maxRecordsPerFile", rows_per_file).option("nullValue", "\\N").option("escape", '"').mode("overwrite").csv(path)


def import_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What :func:`export_ordered` wrote; a line that does not fit the schema stops the read."""
    return spark.read.schema(schema).option("header", True).option("nullValue", "\\N").option("escape", '"').option("multiLine", True).option("mode", "FAILFAST").csv(path)


def failure_ledger(failures: DataFrame, key: str, reason: str, permanent: tuple[str, ...], most: int = 3, succeeded: DataFrame | None = None) -> DataFrame:
    """``key, attempts, last_reason, permanent``: given up after ``most`` attempts, or at once for
    some reasons. ``succeeded`` (``key, at``): a key that succeeded later than its last failure leaves the
    ledger; failures before a success no longer count."""
    if succeeded is not None:
        last = succeeded.groupBy(F.col(key).alias("_ok")).agg(F.max("at").alias("_at"))
        failures = failures.join(last, F.col(key) == F.col("_ok"), "left").where("_at is null or at > _at").drop("_ok", "_at")
    held = failures.groupBy(key).agg(F.count(F.lit(1)).alias("attempts"), F.max_by(reason, "at").alias("last_reason"), F.bool_or(F.col(reason).isin(*permanent)).alias("_fatal"))
    return held.select(key, "attempts", "last_reason", (F.col("_fatal") | (F.col("attempts") >= most)).alias("permanent"))
