"""Tables written to the shared folder, so that lineage is cut in a way that survives lost executors."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

#: Used only on a local master whose session names no shared folder, as in tests.
LOCAL_CHECKPOINTS = "/tmp/checkpoints/florilege"
#: Rows of whole texts that a Python worker gets at a time.
TEXT_ROWS = 100


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. A cluster that names none
    is refused, as its machines would each write to a folder of their own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.conf.get("spark.master", "").split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return named or LOCAL_CHECKPOINTS


@contextmanager
def text_batches(spark: SparkSession, rows: int = TEXT_ROWS) -> Iterator[None]:
    """For what is run inside: Arrow batches of few rows, as batches count rows and texts may be long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


class Scratch:
    """A fresh subfolder of the shared folder for one run of one operator."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` as Parquet and read it back; the result depends on the files alone."""
        path = f"{self.root}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def write_texts(self, df: DataFrame, name: str) -> DataFrame:
        """:meth:`write` for plans that hand whole texts to Python workers."""
        with text_batches(self.spark):
            return self.write(df, name)

    def keep_only(self, *names: str) -> None:
        """Delete the tables that nothing will read again: all but ``names``."""
        root, fs = self._root()
        for status in fs.listStatus(root):
            if status.getPath().getName() not in names:
                fs.delete(status.getPath(), True)

    def drop(self, *names: str) -> None:
        """Delete tables whose last reader is done."""
        root, fs = self._root()
        for name in names:
            fs.delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root, name), True)

    def _root(self):
        root = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        return root, root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())


def keyed(df: DataFrame, scratch: Scratch) -> DataFrame:
    """``_row, _doc``: the rows of ``df`` as structs, each with a key of its own (a number).

    The key is ``doc_id`` if that is a whole number that no two rows share and no row lacks. Else rows
    are numbered and written once, so that the keys are the same for all who read them.
    """
    doc = F.struct(*[df[c] for c in df.columns]).alias("_doc")
    if isinstance(df.schema["doc_id"].dataType, IntegralType):
        ids = df.select("doc_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
        if ids.where("n > 1 or doc_id is null").isEmpty():
            return df.select(df["doc_id"].cast("long").alias("_row"), doc)
    return scratch.write(df.select(F.monotonically_increasing_id().alias("_row"), doc), "keyed")


#: Offsets of :func:`ranked` are broadcast up to so many rows (about 100 bytes each).
BROADCAST_ROWS = 500_000


def ranked(df: DataFrame, scratch: Scratch, group: list[str], bucket: Column, order: list[Column], out: str, slim: DataFrame | None = None) -> DataFrame:
    """Add ``out``: the row's 0-based rank within ``group``, ordered by ``bucket`` and then ``order``.

    A plain ``row_number`` sorts a whole group in one task. Here each (group, bucket) is numbered by
    itself and the counts of the buckets before it are added, so that a group that holds a third of
    all rows is spread over its buckets. ``bucket`` must be an orderable value of which no single
    value holds more rows than one task can sort. Null group values form a group of their own.
    ``slim``: the same rows with fewer columns, to count from.
    """
    keys = [*group, "_bucket"]
    counts = (slim if slim is not None else df).withColumn("_bucket", bucket).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    offsets = scratch.write(offsets.select(*[F.col(k).alias(f"_r{i}") for i, k in enumerate(keys)], "_before"), f"offsets-{out}")
    if offsets.count() <= BROADCAST_ROWS:
        offsets = F.broadcast(offsets)
    within = df.withColumn("_bucket", bucket).withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_r{i}"))
    joined = within.join(offsets, on, "left")
    return joined.withColumn(out, F.col("_before") + F.col("_rn") - 1).drop("_bucket", "_rn", "_before", *[f"_r{i}" for i in range(len(keys))])
