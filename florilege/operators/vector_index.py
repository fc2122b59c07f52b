"""An approximate vector index in tables: inverted lists of residual codes, searched with a filter.

:func:`build` fits centres by k-means on a bounded sample (``SAMPLE`` rows, the first in the order of a hash of
their keys), puts every vector in the list of its nearest centre, and holds it there as one byte for each
component of what remains beside the centre. Lists are cut into blocks of about ``BLOCK`` vectors, so
that a list of copies is no large row. The index is two tables in the shared folder and the vectors
themselves; any number of searches reads them.

:func:`search` scores codes in the ``probes`` lists nearest to a query and ranks the best of them by
their true vectors. Where fewer than ``k`` vectors pass the query's filter, the search goes on through
the next lists, twice as many each time, until it has ``k`` or all lists are read: so a narrow filter
costs lists, not results. ``probes`` is fitted in :func:`build`, on up to ``ASKED`` rows of the sample,
to the share of their nearest that ``RECALL`` names.

Nearness is the inner product. Vectors that are null, empty, or hold a null or an unbounded component are
in no list and are not asked for. Ties go to the smaller key. Queries and pieces of lists meet in joins on the list; nothing that grows
with the data is broadcast: centres are at most ``MOST_LISTS``.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from florilege.session import shared_folder

SAMPLE, ASKED, MOST_LISTS, ROUNDS = 20_000, 200, 4096, 8
BLOCK, QUERIES = 1024, 256
RECALL = 0.97
#: So many times ``k`` codes are ranked by their true vectors.
RERANKED = 4


def sound(c: str):
    """Whether a vector takes part."""
    bad = F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(c) > 0) & ~bad, F.lit(False))


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.zeros((0, 1))


def _centres(sample: np.ndarray, lists: int) -> np.ndarray:
    """Centres by a fixed number of rounds, from rows spread over the sample; empty ones keep their place."""
    centres = sample[np.linspace(0, len(sample) - 1, lists).astype(int)].copy()
    for _ in range(ROUNDS):
        near = _nearest(sample, centres)
        counts = np.bincount(near, minlength=lists)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centres


def _nearest(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(1)[None, :] - 2 * vectors @ centres.T, axis=1)


def _probes(sample: np.ndarray, centres: np.ndarray, k: int) -> int:
    """The least number of lists in which a ``RECALL`` of the ``k`` nearest of sampled rows lies."""
    asked = sample[:: max(1, len(sample) // ASKED)][:ASKED]
    home = _nearest(sample, centres)
    place = np.argsort(np.argsort(-asked @ centres.T, axis=1, kind="stable"), axis=1)  # of each list, for each query
    best = np.argsort(-asked @ sample.T, axis=1, kind="stable")[:, 1 : k + 1]  # beside itself
    needed = np.sort(np.take_along_axis(place, home[best], axis=1).ravel())
    return int(needed[min(len(needed) - 1, int(np.ceil(RECALL * len(needed))))]) + 1 if len(needed) else 1


@dataclass(frozen=True)
class Index:
    """Where an index lies, and how many lists a search reads first."""

    root: str
    probes: int
    centres: np.ndarray

    def blocks(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.root}/blocks")


def build(vectors: DataFrame, key: str, embedding: str, tag: str, name: str, k: int = 10) -> Index:
    """Write the index of ``vectors`` to ``name`` in the shared folder. ``tag``: a whole number to filter by."""
    spark = vectors.sparkSession
    root = f"{shared_folder(spark)}/{name}"
    held = vectors.where(sound(embedding)).select(F.col(key).cast("long").alias("key"), F.col(embedding).alias("v"), F.col(tag).cast("long").alias("tag"))
    sample = _stack(pd.Series([r["v"] for r in held.orderBy(F.xxhash64("key"), "key").limit(SAMPLE).select("v").collect()]))
    lists = int(min(MOST_LISTS, max(1, round(held.count() ** 0.5)), max(1, len(sample))))
    centres = _centres(sample, lists) if len(sample) else np.zeros((1, 1))

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            v = _stack(batch["v"])
            home = _nearest(v, centres)
            left = v - centres[home]
            scale = np.maximum(np.abs(left).max(1), 1e-30) / 127
            codes = np.rint(left / scale[:, None]).astype(np.int8)
            yield pd.DataFrame({"list": home.astype(np.int32), "key": batch["key"], "tag": batch["tag"].astype("Int64"), "scale": scale, "code": [c.tobytes() for c in codes]})

    held.mapInPandas(code, "list int, key long, tag long, scale double, code binary").write.mode("overwrite").parquet(f"{root}/codes")
    codes = spark.read.parquet(f"{root}/codes")
    parts = codes.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("_parts"))  # a row for each list
    cut = codes.join(F.broadcast(parts), "list").withColumn("block", F.pmod(F.xxhash64("key"), F.col("_parts")))
    cut.groupBy("list", "block").agg(F.collect_list(F.struct("key", "tag", "scale", "code")).alias("held")).write.mode("overwrite").parquet(f"{root}/blocks")
    index = Index(root, _probes(sample, centres, k) if len(sample) else 1, centres)
    meta = [(json.dumps({"probes": index.probes, "centres": centres.tolist()}),)]
    spark.createDataFrame(meta, "meta string").write.mode("overwrite").text(f"{root}/meta")
    return index


def open_index(spark: SparkSession, name: str) -> Index:
    root = f"{shared_folder(spark)}/{name}"
    meta = json.loads(spark.read.text(f"{root}/meta", wholetext=True).first()[0])
    return Index(root, meta["probes"], np.array(meta["centres"]))


def _scored(centres: np.ndarray, depth: int):
    """For each block and the queries that read its list: the ``depth`` best codes of each query."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for number, held, asked in zip(batch["list"], batch["held"], batch["asked"], strict=True):
                keys = np.array([h["key"] for h in held], np.int64)
                tags = np.array([-1 if h["tag"] is None else h["tag"] for h in held], np.float64)
                known = np.array([h["tag"] is not None for h in held])
                codes = np.stack([np.frombuffer(h["code"], np.int8) for h in held]).astype(np.float64) * np.array([h["scale"] for h in held])[:, None]
                q = np.stack([a["q"] for a in asked]).astype(np.float64)
                score = (q @ centres[number])[:, None] + q @ codes.T
                found = []
                for a, row in zip(asked, score, strict=True):
                    may = keys != a["query_id"]
                    if a["wanted"] is not None:
                        may &= known & (tags == a["wanted"])
                    at = np.flatnonzero(may)
                    if len(at) > depth:
                        at = at[np.argpartition(-row[at], depth)[:depth]]
                    found.append((np.full(len(at), a["query_id"], np.int64), keys[at], row[at]))
                # one frame for a block and its queries, not one for each query
                ids, near, about = (np.concatenate(parts) for parts in zip(*found, strict=True))
                if len(ids):
                    yield pd.DataFrame({"query_id": ids, "key": near, "about": about})

    return run


def search(index: Index, vectors: DataFrame, key: str, embedding: str, asked: DataFrame, k: int, probes: int | None = None) -> DataFrame:
    """``query_id, key, score, rank``: the ``k`` nearest found for each row of ``asked`` (``query_id,
    q, wanted``; ``wanted``: the tag that results must have, null for any), the query's own key aside.
    ``score`` is the inner product of the vectors themselves."""
    spark = vectors.sparkSession
    centres, many = index.centres, len(index.centres)
    work = f"{index.root}/search-{spark.range(1).select(F.expr('uuid()')).first()[0]}"
    deep = k * RERANKED

    def ordered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not batch.empty:
                order = np.argsort(-_stack(batch["q"]) @ centres.T, axis=1, kind="stable").astype(np.int32)
                yield batch.assign(wanted=batch["wanted"].astype("Int64"), lists=list(order))

    slim = asked.where(sound("q")).select(F.col("query_id").cast("long").alias("query_id"), F.col("q").cast("array<double>").alias("q"), F.col("wanted").cast("long").alias("wanted"))
    slim.mapInPandas(ordered, "query_id long, q array<double>, wanted long, lists array<int>").write.parquet(f"{work}/asked")
    every = spark.read.parquet(f"{work}/asked")
    open_, done, first, found = every, 0, probes or index.probes, []
    while done < many:
        to = min(many, done + first)
        each = open_.select("query_id", "q", "wanted", F.explode(F.slice("lists", done + 1, to - done)).alias("list"))
        sizes = each.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / QUERIES).alias("_parts"))
        parted = each.join(F.broadcast(sizes), "list").groupBy("list", F.pmod(F.xxhash64("query_id"), F.col("_parts")).alias("part"))
        chunks = parted.agg(F.collect_list(F.struct("query_id", "q", "wanted")).alias("asked"))
        near = index.blocks(spark).join(chunks, "list").select("list", "held", "asked").mapInPandas(_scored(centres, deep), "query_id long, key long, about double")
        near.write.parquet(f"{work}/round-{len(found)}")
        found.append(f"{work}/round-{len(found)}")
        done, first = to, 2 * first
        have = spark.read.schema("query_id long, key long, about double").parquet(*found).groupBy("query_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= k)
        open_.join(have, "query_id", "left_anti").write.parquet(f"{work}/open-{len(found)}")
        open_ = spark.read.schema(every.schema).parquet(f"{work}/open-{len(found)}")
        if open_.isEmpty():
            break
    if not found:
        return spark.createDataFrame([], "query_id long, key long, score double, rank int")
    codes = spark.read.schema("query_id long, key long, about double").parquet(*found)
    best = codes.withColumn("_rn", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("about"), "key"))).where(F.col("_rn") <= deep)
    true = best.join(every.select("query_id", "q"), "query_id").join(vectors.select(F.col(key).cast("long").alias("key"), F.col(embedding).cast("array<double>").alias("v")), "key")
    dot = F.aggregate(F.zip_with("q", "v", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    ranked = true.select("query_id", "key", dot.alias("score")).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "key")))
    return ranked.where(F.col("rank") <= k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """``query_id, exact, found, recall`` from rows of ``query_id, key``."""
    both = exact.select("query_id", "key").join(found.select("query_id", "key", F.lit(1).alias("_hit")), ["query_id", "key"], "left")
    return both.groupBy("query_id").agg(F.count(F.lit(1)).alias("exact"), F.count("_hit").alias("found")).withColumn("recall", F.col("found") / F.col("exact"))


def agreement(exact: DataFrame, coarse: DataFrame, k: int) -> DataFrame:
    """``query_id, overlap, ties, ndcg``: how a coarse ranking (``query_id, key, score, rank``) stands to an exact
    one: common keys among the first ``k``, neighbouring ranks of equal coarse score, and the discounted
    gain of the coarse order by exact scores above the exact ranking's least, over the best possible."""
    gain = F.col("score") - F.min("score").over(Window.partitionBy("query_id"))
    graded = exact.where(F.col("rank") <= k).withColumn("gain", gain)
    discount = lambda rank: F.lit(1.0) / (F.log2(F.lit(1.0) + rank))
    ideal = graded.groupBy("query_id").agg(F.sum(F.col("gain") * discount(F.col("rank"))).alias("ideal"))
    line = Window.partitionBy("query_id").orderBy("rank")
    placed = coarse.where(F.col("rank") <= k).withColumn("_tie", (F.col("score") == F.lag("score").over(line)).cast("int"))
    joined = placed.select("query_id", "key", F.col("rank").alias("place"), "_tie").join(graded.select("query_id", "key", "gain"), ["query_id", "key"], "left")
    got = joined.groupBy("query_id").agg(F.count("gain").alias("overlap"), F.coalesce(F.sum("_tie"), F.lit(0)).alias("ties"), F.coalesce(F.sum(F.col("gain") * discount(F.col("place"))), F.lit(0.0)).alias("dcg"))
    ndcg = F.when(F.col("ideal") > 0, F.col("dcg") / F.col("ideal")).otherwise(F.lit(1.0))
    return ideal.join(got, "query_id", "left").select("query_id", F.coalesce("overlap", F.lit(0)).alias("overlap"), F.coalesce("ties", F.lit(0)).alias("ties"), F.round(ndcg, 6).alias("ndcg"))
