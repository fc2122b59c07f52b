"""Approximate nearest neighbours by an adaptive dimension scan of inverted lists.

Nearness is the inner product. Vectors are lengthened by one component to one common norm, which
turns the largest inner product into the smallest angle, and dealt into lists by spherical k-means.
A query probes the lists whose centres are nearest to it. Within a list, vectors are rotated by a
random orthogonal matrix and read in column blocks. Under the rotation the share that the first ``b`` of
``d`` columns have in an inner product is about ``b / d`` of it, whatever the vectors are like, with a known
deviation; a candidate is abandoned when its partial sum lies more than ``SIGMAS`` deviations below the share
that the query's twentieth best so far would have, or when the norms of what is left cannot lift it there.
(That the rest is about normal around nothing holds for unrelated vectors only: near ones agree in the rest too.)
Survivors are scored exactly, on the original vectors, in double
precision, summed in the order of the components, so that equal vectors tie exactly.

The nearest list of each query is scanned first; its twentieth score is the bound for the others.
Centres, rotation and the number of probes are fitted on a hash sample of about ``SAMPLE`` rows
(probes: the fewest at which a sample of the rows that ask finds ``TARGET`` of its neighbours in the sample; if
that is not the whole table, in the half of it that the centres were not fitted on); every row
is indexed. A list is cut into pieces of about ``PIECE_ROWS`` rows by a hash, and queries of a
piece into blocks, so that a list that holds a third of all rows is no hot group.

Defined results: vectors that are null, all zero, or hold a null or non-finite component take no
part, nor do rows with a null id or vectors of another length than the most common one. Of rows that
repeat an id the smallest vector counts. Ties go to the smaller id. A query whose probed lists hold
fewer than twenty others probes on, twice as many lists each time, until it has twenty or all lists are
done; so it gets fewer only if there are fewer. Empty table: empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from florilege.llm.scratch import Scratch

NEAREST = 20
EVERY = 20
SAMPLE = 20_000
TARGET = 0.96
SIGMAS = 3.0
COLUMN_BLOCK = 16
PIECE_ROWS = 4096
PIECE_QUERIES = 1024
#: Queries that a task scans at a time, and the share of pairs alive below which columns are read pair by pair.
QUERY_ROWS, SPARSE = 256, 0.05
#: Rows that ask, of which the number of probes is fitted.
ASKED = 200


def usable(rows: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """``vec_id, x`` (doubles) of the vectors that take part, and their length."""
    x = F.col("embedding").cast("array<double>")
    bad = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    kept = rows.select("vec_id", x.alias("x")).where("vec_id is not null and x is not null").where(~bad & F.exists("x", lambda v: v != 0))
    size = kept.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not size:
        return kept, 0
    one = kept.where(F.size("x") == size[0]["d"]).groupBy("vec_id").agg(F.min("x").alias("x"))
    return scratch.write(one, "vectors"), size[0]["d"]


def _matrix(column: pa.Array | pa.ChunkedArray, d: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


def _long(x: np.ndarray, norm: float) -> np.ndarray:
    """Vectors with the component that brings them to ``norm``."""
    rest = np.sqrt(np.maximum(norm * norm - (x * x).sum(axis=1), 0))
    return np.hstack([x, rest[:, None]])


class Index:
    """What the sample fits: list centres, rotation and the number of probes. ``ids`` are those of the sample,
    ``asked`` and ``asked_ids`` rows that ask."""

    def __init__(self, ids: np.ndarray, sample: np.ndarray, asked_ids: np.ndarray, asked: np.ndarray, norm: float, rows: int, d: int, seed: int = 17):
        rng = np.random.default_rng(seed)
        self.norm, self.d = norm, d
        self.rotation = np.linalg.qr(rng.standard_normal((d, d)))[0]
        order = rng.permutation(len(sample))
        half = len(sample) // 2 if len(sample) < rows and len(sample) > 4 * NEAREST else 0  # rows that centres do not know are further from them
        lists = int(np.clip(np.sqrt(rows) / 2, 1, 4096))
        long = _long(sample, norm)
        known = long[order[half:]]
        self.lists = min(lists, len(known))
        centres = known[: self.lists]
        for _ in range(10):
            near = (known @ centres.T).argmax(axis=1)
            sums = np.zeros_like(centres)
            np.add.at(sums, near, known)
            length = np.linalg.norm(sums, axis=1, keepdims=True)
            centres = np.where(length > 0, sums / np.maximum(length, 1e-300) * norm, centres)
        self.centres = centres
        held = order[:half] if half else order
        self.probes = self._fit(ids[held], sample[held], long[held], asked_ids, asked)

    def _fit(self, ids: np.ndarray, sample: np.ndarray, long: np.ndarray, asked_ids: np.ndarray, asked: np.ndarray) -> int:
        if len(sample) <= NEAREST or not len(asked):
            return self.lists
        scores = asked @ sample.T
        scores[asked_ids[:, None] == ids[None, :]] = -np.inf
        best = np.argpartition(-scores, NEAREST - 1, axis=1)[:, :NEAREST]
        place = np.empty((len(asked), self.lists), np.int64)
        order = self.order(asked, self.lists)
        np.put_along_axis(place, order, np.arange(self.lists)[None, :], axis=1)
        at = np.take_along_axis(place, (long @ self.centres.T).argmax(axis=1)[best], axis=1)
        return int(np.quantile(at, TARGET, method="higher")) + 1

    def order(self, x: np.ndarray, k: int) -> np.ndarray:
        return np.argsort(-(x @ self.centres[:, : self.d].T), axis=1, kind="stable")[:, :k]


def _assign(index: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("x"), index.d)
            near = (_long(x, index.norm) @ index.centres.T).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("x"), pa.array(near, pa.int32())], ["vec_id", "x", "list"])

    return run


def _probe(index: Index, first: int, last: int):
    """Queries with the lists at places ``first`` to ``last`` of their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            order = index.order(_matrix(batch.column("x"), index.d), last)[:, first:]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(order.astype(np.int32).tolist(), pa.list_(pa.int32()))], [*batch.schema.names, "lists"])

    return run


def _exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of row pairs, summed component by component."""
    total = np.zeros(len(x))
    for j in range(x.shape[1]):
        total += q[:, j] * x[:, j]
    return total


def _alive(q: np.ndarray, x: np.ndarray, queries: np.ndarray, ids: np.ndarray, bound: np.ndarray, some: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of rotated vectors that are not abandoned on the way through the columns."""
    d = x.shape[1]
    # norms of what is left of each vector from a column on
    x_left, q_left = (np.sqrt(np.maximum(np.cumsum((v * v)[:, ::-1], axis=1)[:, ::-1], 0)) for v in (x, q))
    sure = np.zeros((len(q), len(x)), bool)  # the candidates that make a first bound are not abandoned, so that twenty are found
    if some > NEAREST and np.isneginf(bound).any():  # a first bound: of some candidates the twentieth, its own row aside
        scores = q @ x[:some].T
        scores[queries[:, None] == ids[None, :some]] = -np.inf
        twentieth = np.partition(scores, some - NEAREST, axis=1)[:, some - NEAREST]
        sure[:, :some] = (scores >= twentieth[:, None]) & np.isneginf(bound)[:, None]
        bound = np.maximum(bound, twentieth)
    slip = 1e-9 * q_left[:, 0] * x_left[:, 0].max()  # of rounding
    part, qi, xi = np.zeros((len(q), len(x))), None, None
    for a in range(0, d, COLUMN_BLOCK):
        b = min(a + COLUMN_BLOCK, d)
        if qi is None:
            part += q[:, a:b] @ x[:, a:b].T
            i, j = np.arange(len(q))[:, None], np.arange(len(x))[None, :]
        else:
            i, j = qi, xi
            part = part + np.einsum("ij,ij->i", q[i, a:b], x[j, a:b])
        least = bound - slip
        if b < d:
            alive = part + q_left[i, b] * x_left[j, b] >= least[i]
            deviation = SIGMAS * np.sqrt(b * (d - b) / (d * d * (d + 2.0)))  # of the share, times sqrt(1 + cos^2), which a chord bounds
            share = np.where(np.isneginf(bound), -np.inf, b / d * least - deviation * 0.4143 * np.abs(np.where(np.isneginf(bound), 0, bound)))
            alive &= part + deviation * q_left[i, 0] * x_left[j, 0] >= share[i]
        else:
            alive = part >= least[i]
        if qi is None:
            alive |= sure
            if b == d or alive.mean() < SPARSE:
                qi, xi = np.nonzero(alive)
                part = part[qi, xi]
        else:
            alive |= sure[qi, xi]
            qi, xi, part = qi[alive], xi[alive], part[alive]
    return qi, xi


def _scanner(index: Index):
    d = index.d

    def scan(left, right):
        """Best candidates of one piece of a list for one block of queries."""
        if left.num_rows == 0 or right.num_rows == 0:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        ids, queries = left.column("vec_id").to_numpy(), right.column("query_id").to_numpy()
        x0, q0 = _matrix(left.column("x"), d), _matrix(right.column("q"), d)
        bound = right.column("bound").to_numpy().copy()
        x, q = x0 @ index.rotation, q0 @ index.rotation
        some = min(len(ids), 4 * NEAREST)
        out = []
        for at in range(0, len(queries), QUERY_ROWS):
            rows = slice(at, at + QUERY_ROWS)
            qi, xi = _alive(q[rows], x, queries[rows], ids, bound[rows], some)
            out.append((qi + at, xi))
        qi, xi = (np.concatenate(parts) for parts in zip(*out, strict=True))
        other = queries[qi] != ids[xi]
        qi, xi = qi[other], xi[other]
        score = _exact(q0[qi], x0[xi])
        order = np.lexsort((ids[xi], -score, qi))
        qi, xi, score = qi[order], xi[order], score[order]
        rank = np.arange(len(qi)) - np.searchsorted(qi, qi)
        top = rank < NEAREST
        return pa.table({"query_id": pa.array(queries[qi[top]], pa.int64()), "vec_id": pa.array(ids[xi[top]], pa.int64()), "score": pa.array(score[top], pa.float64())})

    return scan


FOUND = "query_id long, vec_id long, score double"


def _best(found: DataFrame) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= NEAREST)


def search(rows: DataFrame, every: int = EVERY) -> DataFrame:
    """``query_id, rank, vec_id, score`` for every row whose id is divisible by ``every``."""
    spark = rows.sparkSession
    scratch = Scratch(spark, "nearest")
    vectors, d = usable(rows, scratch)
    if not d:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    square = F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v)
    asks = F.pmod("vec_id", F.lit(every)) == 0
    n, n_asked, norm2 = vectors.agg(F.count(F.lit(1)), F.count_if(asks), F.max(square)).collect()[0]

    def drawn(part: DataFrame, total: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        """About ``size`` rows of a hash sample."""
        rows = part.where(F.pmod(F.xxhash64("vec_id"), F.lit(max(total, 1))) < size).select("vec_id", "x").collect()
        return np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.float64).reshape(-1, d)

    ids, sample = drawn(vectors, n, SAMPLE)
    if len(sample) == 0:
        one = vectors.first()
        ids, sample = np.array([one["vec_id"]], np.int64), np.array([one["x"]], np.float64)
    asked_ids, asked_rows = drawn(vectors.where(asks), n_asked, ASKED)
    index = Index(ids, sample, asked_ids, asked_rows, float(np.sqrt(norm2)), n, d)

    listed = scratch.write(vectors.mapInArrow(_assign(index), "vec_id long, x array<double>, list int"), "lists")
    held = {r[0]: r[1] for r in listed.groupBy("list").agg(F.count(F.lit(1))).collect()}  # a row for each list
    pieces = F.array(*[F.lit(-(-held.get(i, 0) // PIECE_ROWS)) for i in range(index.lists)])
    cut = listed.withColumn("piece", F.pmod(F.xxhash64("vec_id", F.lit(3)), F.element_at(pieces, F.col("list") + 1)).cast("int"))
    n_queries = -(-n // every)
    blocks = max(1, n_queries // PIECE_QUERIES)
    asked = listed.where(asks).select(F.col("vec_id").alias("query_id"), F.col("x"))

    def scanned(queries: DataFrame, first: int, last: int, name: str) -> DataFrame:
        probing = queries.mapInArrow(_probe(index, first, last), "query_id long, x array<double>, bound double, lists array<int>")
        each = probing.select("query_id", F.col("x").alias("q"), "bound", F.explode("lists").alias("list"))
        each = each.withColumn("piece", F.explode(F.sequence(F.lit(0), F.element_at(pieces, F.col("list") + 1) - 1))).where(F.element_at(pieces, F.col("list") + 1) > 0)
        each = each.withColumn("block", F.pmod(F.xxhash64("query_id", F.lit(5)), F.lit(blocks)).cast("int"))
        each = scratch.write(each, f"{name}-queries")
        used = each.select(F.col("list").alias("l"), F.col("piece").alias("p"), F.col("block").alias("b")).distinct()
        dealt = cut.join(used, (F.col("list") == F.col("l")) & (F.col("piece") == F.col("p"))).select("vec_id", "x", "l", "p", "b")
        pairs = dealt.groupBy("l", "p", "b").cogroup(each.groupBy("list", "piece", "block"))
        return scratch.write(pairs.applyInArrow(_scanner(index), FOUND), name)

    home = scanned(asked.select("query_id", "x", F.lit(float("-inf")).alias("bound")), 0, 1, "home")
    bounds = _best(home).where(F.col("rank") == NEAREST).select("query_id", F.col("score").alias("bound"))
    parts = home
    if index.probes > 1:
        known = asked.join(bounds, "query_id", "left").select("query_id", "x", F.coalesce("bound", F.lit(float("-inf"))).alias("bound"))
        parts = home.unionByName(scanned(known, 1, index.probes, "others"))
    done, most, kept = index.probes, min(NEAREST, n - 1), ["home", "others"]
    while done < index.lists:
        got = parts.groupBy("query_id").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= most).select("query_id")
        short = scratch.write(asked.join(got, "query_id", "left_anti").select("query_id", "x", F.lit(float("-inf")).alias("bound")), f"short-{done}")
        if short.isEmpty():
            break
        last = min(2 * done, index.lists)
        kept.append(f"more-{done}")
        parts = parts.unionByName(scanned(short, done, last, kept[-1]))
        done = last
    scratch.keep_only(*kept)
    return _best(parts).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
