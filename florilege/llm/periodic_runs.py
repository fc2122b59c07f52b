"""Periodic run detection: words that a text says three times or more in a row.

A run is a stretch of consecutive words whose words ``period`` apart are identical, that no
neighbouring word extends, of ``max(LEAST_WORDS, REPEATS * period)`` words or more; its period is the
smallest that it has.

Multi-scale minimizers. A scale covers periods from ``low`` to ``high`` (at most 1.6 times ``low``)
and hashes every stretch of ``high`` words. Inside a run of a period within the scale such a stretch
comes again exactly one period later and not before, as it is at least one period long. So do the
minima of windows of ``2 * low - high + 1`` hashes, and a run of three periods holds at least one such
window together with its image. Hence one pair of equal neighbouring minima, a period apart, lies in
every run; the pair seeds an extension on the words themselves, to both sides, so hashes only propose.
Periods up to ``SHORT``, for which windows would be too short, are found by direct scans: words are
compared with those one lag on. A run found under a multiple of its period has the same ends, so the
smallest period of each stretch is kept.

A text is looked at whole, in one task; many short texts go through the scans together, as one array
with a mark of its own after each text. There is no shuffle. The memory is that of one batch of
``FLUSH_BYTES`` or of one text, some fifteen times its bytes.

Defined results: a null, empty or blank text has no words and no runs; words compare by their bytes;
rows that repeat give rows that repeat; a null id is kept; extra columns are ignored, whatever their
names; an empty table gives an empty result. In the query, a row whose id is null is not altered.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from florilege.llm.scratch import Scratch

LEAST_WORDS = 24
REPEATS = 3
#: Periods found by direct scans.
SHORT = 8
#: Bytes of text that go through the scans together.
FLUSH_BYTES = 4_000_000
WORD = r"[^\x20\x09-\x0D]+"

RUN = StructType([StructField(k, LongType()) for k in ("start", "length", "period")])


def scales(longest: int) -> Iterator[tuple[int, int, int]]:
    """``low, high, window`` of each scale, up to periods of ``longest``."""
    low = SHORT + 1
    while low <= longest:
        high = low * 8 // 5
        yield low, high, 2 * low - high + 1
        low = high + 1


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = a * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F)
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return out


def _sliding(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """``pick`` over every ``width`` neighbours, by doubling."""
    have = 1
    while 2 * have <= width:
        values = pick(values[:-have], values[have:])
        have *= 2
    rest = width - have
    return pick(values[: len(values) - rest], values[rest:]) if rest else values


class _Hashes:
    """Hashes of stretches of words, of lengths that grow from call to call."""

    def __init__(self, words: np.ndarray):
        self.have, self.at = 1, _mix(words.view(np.uint64), words.view(np.uint64) + np.uint64(1))

    def of(self, length: int, words: int) -> np.ndarray:
        """Of every stretch of ``length`` among the first ``words``."""
        while 2 * self.have <= length:
            self.at = _mix(self.at[: -self.have], self.at[self.have :])
            self.have *= 2
        at, rest = self.at[: words - self.have + 1], length - self.have
        return _mix(at[: len(at) - rest], at[rest:])


def _stretches(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each stretch of consecutive numbers."""
    breaks = np.flatnonzero(np.diff(at) != 1)
    return at[np.concatenate(([0], breaks + 1))], at[np.concatenate((breaks, [len(at) - 1]))]


def _agree(left: np.ndarray, right: np.ndarray) -> int:
    """How many leading words of two equally long arrays are identical."""
    done, step = 0, 64
    while done < len(left):
        other = np.flatnonzero(left[done : done + step] != right[done : done + step])
        if len(other):
            return done + int(other[0])
        done, step = done + step, 2 * step
    return len(left)


def find_runs(words: np.ndarray, sizes: list[int]) -> list[tuple[int, int, int]]:
    """``start, end, period`` of every run of an array of texts (word numbers of at least 0).

    The longest texts come first, each with a mark of its own (a negative number) after its words;
    ``sizes`` are the numbers of words of the texts.
    """
    ends = np.cumsum(np.asarray(sizes, np.int64) + 1)
    found: dict[tuple[int, int], int] = {}

    def keep(start: int, end: int, period: int) -> None:
        if end - start >= max(LEAST_WORDS, REPEATS * period):
            found[start, end] = min(period, found.get((start, end), period))

    def reach(least: int) -> int:
        """Words and marks of the texts that have ``least`` words or more."""
        many = int(np.searchsorted(-np.asarray(sizes), -least, side="right"))
        return int(ends[many - 1]) if many else 0

    part = words[: reach(LEAST_WORDS)]
    for lag in range(1, SHORT + 1):
        at = np.flatnonzero(part[lag:] == part[:-lag])
        if len(at):
            first, last = _stretches(at)
            long = last - first + 1 + lag >= max(LEAST_WORDS, REPEATS * lag)
            for start, end in zip(first[long].tolist(), last[long].tolist(), strict=True):
                keep(start, end + 1 + lag, lag)
    hashes = _Hashes(part) if len(part) else None
    for low, high, window in scales(max(sizes, default=0) // REPEATS):
        many = reach(REPEATS * low)
        grams = hashes.of(high, many)
        if len(grams) < window:
            break
        least = _sliding(grams, window, np.minimum)
        # a gram is a minimum if the greatest of the minima of the windows that hold it is itself
        around = np.concatenate((np.zeros(window - 1, np.uint64), least, np.zeros(window - 1, np.uint64)))
        minima = np.flatnonzero(_sliding(around, window, np.maximum) == grams)
        order = np.argsort(grams[minima], kind="stable")
        at, keys = minima[order], grams[minima][order]
        apart = np.diff(at)
        pairs = np.flatnonzero((keys[1:] == keys[:-1]) & (apart >= low) & (apart <= high))
        done: dict[int, int] = {}
        for seed, period in sorted(zip(at[pairs].tolist(), apart[pairs].tolist(), strict=True)):
            if seed + period < done.get(period, 0):
                continue
            end = seed + period + _agree(words[seed : many - period], words[seed + period : many])
            start = seed - _agree(words[:seed][::-1], words[period : seed + period][::-1])
            done[period] = end
            keep(start, end, period)
    return sorted((start, end, period) for (start, end), period in found.items())


def _numbers(words: list[bytes]) -> np.ndarray:
    return pa.array(words, pa.large_binary()).dictionary_encode().indices.to_numpy().astype(np.int64)


def _judge(texts: list[bytes]) -> tuple[list[int], list[list[dict]], list[bytes]]:
    """Numbers of words, runs and collapsed texts of some texts."""
    split = [t.split() for t in texts]  # for bytes, at \x20 and \x09 to \x0D
    order = sorted(range(len(split)), key=lambda i: -len(split[i]))
    sizes = [len(split[i]) for i in order]
    numbers = _numbers([w for i in order for w in split[i]])
    starts = np.concatenate(([0], np.cumsum(np.asarray(sizes, np.int64) + 1)))[:-1]
    marked = np.empty(len(numbers) + len(sizes), np.int64)
    marks = starts + np.asarray(sizes, np.int64)
    marked[marks] = -1 - np.arange(len(sizes))
    rest = np.ones(len(marked), bool)
    rest[marks] = False
    marked[rest] = numbers
    found = find_runs(marked, sizes)
    gone = np.zeros(len(marked) + 1, np.int64)
    runs: list[list[dict]] = [[] for _ in texts]
    for (start, end, period), k in zip(found, np.searchsorted(starts, [f[0] for f in found], side="right") - 1, strict=True):
        gone[start + period] += 1
        gone[end] -= 1
        runs[order[k]].append({"start": start - int(starts[k]), "length": end - start, "period": period})
    stays = np.cumsum(gone)[:-1] == 0
    collapsed = [b""] * len(texts)
    for k, i in enumerate(order):
        kept = compress(split[i], stays[starts[k] : marks[k]].tolist()) if runs[i] else split[i]
        collapsed[i] = b" ".join(kept)
    for own in runs:
        own.sort(key=lambda r: (r["start"], r["period"]))
    return [len(s) for s in split], runs, collapsed


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        lengths = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
        begin = 0
        while begin < len(lengths):
            end, held = begin + 1, lengths[begin]
            while end < len(lengths) and held + lengths[end] <= FLUSH_BYTES:
                held += lengths[end]
                end += 1
            n_words, runs, collapsed = _judge([t or b"" for t in texts.slice(begin, end - begin).to_pylist()])
            columns = [ids.slice(begin, end - begin), pa.array(n_words, pa.int64()), pa.array(runs, pa.list_(pa.struct([(k, pa.int64()) for k in RUN.names]))), pa.array(collapsed, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "collapsed"])
            begin = end


def periodic_runs(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` for each row: runs by start and period (``start`` a word
    number from 0), and the text without the words that any run repeats after its first period.

    Arrow batches count rows: with long texts run it within ``text_batches``.
    """
    schema = StructType([StructField("doc_id", docs.schema["doc_id"].dataType), StructField("n_words", LongType()), StructField("runs", ArrayType(RUN)), StructField("collapsed", StringType())])
    return docs.select("doc_id", docs["text"].cast("binary")).mapInArrow(_batches, schema)


def strongest(runs: Column) -> Column:
    """The run with the greatest length over period; of equal ones the first."""
    more = lambda r, best: r["length"] * best["period"] > best["length"] * r["period"]
    return F.aggregate(runs, F.lit(None).cast(RUN), lambda best, r: F.when(best.isNull() | more(r, best), r).otherwise(best))


def with_tails(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` with a periodic tail in about a tenth of the texts, drawn by the CRC of the id."""
    crc = F.crc32(F.col("doc_id").cast("string"))
    worded = docs.select("doc_id", "text", crc.alias("_h")).select("doc_id", "text", F.floor(F.col("_h") / 10).alias("_g"), F.when(F.col("_h") % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("_words"))
    n = F.size("_words")
    a = F.when(n > 0, F.col("_g") % n).cast("int")
    placed = worded.select("doc_id", "text", "_words", n.alias("_n"), a.alias("_a"), (F.lit(1) + F.floor((n - a) / (F.lit(3) + F.col("_g") % 8))).cast("int").alias("_p"))
    again = F.flatten(F.array_repeat(F.slice("_words", F.col("_a") + 1, F.col("_p")), F.ceil((F.col("_n") - F.col("_a")) / F.col("_p")).cast("int")))
    tailed = F.array_join(F.concat(F.slice("_words", F.lit(1), F.col("_a")), F.slice(again, F.lit(1), F.col("_n") - F.col("_a"))), " ")
    return placed.select("doc_id", F.when(F.col("_n") > 0, tailed).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each of ``documents``."""
    found = periodic_runs(with_tails(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    best = found.withColumn("_best", strongest(F.col("runs")))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    lines = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    digests = best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *[F.col("_best")[k].alias(k) for k in RUN.names],
        F.floor(F.lit(1000) * F.col("_best")["length"] / F.col("_best")["period"]).cast("long").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
    return Scratch(spark, "periodic-runs").write_texts(digests, "digests")
