"""Line dedup by pairwise alignment.

Lines (trimmed, blank ones aside) are hashed. Documents overlap if they share a run of consecutive
lines of ``LEAST_WORDS`` words or more, which is far rarer than a line. Every shared block is covered by
the shortest such runs that begin or end at its lines, and what these hold depends on their lines
alone: so the runs are hashed, and their first holder is the document of the smallest id. A later
document is paired with the first holder of each of its runs, and with no other: another earlier
document that holds the run has it from there. So a passage that very many documents share makes one
pair for each of them, and every shared block has a pair that holds it on both sides.

Each pair is aligned by patience diff on its line hashes: lines that are unique on both sides and stand
in the same order are anchors, which grow to blocks; aligned blocks of ``LEAST_WORDS`` words or more are
deleted from the later document. What is left is aligned again, with breaks where blocks were, until
nothing is deleted: so a block that stands elsewhere in the earlier document goes too. What patience diff
cannot anchor, as its lines repeat or as it overlaps a block that is gone, is looked up by its shortest
runs. What any pair deletes goes; a test holds the result against all pairs of earlier documents.

Equal texts form a class of which the smallest id goes on; the lines of later copies all go.
A run that very many documents share makes one row for each of them, not one for each pair.

Defined results: a null text stays null, with no lines. Blank lines are never deleted. Rows that
repeat both id and text are one document and keep the same lines; of two texts under one id the
one with the smaller digest counts as earlier. A null id is later than all others. An empty
table gives an empty result. :func:`remove_repeated` keeps all columns, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from florilege.llm.scratch import Scratch

#: A common block of fewer words stays: short lines coincide by chance.
LEAST_WORDS = 20
LAST = 2**63 - 1
#: Texts that lose lines are broadcast up to so many rows (about 100 bytes each); beyond, the join
#: with the documents shuffles them.
BROADCAST_ROWS = 200_000


def _matches(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned positions of two lists of line hashes, by patience diff."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        at = {b[j]: j for j in range(b0, b1) if in_b[b[j]] == 1}
        common = [(i, at[a[i]]) for i in range(a0, a1) if in_a[a[i]] == 1 and a[i] in at]
        if not common:
            continue
        # the longest increasing sequence, by piles
        tops: list[int] = []
        last: list[int] = []
        back = [-1] * len(common)
        for k, (_, j) in enumerate(common):
            pile = bisect_left(tops, j)
            if pile == len(tops):
                tops.append(j)
                last.append(k)
            else:
                tops[pile], last[pile] = j, k
            back[k] = last[pile - 1] if pile else -1
        k, chain = last[-1], []
        while k >= 0:
            chain.append(common[k])
            k = back[k]
        i, j = a0, b0
        for x, y in [*reversed(chain), (a1, b1)]:
            todo.append((i, x, j, y))
            if x < a1:
                out.append((x, y))
            i, j = x + 1, y + 1
    return sorted(out)


def common_blocks(a: list[int], b: list[int], words: list[int], least: int = LEAST_WORDS) -> list[int]:
    """Positions in ``a`` (with ``words`` in each line) of aligned blocks of ``least`` words or more."""
    gone, run = [], []
    for i, j in [*_matches(a, b), (-2, -2)]:
        if run and (i, j) != (run[-1][0] + 1, run[-1][1] + 1):
            if sum(words[x] for x, _ in run) >= least:
                gone += [x for x, _ in run]
            run = []
        run.append((i, j))
    return gone


def _short_runs(lines: list[int], words: list[int], least: int) -> Iterator[tuple[int, tuple[int, ...]]]:
    """The shortest runs of ``least`` words that begin or end at each line, each with its place."""
    for i in range(len(lines)):
        j = n = 0
        while n < least and i + j < len(lines):
            n, j = n + words[i + j], j + 1
        if n >= least:
            yield i, tuple(lines[i : i + j])
        j = n = 0
        while n < least and i - j >= 0:
            n, j = n + words[i - j], j + 1
        if n >= least:
            yield i - j + 1, tuple(lines[i - j + 1 : i + 1])


def aligned_blocks(a: list[int], b: list[int], words_a: list[int], words_b: list[int], least: int = LEAST_WORDS) -> set[int]:
    """Positions in ``a`` of all blocks that align with ``b``, once and again on what is left."""
    left, gone = list(a), set()
    while new := common_blocks(left, b, words_a, least):
        for i in new:
            gone.add(i)
            left[i] = (1 << 64) + i  # equal to no line
    theirs = {run for _, run in _short_runs(b, words_b, least)}
    for i, run in _short_runs(a, words_a, least):
        if run in theirs:
            gone.update(range(i, i + len(run)))
    return gone


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        places = [sorted(aligned_blocks(a, b, m, n)) for _, a, m, b, n in zip(*columns, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(places, pa.list_(pa.int32()))], ["cls", "places"])


def _runs(lines: Column, words: Column) -> Column:
    """``at, size, run`` of the shortest runs of ``LEAST_WORDS`` words: at each line the one that begins
    there, and the one that ends there unless it is the first kind of an earlier line. A line has a
    word at least, so that a run has no more than ``LEAST_WORDS`` lines."""
    none = F.struct(F.lit(0).alias("w"), F.lit(0).alias("size"))
    taken = lambda near: F.aggregate(near, none, lambda s, w: F.when(s["w"] >= LEAST_WORDS, s).otherwise(F.struct((s["w"] + w).alias("w"), (s["size"] + 1).alias("size"))))
    run = lambda at, size: F.struct(at.alias("at"), size.alias("size"), F.xxhash64(F.slice(lines, at, size)).alias("run"))
    from_here = F.transform(words, lambda _, i: F.struct((i + 1).alias("at"), taken(F.slice(words, i + 1, F.lit(LEAST_WORDS))).alias("t")))
    low = lambda i: F.greatest(i + 2 - LEAST_WORDS, F.lit(1))
    to_here = F.transform(words, lambda w, i: F.struct((i + 1).alias("end"), w.alias("w"), taken(F.reverse(F.slice(words, low(i), i + 2 - low(i)))).alias("t")))
    begin = F.transform(F.filter(from_here, lambda r: r["t"]["w"] >= LEAST_WORDS), lambda r: run(r["at"], r["t"]["size"]))
    end = F.transform(F.filter(to_here, lambda r: r["t"]["w"] - r["w"] >= LEAST_WORDS), lambda r: run(r["end"] + 1 - r["t"]["size"], r["t"]["size"]))
    return F.concat(begin, end)


def _class(text: Column) -> Column:
    return F.unhex(F.md5(text))


def removed_lines(docs: DataFrame) -> DataFrame:
    """``cls, rep, gone``: for each text that loses lines or has copies, its digest, the smallest id
    that carries it, and the numbers (from 0) of the lines that go where it is first."""
    scratch = Scratch(docs.sparkSession, "lines")
    texts = docs.where(docs["text"].isNotNull()).select(docs["doc_id"], docs["text"]).withColumn("cls", _class(F.col("text")))
    classes = texts.groupBy("cls").agg(F.coalesce(F.min("doc_id"), F.lit(LAST)).alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("text").alias("text"))
    numbered = F.filter(F.transform(F.split("text", "\n"), lambda x, i: F.struct(F.trim(x).alias("line"), i.alias("at"))), lambda s: s["line"] != "")
    cut = classes.select("cls", "rep", "copies", numbered.alias("s"))
    lined = scratch.write(
        cut.select("cls", "rep", "copies", F.transform("s", lambda s: F.xxhash64(s["line"])).alias("lines"), F.transform("s", lambda s: F.size(F.split(s["line"], r"\s+"))).alias("words"), F.transform("s", lambda s: s["at"]).alias("at")), "lines"
    )
    each = scratch.write(lined.select("cls", "rep", F.explode(_runs(F.col("lines"), F.col("words"))).alias("r")).select("cls", "rep", "r.*"), "runs")
    holder = F.struct("rep", "cls")
    shared = each.groupBy("run").agg(F.min(holder).alias("first"), F.max(holder).alias("last")).where("first <> last")
    shared = scratch.write(shared.select("run", F.col("first.cls").alias("first")), "shared")
    pairs = scratch.write(each.join(shared, "run").where("first <> cls").select("cls", "first").distinct(), "pairs")
    ours, theirs = lined.select("cls", "lines", "words"), lined.select(F.col("cls").alias("first"), F.col("lines").alias("other"), F.col("words").alias("other_words"))
    both = pairs.join(theirs, "first").drop("first").join(ours, "cls").select("cls", "lines", "words", "other", "other_words")
    aligned = scratch.write_texts(both.mapInArrow(_align, "cls binary, places array<int>").where("size(places) > 0"), "aligned")
    masks = aligned.groupBy("cls").agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"))
    out = lined.select("cls", "rep", "copies", "at").join(masks, "cls", "left").where("copies > 1 or places is not null")
    out = out.withColumn("gone", F.array_sort(F.transform("places", lambda i: F.element_at("at", i + 1))))
    removed = scratch.write(out.select("cls", "rep", F.coalesce("gone", F.array().cast("array<int>")).alias("gone")), "removed")
    scratch.keep_only("removed")
    return F.broadcast(removed) if removed.count() <= BROADCAST_ROWS else removed


def remove_repeated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with ``text`` stripped of repeated blocks, all columns kept."""
    held = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), _class(docs["text"]).alias("_cls"))
    joined = held.join(removed_lines(docs).toDF("_cls", "_rep", "_gone"), "_cls", "left")
    text = kept_text(F.col("_row.text"), F.col("_row.doc_id"), F.col("_rep"), F.col("_gone"))
    return joined.select(*[text.alias("text") if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns])


def kept_text(text: Column, doc_id: Column, rep: Column, gone: Column) -> Column:
    """What stays of a text: all of it unless listed; of a later copy, its blank lines."""
    lines = F.split(text, "\n")
    copy = F.coalesce(doc_id, F.lit(LAST)) != rep
    first = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(gone, i)), "\n")
    return F.when(rep.isNull(), text).when(copy, F.array_join(F.filter(lines, lambda x: F.trim(x) == ""), "\n")).when(F.size(gone) == 0, text).otherwise(first)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, n_lines`` (not blank)``, n_removed, n_chars, text_sha256`` of what is kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    joined = docs.select("doc_id", "text", _class(F.col("text")).alias("cls")).join(removed_lines(docs), "cls", "left")
    count = lambda t: F.coalesce(F.size(F.filter(F.split(t, "\n"), lambda x: F.trim(x) != "")), F.lit(0)).cast("long")
    kept = joined.select("doc_id", count(F.col("text")).alias("n_lines"), kept_text(F.col("text"), F.col("doc_id"), F.col("rep"), F.col("gone")).alias("kept"))
    out = kept.withColumn("n_kept", count(F.col("kept")))
    return out.select("doc_id", "n_lines", (F.col("n_lines") - F.col("n_kept")).alias("n_removed"), F.coalesce(F.length("kept"), F.lit(0)).cast("long").alias("n_chars"), F.sha2("kept", 256).alias("text_sha256"))
