"""Document operators: duplicates, identity, chunks, furniture, references, name matching."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from florilege.functions.text import in_slices

CHUNK_CHARS, CHUNK_TAIL, CHUNK_OVERLAP = 2400, 320, 240


def duplicate_groups(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``content_hash, n, representative``: texts held more than once; the smallest key represents."""
    return docs.groupBy(F.sha2(text, 256).alias("content_hash")).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("representative")).where("n > 1")


def duplicate_members(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``content_hash, key, is_representative`` of every member of a duplicate group."""
    hashed = docs.select(key, F.sha2(text, 256).alias("content_hash"))
    groups = hashed.groupBy("content_hash").agg(F.count(F.lit(1)).alias("_n"), F.min(key).alias("_rep")).where("_n > 1")
    return hashed.join(groups, "content_hash").select("content_hash", key, (F.col(key) == F.col("_rep")).alias("is_representative"))


def identity(strong: Column, medium: Column, weak: Column) -> Column:
    """The first key of a ladder that is there, tagged with its rung."""
    tag = lambda name, c: F.when(c.isNotNull() & (c != ""), F.concat(F.lit(f"{name}:"), c))
    return F.coalesce(tag("strong", strong), tag("medium", medium), tag("weak", weak))


def pack(text: str | None, most: int = CHUNK_CHARS, tail: int = CHUNK_TAIL) -> list[tuple[int, int]]:
    """Spans of a text in chunks, one after the other: paragraphs packed up to ``most`` characters, long
    ones cut at the last sentence end that fits, a tail shorter than ``tail`` joined to the chunk
    before it."""
    if not text or not text.strip():
        return []
    cuts, at = [], 0
    while at < len(text):
        to = text.find("\n\n", at)
        to = len(text) if to < 0 else to + 2
        cuts.append((at, to))
        at = to
    spans: list[list[int]] = []
    for a, b in cuts:
        if spans and b - spans[-1][0] <= most:
            spans[-1][1] = b
            continue
        begin = a
        while b - begin > most:
            end = max(text.rfind(". ", begin, begin + most), text.rfind("\n", begin, begin + most)) + 1
            end = end if end > begin + most // 2 else begin + most
            spans.append([begin, end])
            begin = end
        spans.append([begin, b])
    if len(spans) > 1 and spans[-1][1] - spans[-1][0] < tail:
        last = spans.pop()
        spans[-1][1] = last[1]
    return [(a, b) for a, b in spans]


def _chunk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in in_slices(batches):
        rows = [(key, i, a, b - a, text[max(0, a - CHUNK_OVERLAP) : b]) for key, text in zip(batch["key"], batch["text"], strict=True) for i, (a, b) in enumerate(pack(text))]
        yield pd.DataFrame(rows, columns=["doc_id", "chunk_index", "char_offset", "char_length", "chunk_text"])


def chunks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``doc_id, chunk_index, char_offset, char_length, chunk_text`` (offsets in code points).

    Offset and length are those of the chunk's own part; its text begins with the last ``CHUNK_OVERLAP``
    characters before it, in every chunk but the first.
    """
    schema = "doc_id long, chunk_index int, char_offset int, char_length int, chunk_text string"
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInPandas(_chunk, schema)


def lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, line_no, line`` with lines trimmed and blank ones left out."""
    cut = docs.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    return cut.withColumn("line", F.trim("line")).where("line <> ''")


def repeated_furniture(docs: DataFrame, key: str, text: str, least: int = 2) -> DataFrame:
    """Lines that stand ``least`` times or more in one document: ``key, line, n``."""
    return lines(docs, key, text).groupBy(key, "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def without_furniture(docs: DataFrame, key: str, text: str, least: int = 2) -> DataFrame:
    """``key, text`` with repeated lines kept once, at their first place; empty where no line is left."""
    numbered = lines(docs, key, text).withColumn("_rn", F.row_number().over(Window.partitionBy(key, "line").orderBy("line_no")))
    kept = numbered.where(F.col("_rn") < least)
    joined = kept.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda s: s["line"]), "\n").alias("text"))
    return docs.select(key).join(joined, key, "left").select(key, F.coalesce("text", F.lit("")).alias("text"))


def name_tokens(name: Column) -> Column:
    """Distinct lower-case words of three letters or more."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(name), F.lit("[a-z]+"), F.lit(0)), lambda w: F.length(w) >= 3))


def marker_lift(docs: DataFrame, words: Column, label: Column, least: int) -> DataFrame:
    """``word, pos, neg, lift``: document frequency among positives over that among negatives."""
    held = docs.select(label.alias("_y"), F.explode(F.array_distinct(words)).alias("word")).groupBy("word").agg(F.sum(F.when(F.col("_y"), 1).otherwise(0)).alias("pos"), F.sum(F.when(F.col("_y"), 0).otherwise(1)).alias("neg"))
    totals = docs.agg(F.count_if(label).alias("_p"), F.count_if(~label).alias("_n"))
    lift = ((F.col("pos") + 1) / (F.col("_p") + 2)) / ((F.col("neg") + 1) / (F.col("_n") + 2))
    return held.where(F.col("pos") + F.col("neg") >= least).join(F.broadcast(totals)).select("word", "pos", "neg", F.round(lift, 6).alias("lift"))  # one row


def _runs(text: Column, words: int, inner: bool) -> Column:
    """Hashes of the runs of ``words`` words that white space bounds. Of an ``inner`` text the first and the
    last word may be parts of words elsewhere, so only its first run between them is taken."""

    def hashes(w: Column) -> Column:
        last = F.size(w) - words - (1 if inner else 0)
        starts = F.when(last >= 1, F.array(F.lit(1))).otherwise(F.array()) if inner else F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array())
        return F.transform(starts.cast("array<int>"), lambda i: F.xxhash64(F.slice(w, i + 1, words)))

    # bound as a lambda variable, the split text is evaluated once, not for each run
    return F.array_distinct(F.flatten(F.transform(F.array(F.split(text, r"\s+")), hashes)))


def _grams(text: Column, size: int) -> Column:
    """The different stretches of ``size`` characters of a text."""
    places = F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - (size - 1))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(places, lambda i: F.substring(text, i, F.lit(size))))


def locate(docs: DataFrame, key: str, text: str, items: DataFrame, item: str, words: str, run: int = 4, gram: int = 3, block: int = 500) -> DataFrame:
    """``item, key, start``: each document that holds the text of an item, and where it does first (from 0).

    An item of three words or more is looked up by its first inner words, ``run`` at most, which stand in the
    document as they are; a shorter one by its first characters, ``gram`` at most. Either is an equi-join, with the
    exact test after it; documents are only cut in the ways that some item asks for. A null text holds nothing and is held by nothing, an empty
    item is held by every text (these alone are broadcast, ``block`` at a time); repeated rows of an item or a document each give their rows.
    """
    d_rows = docs.select(F.col(key).alias("_k"), F.col(text).alias("_t"))
    asked = items.select(F.col(item).alias("_i"), F.col(words).alias("_w")).where("_w is not null")
    inner = F.least(F.size(F.split("_w", r"\s+")) - 2, F.lit(run))
    asked = asked.withColumn("_cut", F.when(inner >= 1, inner).otherwise(-F.least(F.length("_w"), F.lit(gram))))
    kinds = sorted(r["_cut"] for r in asked.select("_cut").distinct().collect())  # run + gram + 1 at most
    found = []
    for cut in kinds:
        own = asked.where(F.col("_cut") == cut)
        if cut == 0:
            for i in range(blocks := -(-own.count() // block)):
                part = own.where(F.pmod(F.xxhash64("_i"), F.lit(blocks)) == i)
                found.append(d_rows.where("_t is not null").crossJoin(F.broadcast(part)))
            continue
        name = F.get(_runs(F.col("_w"), cut, True), F.lit(0)) if cut > 0 else F.left("_w", F.lit(-cut))
        held = d_rows.select("_k", F.explode(_runs(F.col("_t"), cut, False) if cut > 0 else _grams(F.col("_t"), -cut)).alias("_h"))
        pairs = held.join(own.select(name.alias("_h"), "_i").distinct(), "_h").select(F.col("_k").alias("_pk"), F.col("_i").alias("_pi")).distinct()
        candidates = pairs.join(own, F.col("_pi").eqNullSafe(F.col("_i"))).join(d_rows, F.col("_pk").eqNullSafe(F.col("_k")))
        found.append(candidates.where(F.contains("_t", F.col("_w"))))
    if not found:
        found = [d_rows.join(asked, F.lit(False))]
    start = (F.expr("instr(_t, _w)") - 1).cast("long")
    return reduce(DataFrame.unionByName, [f.select("_i", "_k", "_t", "_w") for f in found]).select(F.col("_i").alias(item), F.col("_k").alias(key), start.alias("start"))
