"""Benchmark decontamination: a positional inverted index of the training text.

The test items are cut into windows of 13 words (a shorter item is one window). Terms of the items
are counted over all documents, and each window takes its rarest terms as probes. The index stores
the postings of all probe terms: document, position, and the words around it. A window is looked up
from its rarest term: every posting, shifted by the term's offset in the window, is a possible
start; the lists of its next rarest terms, shifted likewise, are intersected with these; what is
left is compared with the stored words, exactly. Words inside occurrences are hit; overlapping
occurrences count once.

The terms and windows of the items are broadcast only in blocks of a bounded size
(``BLOCK_BYTES``); larger item sets take more than one block, each against all documents.

Main path: DataFrame functions only.

Defined results: a null or empty text has no words, is never hit and never contaminated; an item
without words has no windows. Texts of any length are indexed whole. Repeated documents are judged each in its own row; items with equal
text all count. With no items nothing is hit; no documents give an empty result. Columns other than
``doc_id`` and ``text`` (``item_id`` and ``text``) are ignored by :func:`match`;
:func:`remove_contaminated` keeps all columns of the documents, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from florilege.llm.scratch import Scratch, keyed
from florilege.llm.url_filters import ascii_lower

WINDOW = 13
#: Probe terms of a window: its rarest, and those whose lists are intersected with it.
PROBES = 2
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bytes of windows that are broadcast at a time.
BLOCK_BYTES = 16_000_000
#: A document is contaminated when so many times its hit words reach its words.
PART = 20


def words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; a null has none."""
    return F.array_remove(F.split(F.coalesce(ascii_lower(text), F.lit("")), NOT_WORD), "")


def windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """``phrase, items``: the distinct windows and the ids of the items that hold them."""
    cut = items.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    each = cut.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, size))).alias("phrase"))
    return each.groupBy("phrase").agg(F.collect_set("item_id").alias("items"))


def term_counts(docs: DataFrame, terms: DataFrame, small: bool) -> DataFrame:
    """How often each of ``terms`` (column ``term``) occurs in all documents; 0 where it does not."""
    found = docs.select(F.explode(words(F.col("text"))).alias("term"))
    if small:
        found = found.join(F.broadcast(terms), "term")
    counted = found.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return terms.join(counted, "term", "left").select("term", F.coalesce("n", F.lit(0)).alias("n"))


def probes(phrases: DataFrame, counts: DataFrame) -> DataFrame:
    """Each window with its probe terms: ``window, phrase, items, rank (0 the rarest), term, offset``."""
    terms = phrases.select("window", F.posexplode("phrase").alias("offset", "term"))
    first = terms.groupBy("window", "term").agg(F.min("offset").alias("offset")).join(counts, "term")
    order = Window.partitionBy("window").orderBy("n", "term")
    rarest = first.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < PROBES)
    return phrases.join(rarest.drop("n"), "window").withColumn("probes", F.least(F.size(F.array_distinct("phrase")), F.lit(PROBES)))


def postings(docs: DataFrame, terms: DataFrame, context: int) -> DataFrame:
    """``row, doc_id, n_words, term, pos, lead, around`` of every occurrence of ``terms`` (broadcast).
    ``docs``: ``row, doc_id, text``; without ``row``, rows are numbered here.

    Each document also gets a posting of the empty term, at position -1, that holds its length.
    ``around`` has the ``lead`` words before the term, the term, and up to ``context`` after it.
    """
    row = F.col("row") if "row" in docs.columns else F.monotonically_increasing_id().alias("row")
    split = docs.select(row, "doc_id", words(F.col("text")).alias("w"))
    all_terms = F.concat(F.array(F.lit("")), F.col("w"))
    each = split.select("row", "doc_id", "w", F.posexplode(all_terms).alias("at", "term"))
    kept = each.join(F.broadcast(terms), "term")
    lead = F.least(F.col("at") - 1, F.lit(context))
    around = F.when(F.col("at") > 0, F.slice("w", F.greatest(F.col("at") - context, F.lit(1)), F.greatest(lead, F.lit(0)) + context + 1))
    return kept.select("row", "doc_id", F.size("w").cast("long").alias("n_words"), "term", (F.col("at") - 1).alias("pos"), F.greatest(lead, F.lit(0)).alias("lead"), around.alias("around"))


def phrase_starts(index: DataFrame, entries: DataFrame) -> DataFrame:
    """``row, window, start`` of every exact occurrence of the windows in ``entries`` (broadcast)."""
    small = entries.select("window", "term", "offset", "rank", "probes", F.size("phrase").alias("size"), F.when(F.col("rank") == 0, F.col("phrase")).alias("phrase"))
    lists = index.where("pos >= 0").join(F.broadcast(small), "term")
    lists = lists.withColumn("start", F.col("pos") - F.col("offset")).where((F.col("start") >= 0) & (F.col("start") + F.col("size") <= F.col("n_words")))
    same = F.slice("around", F.col("lead") - F.col("offset") + 1, F.col("size")) == F.col("phrase")  # null beyond the rarest term
    met = lists.groupBy("row", "window", "start", "size").agg(F.count(F.lit(1)).alias("met"), F.max("probes").alias("probes"), F.max(F.coalesce(same, F.lit(False))).alias("same"))
    return met.where("met = probes and same").select("row", "window", "start", "size")


def proximity(index: DataFrame, left: str, right: str, within: int) -> DataFrame:
    """``doc_id, left_pos, right_pos`` where two indexed terms stand at most ``within`` words apart.

    Positions are put into bins of ``within`` words, so that only neighbouring bins are joined.
    """
    spot = lambda term, name: index.where(F.col("term") == term).select("row", "doc_id", F.col("pos").alias(name))
    a = spot(left, "left_pos").withColumn("bin", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor(F.col("left_pos") / within) + d)))
    b = spot(right, "right_pos").drop("doc_id").withColumn("bin", F.floor(F.col("right_pos") / within))
    return a.join(b, ["row", "bin"]).where(F.abs(F.col("left_pos") - F.col("right_pos")) <= within).select("doc_id", "left_pos", "right_pos")


def match(docs: DataFrame, items: DataFrame, size: int = WINDOW, scratch: Scratch | None = None) -> DataFrame:
    """``row, doc_id, n_words, n_hit, items`` for each document; ``items``: sorted ids, as strings.
    The result reads the index that this writes to ``scratch``."""
    scratch = scratch or Scratch(docs.sparkSession, "decontamination")
    phrases = windows(items, size).withColumn("window", F.xxhash64(F.array_join("phrase", " ")))
    phrases = scratch.write(phrases, "windows")
    weight = F.sum(F.length(F.array_join("phrase", " ")) + 24 * F.size("phrase") + 16 * F.size("items") + 64)
    n_bytes = phrases.agg(weight).collect()[0][0] or 0
    terms = phrases.select(F.explode("phrase").alias("term")).distinct()
    counts = term_counts(docs.select("text"), scratch.write(terms, "terms"), n_bytes <= BLOCK_BYTES)
    entries = scratch.write(probes(phrases, counts), "entries")
    blocks = -(-n_bytes * PROBES // BLOCK_BYTES) or 1
    read = docs.select("doc_id", "text")
    if blocks > 1:  # one numbering for all blocks
        read = scratch.write(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), "numbered")
    found, heads = [], None
    for b in range(blocks):
        part = entries.where(F.pmod("window", F.lit(blocks)) == b)
        listed = part.select("term").union(docs.sparkSession.createDataFrame([("",)], "term string")).distinct()
        index = scratch.write(postings(read, listed, size - 1), f"postings-{b}")
        heads = heads if heads is not None else index.where("pos < 0").select("row", "doc_id", "n_words")
        starts = phrase_starts(index, part)
        held = part.where("rank = 0").select(F.col("window").alias("_w"), "items")
        found.append(starts.join(F.broadcast(held), F.col("window") == F.col("_w")).select("row", "start", "size", "items"))
    hits = reduce(DataFrame.unionByName, found)
    before = Window.partitionBy("row").orderBy("start", "size").rowsBetween(Window.unboundedPreceding, -1)
    reach = hits.withColumn("end", F.col("start") + F.col("size")).withColumn("seen", F.coalesce(F.max("end").over(before), F.lit(0)))
    fresh = F.greatest(F.col("end") - F.greatest("seen", "start"), F.lit(0))
    ids = F.array_sort(F.transform(F.array_distinct(F.flatten(F.collect_set("items"))), lambda i: i.cast("string")))
    per_doc = reach.groupBy("row").agg(F.sum(fresh).cast("long").alias("n_hit"), ids.alias("items"))
    none = F.array().cast("array<string>")
    return heads.join(per_doc, "row", "left").select("row", "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", none).alias("items"))


def is_contaminated() -> Column:
    return (F.col("n_hit") > 0) & (F.col("n_hit") * PART >= F.col("n_words"))


def remove_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, all columns kept.

    Rows have keys of their own here: each is judged by its text, whatever its id.
    """
    scratch = Scratch(docs.sparkSession, "contaminated")
    rows = keyed(docs, scratch)
    matched = match(rows.select(F.col("_row").alias("doc_id"), F.col("_doc.text").alias("text")), items, scratch=scratch)
    bad = scratch.write(matched.where(is_contaminated()).select(F.col("doc_id").alias("_bad")), "bad")
    scratch.keep_only("bad", "keyed")
    return rows.join(bad, F.col("_row") == F.col("_bad"), "left_anti").select("_doc.*")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return match(docs, items).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        is_contaminated().alias("contaminated"),
    )


OP5_SQL = r"""
WITH low AS (SELECT row_number() OVER () AS k, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
d AS (SELECT k, doc_id, list_filter(string_split_regex(t, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM low),
b AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM benchmark),
starts AS (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, list_slice(w, i, i + 12) AS p FROM starts),
sizes AS (SELECT DISTINCT len(p) AS n FROM win),
spots AS (SELECT k, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM d, sizes WHERE len(w) >= n),
hits AS (SELECT k, i, n, item_id FROM spots JOIN win ON list_slice(w, i, i + n - 1) = p),
hit_words AS (SELECT k, count(DISTINCT j) AS n_hit FROM (SELECT k, unnest(range(i, i + n)) AS j FROM hits) GROUP BY k),
hit_items AS (SELECT k, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT k, item_id::VARCHAR AS s FROM hits) GROUP BY k)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, (coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w)) AS contaminated
FROM d LEFT JOIN hit_words USING (k) LEFT JOIN hit_items USING (k)
"""
