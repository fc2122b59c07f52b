"""References in text: case numbers, versions and licences as the citations of the tables."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from florilege.functions.text import in_slices

#: Patterns of what a text can refer to: (kind, pattern). No word boundaries and no case folding, on
#: which regex engines differ beyond ASCII.
PATTERNS = (
    ("licence", r"(?:GNU General Public|MIT|Apache|BSD|CC BY(?:-NC)?(?:-SA)?)(?: [Ll]icen[sc]e)?"),
    ("version", r"[Vv]ersion [0-9]+(?:\.[0-9]+)*"),
    ("address", r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"),
    ("mail", r"[A-Za-z0-9._+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
)


def normal(reference: Column) -> Column:
    """Upper case, other marks than letters, digits and @ to one space."""
    return F.trim(F.regexp_replace(F.upper(reference), r"[^A-Z0-9@]+", " "))


def references(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, kind, reference, n``: what each document refers to, in normal form."""
    def tagged(kind: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda r: F.struct(F.lit(kind).alias("kind"), r.alias("r")))

    found = F.concat(*[tagged(k, p) for k, p in PATTERNS])
    each = docs.select(key, F.explode(found).alias("f")).select(key, "f.kind", normal(F.col("f.r")).alias("reference"))
    return each.groupBy(key, "kind", "reference").agg(F.count(F.lit(1)).alias("n"))


def _spots(patterns: tuple[tuple[str, str], ...]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        compiled = [(kind, re.compile(p)) for kind, p in patterns]
        for batch in in_slices(batches):
            rows = [(key, kind, m.group(), m.start(), m.end()) for key, text in zip(batch["key"], batch["text"], strict=True) for kind, p in compiled for m in p.finditer(text or "")]
            yield pd.DataFrame(rows, columns=["key", "kind", "found", "start", "end"])

    return run


def spots(docs: DataFrame, key: str, text: str, patterns: tuple[tuple[str, str], ...] = PATTERNS) -> DataFrame:
    """``key, kind, found, start, end`` of every reference of every text, in one pass over each text.
    Offsets are code points. Patterns must mean the same to Python and the SQL engines."""
    slim = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    return slim.mapInPandas(_spots(patterns), "key long, kind string, found string, start int, end int").withColumnRenamed("key", key)


def first_offsets(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, kind, reference, start``: the first code point of each reference."""
    return spots(docs, key, text).groupBy(key, "kind", normal(F.col("found")).alias("reference")).agg(F.min("start").alias("start"))


def co_named(docs: DataFrame, key: str, text: str, within: int = 55) -> DataFrame:
    """Pairs of different references of one document whose first places lie within ``within`` characters.

    Places are binned by the reach and met in their own and the next bin, so that a document of many
    references makes no pairs beyond the reach.
    """
    at = first_offsets(docs, key, text).withColumn("_bin", F.floor(F.col("start") / within))
    a = at.select(key, F.explode(F.array("_bin", F.col("_bin") + 1)).alias("_bin"), F.col("_bin").alias("_own"), F.col("reference").alias("a"), F.col("start").alias("sa"))
    b = at.select(key, "_bin", F.col("_bin").alias("_home"), F.col("reference").alias("b"), F.col("start").alias("sb"))
    near = (F.col("sb") - F.col("sa")).between(-within, within) & (F.col("a") != F.col("b")) & ((F.col("_own") < F.col("_home")) | (F.col("a") < F.col("b")))
    pairs = a.join(b, [key, "_bin"]).where(near)
    return pairs.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count(F.lit(1)).alias("n"))
