"""Text functions: built-in expressions where they can say it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


#: Rows of whole texts that a worker makes objects of at a time.
TEXT_ROWS = 100


def in_slices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of ``batches``, ``TEXT_ROWS`` at a time: a batch counts rows, texts may be long, and what is made of
    a slice is given away before the next one."""
    for batch in batches:
        for at in range(0, len(batch), TEXT_ROWS):
            yield batch.iloc[at : at + TEXT_ROWS]


def wildcard(pattern: str) -> str:
    """A LIKE pattern from ``*`` and ``?``; the characters LIKE would read are escaped first."""
    escaped = pattern.replace("\\", "\\\\").replace("%", r"\%").replace("_", r"\_")
    return escaped.replace("*", "%").replace("?", "_")


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters a-z and digits. No stemming; both engines can say it."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def lookup_key(value: Column) -> Column:
    """Upper case, letters and digits only: one rule for keys wherever they are compared."""
    return F.upper(F.regexp_replace(value, "[^A-Za-z0-9]", ""))


def lookup_keys(values: Column) -> Column:
    """The keys of an array of values, without nulls and empty ones."""
    return F.filter(F.transform(F.filter(values, lambda v: v.isNotNull()), lookup_key), lambda k: k != "")


def trigrams(value: Column) -> Column:
    """Distinct trigrams of a value padded as fuzzy matching does: two blanks before, one after."""
    padded = F.concat(F.lit("  "), F.lower(value), F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3))))


def jaccard(a: Column, b: Column) -> Column:
    """Size of the intersection over that of the union; null when both are empty."""
    return F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def collapse(text: Column) -> Column:
    """Control characters out, runs of white space to one space, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", ""), r"\s+", " "))
