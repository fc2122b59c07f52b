"""Column functions: legacy fonts, cut words, group ids, half precision, swapped digits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Markers for each thousand characters from which a text is suspect; words whose first letter
#: an extractor may eat, the least hits that judge, the share of cut ones from which a text is truncated;
#: offset and prime of the 32-bit FNV-1a hash.
SUSPECT_MARKERS = 4
PROBES = ("the", "and", "version", "license", "software", "this", "that", "with")
LEAST_PROBES, CUT_MOST = 6, 0.5
FNV_OFFSET, FNV_PRIME = 2166136261, 16777619


def font_verdict(text: Column, marker: str) -> Column:
    """``unknown`` without a text, ``suspect`` if it has many markers and no Devanagari, else ``clean``."""
    rate = F.coalesce(F.try_divide(F.regexp_count(text, F.lit(marker)) * 1000.0, F.length(text)), F.lit(0.0))
    legacy = (F.regexp_count(text, F.lit(r"[\x{0900}-\x{097F}]")) == 0) & (rate >= SUSPECT_MARKERS)
    return F.when(text.isNull(), "unknown").when(legacy, "suspect").otherwise("clean")


def cut_counts(text: Column) -> tuple[Column, Column]:
    """Probes that stand whole in a text, and those without their first letter (0 for a null text)."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))
    held = lambda among: F.coalesce(F.size(F.filter(words, lambda w: w.isin(*among))), F.lit(0)).cast("long")
    whole = F.when(text.isNotNull(), held(PROBES)).otherwise(F.lit(0).cast("long"))
    return whole, F.when(text.isNotNull(), held([p[1:] for p in PROBES])).otherwise(F.lit(0).cast("long"))


def fnv1a(text: Column) -> Column:
    """The 32-bit FNV-1a hash of an ASCII text, as a long; null for null."""
    codes = F.when(F.length(text) > 0, F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.ascii(F.substring(text, i, F.lit(1))))).when(text.isNotNull(), F.array().cast("array<int>"))
    return F.aggregate(codes, F.lit(FNV_OFFSET).cast("long"), lambda h, c: h.bitwiseXOR(c.cast("long")) * FNV_PRIME % (1 << 32))


def half(x: Column) -> Column:
    """A number rounded to half precision (11 bits, ties to even, subnormals below 2^-14), as a double."""
    x = x.cast("double")
    step = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(F.abs(x))), F.lit(-14)) - 10)
    return F.when(x == 0, F.lit(0.0)).otherwise(F.rint(x / step) * step)


def swapped_digits(number: Column) -> Column:
    """A number with its last two digits swapped; null where that changes nothing."""
    s = number.cast("string")
    swapped = F.concat(F.substring(s, F.lit(1), F.length(s) - 2), F.right(s, F.lit(1)), F.substring(s, F.length(s) - 1, F.lit(1)))
    return F.when((F.length(s) >= 2) & (swapped != s), swapped)
