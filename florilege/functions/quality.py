"""Text quality, damage and hygiene signals as built-in expressions (patterns without lookaround, so
that other engines can say them too)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Thresholds of the signals.
SINGLE_CHAR_MOST, WORDLIKE_LEAST, MEAN_LEAST, LEAST_TOKENS = 0.3, 0.2, 2.5, 40
ENGLISH_PER_1000 = 12
LONG_RUN, LONG_RUN_MOST = 25, 0.15
KEEP_TOKENS, KEEP_CHARS, KEEP_LEAST = 0.8, 0.8, 5
ENGLISH_WORDS = ("the", "of", "and", "to", "in", "is", "that", "for")


def pieces(text: Column) -> Column:
    """Runs of anything but white space."""
    return F.regexp_extract_all(text, F.lit(r"[^\s]+"), F.lit(0))


def ocr_quality(text: Column) -> Column:
    """1 less the part of alphabetic tokens that are damaged (letters with digits or marks inside), 3 dp."""
    alpha = F.filter(pieces(text), lambda w: w.rlike("[A-Za-z]"))
    damaged = F.filter(alpha, lambda w: w.rlike(r"[A-Za-z][0-9|~^*#%$&]+[A-Za-z]") | w.rlike(r"[|~^*#%$&]{2,}"))
    return F.round(1 - F.coalesce(F.try_divide(F.size(damaged), F.size(alpha)), F.lit(0.0)), 3)


def corruption(w: Column) -> tuple[Column, Column, Column]:
    """(tokens, share of single characters, share of tokens that look like words) of a column of
    :func:`pieces`."""
    n = F.size(w)
    single = F.try_divide(F.size(F.filter(w, lambda x: F.length(x) == 1)), n)
    wordlike = F.try_divide(F.size(F.filter(w, lambda x: x.rlike(r"^[A-Za-z]{3,}[.,;:!?]?$"))), n)
    return n, F.round(single, 6), F.round(wordlike, 6)


def corruption_verdict(n: Column, single: Column, wordlike: Column, mean: Column) -> Column:
    return F.when(n < LEAST_TOKENS, "too_short").when(single > SINGLE_CHAR_MOST, "exploded").when((wordlike < WORDLIKE_LEAST) & (mean < MEAN_LEAST), "garbled").otherwise("sound")


def damage_verdict(text: Column) -> Column:
    """Control, private-use and replacement characters, and long letter runs."""
    n = F.length(text)
    share = lambda pattern: F.coalesce(F.try_divide(F.regexp_count(text, F.lit(pattern)), n), F.lit(0.0))
    long = F.coalesce(F.try_divide(F.aggregate(F.regexp_extract_all(text, F.lit(r"[A-Za-z]{25,}"), F.lit(0)), F.lit(0), lambda s, x: s + F.length(x)), n), F.lit(0.0))
    return F.when(n == 0, "empty").when(share(r"[\x00-\x08\x0B\x0C\x0E-\x1F]") > 0.001, "control").when(share("�") > 0.001, "replacement").when(long > LONG_RUN_MOST, "runs").otherwise("clean")


def english_rate(text: Column) -> Column:
    """Common English words for each thousand tokens."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))
    common = F.size(F.filter(words, lambda w: w.isin(*ENGLISH_WORDS)))
    return F.coalesce(F.round(F.try_divide(common * 1000, F.size(words)), 4), F.lit(0.0))


def keeps_script(old: Column, new: Column) -> Column:
    """May ``new`` replace ``old``: it keeps 0.8 of its tokens and characters (5 tokens or more)."""
    a, b = F.size(pieces(old)), F.size(pieces(new))
    return (a >= KEEP_LEAST) & (b >= KEEP_TOKENS * a) & (F.length(new) >= KEEP_CHARS * F.length(old))


def strip_unstorable(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")


def normal_space(text: Column) -> Column:
    """Runs of blanks to one; three or more line ends to two; trimmed."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def dehyphenate(text: Column) -> Column:
    """Words cut at line ends made whole."""
    return F.regexp_replace(text, r"([A-Za-z])-\n([a-z])", "$1$2")


def digit_trust(text: Column) -> Column:
    """Digit groups that hold look-alike letters (O for 0, l for 1) are not to be trusted."""
    return F.when(text.rlike(r"(?:^|[^0-9A-Za-z_])[0-9]+[OolI][0-9OolI]*(?:$|[^0-9A-Za-z_])"), "substituted").when(text.rlike("[0-9]"), "plain").otherwise("none")
