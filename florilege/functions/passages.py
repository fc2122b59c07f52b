"""Reports as running text: what is said after a citation, sections of acts, numbered paragraphs."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A printed citation: year, volume, reporter, page.
CITATION = r"\([0-9]{4}\) [0-9]{1,6} [A-Z]{2,6} [0-9]{1,9}"
#: Where the next case begins: its name has a "v.", or a blank line stands before it.
NEXT_CASE = r"\sv\.?\s|\n[ \t]*\n"
#: Words of annotation behind a citation.
ANNOTATION = r"(?i)(overruled|doubted|distinguished|relied on|followed|approved|referred to)"
#: Phrases and what they do to the case cited, the first that fits counts. Parts and
#: negations stand before the words they hold.
TREATMENTS = (
    (r"(?i)partly overruled|partially overruled|overruled in part|overruled to an? extent", "overruled_in_part"),
    (r"(?i)not per incuriam|not overruled", "cites"),
    (r"(?i)not (?:to be )?good law|not (?:the )?correct law|no longer good law|does not lay down the correct law", "overruled"),
    (r"(?i)overruled", "overruled"),
    (r"(?i)per incuriam|doubted", "doubted"),
    (r"(?i)distinguished", "distinguished"),
    (r"(?i)relied (?:on|upon)|followed", "followed"),
    (r"(?i)approved", "approved"),
)
#: A section and the act that follows it: only subsections and "of the", "under" or "r/w" may stand between.
SECTION = (
    r"(?:[Ss]ections? |[Ss]\. ?)([0-9]{1,4}[A-Z]{0,2})[\s,]{0,9}(?:\([0-9A-Za-z]{1,4}\)\s{0,9}){0,6}(?:of (?:the )?|under (?:the )?|r/w )?"
    r"(IPC|CrPC|CPC|NI Act|[A-Z][A-Za-z]{0,30}(?: (?:[A-Z][A-Za-z]{0,30}|of|and)){0,8} (?:Act|Code)(?:, [0-9]{4})?)"
)
#: Other spellings of an act.
ACTS = (
    (("PENAL CODE", "IPC"), "INDIAN PENAL CODE"),
    (("CRIMINAL PROCEDURE", "CRIMINAL PROCEDURE CODE", "CRPC"), "CODE OF CRIMINAL PROCEDURE"),
    (("CIVIL PROCEDURE", "CIVIL PROCEDURE CODE", "CPC"), "CODE OF CIVIL PROCEDURE"),
    (("EVIDENCE ACT",), "INDIAN EVIDENCE ACT"),
    (("NEGOTIABLE INSTRUMENT ACT", "NI ACT"), "NEGOTIABLE INSTRUMENTS ACT"),
)
PARAGRAPH = r"(?i)para(?:graph)?s?\.? "
RANGE, LIST, SINGLE = PARAGRAPH + r"([0-9]{1,4}) ?(?:to|-|–) ?([0-9]{1,4})", PARAGRAPH + r"([0-9]{1,4}(?:(?:, ?| and )[0-9]{1,4})+)", PARAGRAPH + r"([0-9]{1,4})"
#: Lists of citations, headnotes and pinpoints in brackets say nothing of the paragraphs of a case.
NOT_PROSE = r"(?i)case law cited|list of citations|cases? referred|headnote|\[ ?paras?\.? ?[0-9]"
LONGEST_RANGE = 30
OPENER = re.compile(r"[ \t]*(?:\( *([0-9]{1,4}) *\)|([0-9]{1,4}) *[.)])\s+")


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` worked out once: a plan writes a column out wherever it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def literals(pattern: str) -> list[str]:
    """All that a pattern of TREATMENTS matches, in lower case: alternatives, optional letters and groups, no more."""
    out = []
    for whole in re.split(r"\|(?![^()]*\))", pattern.removeprefix("(?i)")):
        if group := re.search(r"\(\?:([^()]*)\)(\??)", whole):
            for part in group[1].split("|") + [""] * bool(group[2]):
                out += literals(whole[: group.start()] + part.replace("?", "\0") + whole[group.end() :])
        elif letter := re.search(r"(.)[?\0]", whole):
            out += literals(whole[: letter.start()] + letter[1] + whole[letter.end() :]) + literals(whole[: letter.start()] + whole[letter.end() :])
        else:
            out.append(whole)
    return out


def treatment(low: Column) -> Column:
    """What words do to a case: the first entry of TREATMENTS that fits, else ``cites``. ``low``: the words in lower case."""
    chosen = F.when(F.lit(False), "")
    for pattern, name in TREATMENTS:
        chosen = chosen.when(reduce(Column.__or__, [F.contains(low, F.lit(phrase)) for phrase in literals(pattern)]), name)
    return chosen.otherwise("cites")


#: Without one of these a text has no NEXT_CASE; to look for them takes less than the pattern.
MAY_END = tuple(f"{blank}v" for blank in " \t\n\x0b\f\r") + ("\n\n", "\n ", "\n\t")


def _may_end(words: Column) -> Column:
    return reduce(Column.__or__, [F.contains(words, F.lit(x)) for x in MAY_END])


def treatments(docs: DataFrame, key: str, text: str, window: int = 220, near: int = 80) -> DataFrame:
    """``key, ordinal, citation, annotation, treatment`` for each citation. The annotation is the first
    marker in the ``window`` characters behind it, the treatment is read from ``near`` characters; both
    end where the next case begins. Texts without citations, null and empty ones give no rows; a
    repeated text repeats its rows. The text behind a citation comes with a lookahead, so no offsets
    are added up and the work is linear in the text."""
    # a citation has one bracket, its first character, so that none begins in another
    shape = F.lit(f"(?=({CITATION}(?s:.{{0,{window}}})))\\(")
    own = lambda m: F.regexp_extract(m, f"^{CITATION}", 0)
    reach = lambda c: F.lower(F.when(_may_end(c), F.get(F.split(c, NEXT_CASE, 2), F.lit(0))).otherwise(c))
    behind = lambda c, a: F.struct(c.alias("citation"), once(a, reach).alias("far"), once(F.substring(a, 1, near), reach).alias("near"))
    read = lambda m: once(own(m), lambda c: once(F.substring(m, F.length(c) + 1, F.lit(window)), lambda a: behind(c, a)))
    # read before the rows are made, so that each is read once
    told = F.transform(F.regexp_extract_all(F.col(text), shape, F.lit(1)), read)
    each = docs.select(key, F.posexplode(told).alias("at", "m"))
    # most places are passed by their letter
    markers = ANNOTATION.removeprefix("(?i)")
    begin = "".join(sorted({phrase[0] for phrase in literals(markers[1:-1])}))
    marker = F.regexp_extract("m.far", f"(?=[{begin}]){markers}", 1)
    return each.select(key, (F.col("at") + 1).alias("ordinal"), F.col("m.citation").alias("citation"), marker.alias("annotation"), treatment(F.col("m.near")).alias("treatment"))


def canonical_act(act: Column) -> Column:
    """Upper case, without year and leading article; only listed spellings are folded into one."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.upper(act), r"^THE\s+", ""), r"\s*,?\s*[0-9]{4}\s*$", ""), r"\s+", " "))
    out = F.when(F.lit(False), "")
    for spellings, name in ACTS:
        out = out.when(clean.isin(*spellings), name)
    return out.otherwise(clean)


def section_references(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, act, section, n``: sections that name their act. A section whose act stands in another
    clause is not taken. Null and empty texts give no rows."""
    found = F.regexp_extract_all(text, F.lit(SECTION), F.lit(0))
    each = docs.select(key, F.explode(found).alias("r"))
    act = canonical_act(F.regexp_extract("r", SECTION, 2))
    return each.groupBy(key, act.alias("act"), F.upper(F.regexp_extract("r", SECTION, 1)).alias("section")).agg(F.count(F.lit(1)).alias("n"))


def paragraph_numbers(words: Column) -> Column:
    """Paragraphs that a passage names, ascending, from the most exact form it holds: ranges, else lists,
    else single numbers. Null where the passage is not prose, a range is reversed or longer than
    LONGEST_RANGE, or nothing is named; numbers outside 1 to 999 are years and go."""
    numbers = lambda w, pattern, group: F.regexp_extract_all(w, F.lit(pattern), F.lit(group))
    ends = lambda r: F.struct(F.regexp_extract(r, RANGE, 1).cast("int").alias("low"), F.regexp_extract(r, RANGE, 2).cast("int").alias("high"))
    wrong = lambda x: (x["high"] <= x["low"]) | (x["high"] - x["low"] > LONGEST_RANGE)
    ranged = lambda r: F.when(F.exists(r, wrong), None).otherwise(F.flatten(F.transform(r, lambda x: F.sequence(x["low"], F.greatest(x["low"], x["high"])))))
    listed = lambda w: numbers(F.array_join(numbers(w, LIST, 1), " "), "[0-9]+", 0).cast("array<int>")
    plain = lambda w: once(listed(w), lambda n: F.when(F.size(n) > 0, n).otherwise(numbers(w, SINGLE, 1).cast("array<int>")))
    prose = lambda w: once(numbers(w, RANGE, 0), lambda r: F.when(F.size(r) > 0, once(F.transform(r, ends), ranged)).otherwise(plain(w)))
    # nothing is named, and no other pattern can match, without these four letters
    named = once(words, lambda w: F.when(~F.contains(F.lower(w), F.lit("para")), None).when(w.rlike(NOT_PROSE), None).otherwise(prose(w)))
    kept = F.array_sort(F.array_distinct(F.filter(named, lambda n: (n > 0) & (n < 1000))))
    return once(kept, lambda k: F.when(F.size(k) > 0, k))


def _split(text: str | None, first: int, gap: int, least: int) -> list[tuple[int | None, int, int]]:
    """Number, start and size of each paragraph of one text."""
    text = text or ""
    if not text.strip():
        return []
    opened: list[tuple[int | None, int]] = []
    last = at = 0
    for line in text.split("\n"):
        match = OPENER.match(line)
        number = int(match[1] or match[2]) if match else -1
        if number >= 0 and (last < number <= last + gap if last else number <= first):
            opened.append((number, at))
            last = number
        elif not opened:
            opened.append((None, at))
        at += len(line) + 1
    kept: list[list] = []
    for (number, start), end in zip(opened, [start for _, start in opened[1:]] + [len(text)], strict=True):
        if kept and end - start < least:
            kept[-1][2] = end - kept[-1][1]
        else:
            kept.append([number, start, end - start])
    return [tuple(p) for p in kept]


def paragraphs(docs: DataFrame, key: str, text: str, first: int = 20, gap: int = 3, least: int = 40) -> DataFrame:
    """``key, ordinal, number, start, size``: paragraphs opened by numbers that go on counting. The first
    number is at most ``first``, each later one at most ``gap`` above the one before; what is shorter than
    ``least`` joins its predecessor. Text before the first number is a paragraph without one. Whether
    a number opens depends on all numbers that did before, so a worker walks the lines of a text; null
    and blank texts give no rows."""

    @F.pandas_udf("array<struct<number:int,start:int,size:int>>")
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: _split(x, first, gap, least))

    each = docs.select(key, F.posexplode(split(F.col(text))).alias("at", "p"))
    return each.select(key, (F.col("at") + 1).alias("ordinal"), "p.number", "p.start", "p.size")


#: Quotation marks and dashes, and what stands for them.
MARKS = str.maketrans({"‘": "'", "’": "'", "‚": "'", "“": '"', "”": '"', "„": '"', "–": "-", "—": "-", "−": "-", " ": " "})


def canonical_marks(text: Column) -> Column:
    """NFKC, then plain quotation marks and dashes. Null stays null."""

    @F.pandas_udf("string")
    def plain(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x.translate(MARKS)).translate(MARKS))

    return plain(text)
