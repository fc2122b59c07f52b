"""Dispositions in headnotes: lists of cited cases, each list closed by what was done to its cases.

A list reads ``name citation; name citation – disposition``. One pass over the separators, with the entries
that wait for a disposition as its state: an entry is a name with `` v `` in it, before its first citation, of
at most ``NAME_CHARS`` characters; anything else is prose, and what waited before it has no disposition. A
disposition (only the words of ``DISPOSITIONS``, behind a dash, whether or not a stop follows) closes the list. Lines may
end anywhere. Two citations of an entry are parallel only with a colon between them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What closes a list, longest first where one begins another; and which of them move the law.
DISPOSITIONS = ("referred to", "relied on", "partially overruled", "overruled", "followed", "distinguished", "held inapplicable", "affirmed", "approved", "clarified", "explained", "disapproved", "held not correct law", "per incurium")
ADVERSE = ("overruled", "partially overruled", "disapproved", "held not correct law", "per incurium")
SHORT = ("v", "vs", "ltd", "no", "dr", "mr", "mrs", "smt", "ors", "anr", "co", "st", "m", "pvt", "govt", "lt", "assn")
NAME_CHARS = 110

_SEPARATOR = re.compile(r"–\s*(" + "|".join(re.escape(d).replace(r"\ ", r"\s+") for d in sorted(DISPOSITIONS, key=len, reverse=True)) + r")(?=[\s;.]|\Z)\.?|;", re.IGNORECASE)
# How reports print citations, parallel ones, and the header that pages put between.
_SCR = r"\[(\d{4})\]\s*(\d+\s+)?(Suppl?\.?\s*)?(\d+\s*)?SCR\s*(\d+)"
_SCC = r"\((\d{4})\)\s*(Suppl?\.?\s*)?(\d+)\s*SCC\s*(\d+)"
_CITED = re.compile(rf"{_SCR}|{_SCC}|\bAIR\s+\d{{4}}\s+[A-Z]+\s+\d+")
_PAIR = re.compile(rf"(?P<scr>{_SCR})\s*:\s*(?P<scc>{_SCC})|(?P<scc2>{_SCC})\s*:\s*(?P<scr2>{_SCR})")
_HEADER = re.compile(r"\d*\s*\[\d{4}\]\s*\d+\s*S\.C\.R\.\s*(?:Digital\s+Supreme\s+Court\s+Reports)?\s*", re.IGNORECASE)
_SENTENCE = re.compile(r"\b(\w+)\.\s+(?=[A-Z0-9])|\]\s+(?=[A-Z])")
_NAMED = re.compile(r"\sv\.?\s")


def _flat(part: str) -> str:
    """One part of a list on one line, without page headers."""
    # every header has this, in some case
    return " ".join((_HEADER.sub(" ", part) if "s.c.r." in part.casefold() else part).split())


def _entry(flat: str) -> dict | None:
    """``name, scr, scc`` of one part of a list, as :func:`_flat` gives it; None for prose."""
    # no citation begins before one of these
    begins = [at for at in (flat.find("["), flat.find("("), flat.find("AIR")) if at >= 0]
    cited = _CITED.search(flat, min(begins)) if begins else None
    if not cited:
        return None
    name = flat[: cited.start()]
    for end in _SENTENCE.finditer(name):
        word = end[1]
        # a stop behind a word of prose ends a sentence; behind an initial or a short form it does not
        if word is None or (len(word) > 1 and word.lower() not in SHORT and not word.isdigit()):
            name = flat[end.end() : cited.start()]
    name = name.strip(" ,")
    if len(name) > NAME_CHARS or not _NAMED.search(name):
        return None
    pair = _PAIR.search(flat, cited.start()) if ":" in flat else None
    plain = lambda x: x and " ".join(x.split())
    return {"name": name, "scr": plain(pair["scr"] or pair["scr2"]) if pair else None, "scc": plain(pair["scc"] or pair["scc2"]) if pair else None}


def read(text: str) -> Iterator[tuple[int, str, str | None, str | None, str, bool]]:
    """``start, name, scr, scc, disposition, adverse`` of each entry of each closed list; ``start`` is where its
    part of the text begins."""
    waiting: list[tuple[int, dict]] = []
    at = 0
    for mark in _SEPARATOR.finditer(text):
        whole = _flat(text[at : mark.start()])
        found = _entry(whole)
        if found is None:
            waiting = []
        else:
            if not whole.startswith(found["name"]):
                waiting = []  # prose stands in front of the name
            waiting.append((at, found))
        if mark[1]:
            done = " ".join(mark[1].lower().split())
            yield from ((start, e["name"], e["scr"], e["scc"], done, done in ADVERSE) for start, e in waiting)
            waiting = []
        at = mark.end()


def _all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [(key, i, *entry) for key, text in zip(batch["key"], batch["text"], strict=True) for i, entry in enumerate(read(text or ""))]
        yield pd.DataFrame(rows, columns=["key", "entry_no", "start", "name", "scr", "scc", "disposition", "adverse"])


def dispositions(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, entry_no, start, name, scr, scc, disposition, adverse`` of all closed lists of all texts."""
    slim = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    return slim.mapInPandas(_all, "key long, entry_no int, start int, name string, scr string, scc string, disposition string, adverse boolean").withColumnRenamed("key", key)
