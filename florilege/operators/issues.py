"""Statements of issues: the questions that a decision says it answers.

Sentences are read in order. One states an issue if it is a question that opens with a word of ``ASKING``, or if it
announces one: a noun of ``NOUNS`` among its first words, and ``whether`` or a question behind it. Where what is announced is a list,
``(i) whether ...; (ii) whether ...``, each of its points is an issue of its own; a point within a point stays with it.

Refused are statements shorter or longer than ``LEAST`` and ``MOST`` characters, those near the marks of a reporter's headnote, those that
carry a citation (it would hand over the answer), and those that say what the question is not. A sentence that comes twice counts once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST, MOST, AROUND = 40, 200, 600

# Words that ask, nouns that announce, marks of headnotes, forms of citations, negations.
ASKING = ("Whether", "Can", "Does", "Is", "May", "Must")
NOUNS = ("question", "questions", "issue", "issues", "point", "points", "controversy")
HEADNOTE = re.compile(r"\bHELD\s*[:.]|head ?note|(?:Allowing|Dismissing|Disposing of) the appeals?, the Court|case law cited|cases? referred", re.IGNORECASE)
CITED = re.compile(r"\(\s*\d{4}\s*\)\s*\d+\s+[A-Z]{2,6}\s+\d+|\bAIR\s+\d{4}\b|\bINSC\s+\d+")
DENIED = re.compile(r"\b(?:is|was|are|were)\s+not\s+(?:whether|if)\b", re.IGNORECASE)

_SENTENCE = re.compile(r"\S[^.?!]*(?:[.?!](?!\s|\Z)[^.?!]*)*[.?!]?", re.DOTALL)
_POINT = re.compile(r"\((?:[ivx]+|[a-z]|\d{1,2})\)\s*(?=[Ww]hether\b)")


def _points(sentence: str) -> list[tuple[int, str]]:
    """``place, text`` of the points of a list, or of the sentence as a whole."""
    marks = list(_POINT.finditer(sentence))
    if len(marks) < 2:
        return [(0, sentence)]
    stops = [m.start() for m in marks[1:]] + [len(sentence)]
    return [(m.end(), sentence[m.end() : stop].rstrip(" \n;,").removesuffix("; and").removesuffix(" and").rstrip(" ;,")) for m, stop in zip(marks, stops, strict=True)]


def _announces(sentence: str) -> bool:
    words = re.findall(r"[A-Za-z]+", sentence.lower())
    at = next((i for i, w in enumerate(words[:8]) if w in NOUNS), None)
    return at is not None and ("whether" in words[at + 1 :] or sentence.rstrip().endswith("?"))


def statements(text: str) -> list[tuple[int, str, str]]:
    """``start, statement, via`` (``question``, ``announced`` or ``point``), in the order of the text."""
    out: list[tuple[int, str, str]] = []
    seen: set[str] = set()
    for found in _SENTENCE.finditer(text):
        sentence = found.group()
        if sentence.startswith(ASKING) and sentence.endswith("?") and re.match(r"[A-Za-z]+\b", sentence)[0] in ASKING:
            parts = [(0, sentence, "question")]
        elif _announces(sentence):
            listed = _points(sentence)
            parts = [(at, part, "point" if len(listed) > 1 else "announced") for at, part in listed]
        else:
            continue
        for at, part, via in parts:
            flat = " ".join(part.split())
            start = found.start() + at
            around = text[max(0, start - AROUND) : start + AROUND]
            if LEAST <= len(flat) <= MOST and flat.lower() not in seen and not (HEADNOTE.search(around) or CITED.search(flat) or DENIED.search(sentence)):
                seen.add(flat.lower())
                out.append((start, flat, via))
    return out


def _all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [(key, i, *s) for key, text in zip(batch["key"], batch["text"], strict=True) for i, s in enumerate(statements(text or ""), 1)]
        yield pd.DataFrame(rows, columns=["key", "ordinal", "start", "statement", "via"])


def issues(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, ordinal, start, statement, via`` of every statement of every text."""
    slim = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    return slim.mapInPandas(_all, "key long, ordinal int, start int, statement string, via string").withColumnRenamed("key", key)
