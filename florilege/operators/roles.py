"""Whose voice a quoted span is in: roles claimed for spans, held against the text before them.

A span is located as :mod:`florilege.operators.spans` does it. The nearest phrase before it, within ``REACH`` characters,
that gives the word to somebody tells the voice: a party's submission, the court, the operative part, a
quotation, or a dissent. Verdicts:

* ``damaged``: the document is known to be unsafe, or empty; nothing is decided on it;
* ``unsupported``: the span is not in the text;
* ``mismatch``: it is, in another voice than its role needs;
* ``unproven``: no phrase in reach, an unknown role, or nothing of what the role needs besides a voice;
* ``accepted``.

A role of the court needs the court or the operative part; what is granted, the operative part; an argument a
submission. An issue has to ask. A day in a span must not be later than the decision. What is quoted is somebody else's voice until the quotation marks close.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from datetime import date

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from florilege.operators.spans import Source, stands

REACH = 600

# Phrases that give the word to somebody.
VOICES = {
    "submission": ("it is contended", "it is submitted", "it is argued", "learned counsel for", "learned counsel appearing", "learned senior counsel", "would submit", "has submitted", "it is the case of", "according to the petitioner", "according to the respondent", "according to the appellant", "the petitioner submits", "the respondent submits", "the appellant submits", "per contra", "on behalf of the petitioner", "on behalf of the respondent", "on behalf of the appellant"),
    "court": ("we are of the view", "we are of the opinion", "i am of the view", "i am of the opinion", "in our opinion", "in our view", "in my opinion", "in my view", "this court is of the view", "we hold", "we find", "we are satisfied", "i hold", "i find", "it is held", "having heard", "having considered", "having regard to", "this court finds", "this court holds"),
    "operative": ("in the result", "for the foregoing reasons", "for the reasons stated", "for the reasons recorded", "in view of the above", "in view of the foregoing", "the petition is allowed", "the petition is dismissed", "the appeal is allowed", "the appeal is dismissed", "the application is allowed", "the application is dismissed", "the following order"),
    "quotation": ("held as follows", "held as under", "observed as follows", "observed as under", "reads as follows", "reads as under", "in the following words", "extracted below", "extracted hereunder", "which reads thus"),
    "dissent": ("i respectfully dissent", "i am unable to agree", "dissenting opinion", "dissenting judgment"),
}
#: The voices that a role may be in.
NEEDS = {
    "holding": ("court", "operative"), "reasoning": ("court", "operative"), "proposition": ("court", "operative"), "court_action": ("court", "operative"), "relief_granted": ("operative",),
    "relief": ("submission",), "argument_petitioner": ("submission",), "argument_respondent": ("submission",), "issue": None, "procedural_event": None,
}
ASKS = ("whether", "the question", "the issue", "the point for")

_VOICE = re.compile("|".join(rf"(?P<{name}>\b(?:{'|'.join(re.escape(p).replace(chr(92) + ' ', ' ') for p in phrases)})\b)" for name, phrases in VOICES.items()), re.IGNORECASE)
_DAY = re.compile(r"\b(\d{1,2})[./-](\d{1,2})[./-](\d{4})\b")


_PHRASES = [(i, name, phrase) for i, (name, phrase) in enumerate((name, phrase) for name, phrases in VOICES.items() for phrase in phrases)]


def voices(text: str) -> list[tuple[int, str, str]]:
    """``end, voice, phrase`` of each phrase, in order. In plain text each phrase is looked up as a string, which is faster than
    the pattern, and taken where the pattern would take it: from the left, of those at one place the first listed."""
    if not text.isascii():
        return [(m.end(), m.lastgroup, m.group().lower()) for m in _VOICE.finditer(text)]
    low = text.lower()
    word = lambda at: 0 <= at < len(low) and (low[at].isalnum() or low[at] == "_")
    held = []
    for i, name, phrase in _PHRASES:
        at = low.find(phrase)
        while at >= 0:
            end = at + len(phrase)
            if not word(at - 1) and not word(end):
                held.append((at, i, end, name, phrase))
            at = low.find(phrase, at + 1)
    out, free = [], 0
    for at, _, end, name, phrase in sorted(held):
        if at >= free:
            out.append((end, name, phrase))
            free = end
    return out


def _quoted(text: str, begin: int, at: int) -> bool:
    """Whether a quotation that opens behind ``begin`` is still open at ``at``: without marks, what follows is quoted."""
    between = text[begin:at]
    marks = sum(between.count(m) for m in "\"“”")
    return marks == 0 or marks % 2 == 1


def _days(span: str) -> list[date]:
    out = []
    for day, month, year in _DAY.findall(span):
        try:
            out.append(date(int(year), int(month), int(day)))
        except ValueError:
            continue
    return out


def verify(role: str, span: str, source: Source, heard: list[tuple[int, str, str]], unsafe: bool, decided: date | None) -> tuple[str, str, int | None, str | None]:
    """``verdict, rule, start, voice``. ``heard``: :func:`voices` of the collapsed text."""
    if unsafe or not source.flat:
        return "damaged", "unsafe" if unsafe else "empty", None, None
    found = stands(span or "", source)
    if found is None:
        return "unsupported", "absent", None, None
    at = source.folded.find(" ".join(span.split()).lower())
    at = at if at >= 0 else source.flat.find(" ".join(span.split()))
    before = heard[bisect_left(heard, at - REACH, key=lambda v: v[0]) : bisect_right(heard, at, key=lambda v: v[0])]
    end, voice, _ = before[-1] if before else (0, None, None)
    if voice == "quotation" and not _quoted(source.flat, end, at):
        # the quotation is closed: the voice before it goes on
        before = [v for v in before if v[1] != "quotation"]
        voice = before[-1][1] if before else "court"
    if role not in NEEDS:
        return "unproven", "unknown_role", found["start"], voice
    if role == "issue":
        asks = "?" in span or any(p in span.lower() for p in ASKS)
        return ("accepted", "asks", found["start"], voice) if asks else ("mismatch", "states", found["start"], voice)
    if role == "procedural_event":
        days = _days(span)
        if not days:
            return "unproven", "no_day", found["start"], voice
        late = decided is not None and max(days) > decided
        return ("mismatch", "after_decision", found["start"], voice) if late else ("accepted", "day", found["start"], voice)
    if voice is None:
        return "unproven", "no_voice", found["start"], None
    return ("accepted" if voice in NEEDS[role] else "mismatch"), voice, found["start"], voice


OUT = "key long, claim_no int, verdict string, rule string, start int, voice string"


def _all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for key, text, unsafe, decided, claims in zip(batch["key"], batch["text"], batch["unsafe"], batch["decided"], batch["claims"], strict=True):
            source = Source(text or "")
            heard = voices(source.flat)
            day = None if pd.isna(decided) else decided
            rows += [(key, i, *verify(c["role"], c["span"], source, heard, bool(unsafe), day)) for i, c in enumerate(claims if claims is not None else ())]
        if rows:
            yield pd.DataFrame(rows, columns=["key", "claim_no", "verdict", "rule", "start", "voice"]).astype({"start": "Int64"})


def verified(docs: DataFrame, key: str) -> DataFrame:
    """``key, claim_no, verdict, rule, start, voice`` of each claim. ``docs``: ``key, text, unsafe, decided, claims``, the
    last an array of ``role, span``."""
    slim = docs.select(F.col(key).cast("long").alias("key"), "text", F.coalesce("unsafe", F.lit(False)).alias("unsafe"), "decided", "claims")
    return slim.mapInPandas(_all, OUT).withColumnRenamed("key", key)
