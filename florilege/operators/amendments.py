"""Amendment notes to events, events to validity intervals.

A note under a provision lists, numbered, what later acts did to it. :func:`events` reads notes in Arrow
batches, a row for each entry; :func:`intervals` folds the dated events of a provision into versions with the days
from and to which each holds; :func:`in_force` looks a day up.

Rules of an entry: it begins at a number at the start or behind a full stop or closing bracket, unless the word
before it takes a number (``s. 12``), and only while the numbers ascend; a note without numbers is one entry.
``ibid`` stands for the act of the nearest entry before it that names one, in the same note; with none
it stays open. Days are read day first, blanks within allowed; one that the calendar lacks is none, and
none is ever taken from the act's year. An entry without a verb of amendment is kept as ``unread``.
"""

from __future__ import annotations

import re
from datetime import date

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

# Words behind which a number is no entry, and verbs of amendment with their events and what each begins with.
TAKES_NUMBER = frozenset(("s", "ss", "sec", "secs", "sch", "cl", "art", "no", "r", "para", "part", "sub-s"))
VERBS = tuple(
    (name, re.compile(verb, re.IGNORECASE), heads)
    for name, verb, heads in (
        ("renumbered", r"\bre-?(?:numbered|lettered)\b", ("renumbered", "relettered", "re-")),
        ("repealed", r"\brep\.\s*by\b", ("rep.",)),
        ("omitted", r"\bomitted\s*,?\s*(?:by|ibid)\b", ("omitted",)),
        ("substituted", r"\b(?:subs\.?\s*,?\s*(?:by|ibid)|substituted\s+by\b)", ("subs",)),
        ("inserted", r"(?<![a-z])(?:ins\.?|inserted|added)\s*,?\s*(?:by|ibid)", ("ins", "added")),
        ("commenced", r"\bvide\s+notif", ("vide",)),
    )
)
# How notes print an entry's number, an act, a day, a section and the words replaced.
NUMBER = re.compile(r"(?<=[.)] )(\d\d?)\.? ")
ACT = re.compile(r"((?:[A-Z][A-Za-z.]*\s+){0,3}Act)\s+(\d{1,3})\s+of\s+(\d{4})")
DAY = re.compile(r"(?i)w\.e\.f\.\s*(\d{1,2})\s*-\s*(\d{1,2})\s*-\s*(\d{4})")
SECTION = re.compile(r"(?i:\bs)\.\s*(\d+[A-Z]*)")
REPLACED = re.compile('\\bfor\\s+[“"]([^”"]+)[”"]')
FIRST_YEAR, LAST_YEAR = 1830, 2100
_HEADS = tuple((head, verb, name) for name, verb, heads in VERBS for head in heads)


def lower(text: str) -> str:
    """Lower case, character for character, and plain letters for those that ``re.IGNORECASE`` takes for them."""
    return text.lower() if text.isascii() else text.replace("İ", "i").replace("ı", "i").replace("ſ", "s").lower()


def found_at(pattern: re.Pattern, head: str, text: str, low: str) -> re.Match | None:
    """What ``pattern.search(text)`` finds, if all that it matches begins with ``head`` in lower case."""
    at = low.find(head)
    while at >= 0:
        if found := pattern.match(text, at):
            return found
        at = low.find(head, at + 1)
    return None


def entries(note: str) -> list[tuple[int, str]]:
    """``number, text`` of each entry of a note."""
    flat = ". " + " ".join(note.split())  # a number at the start is one behind a full stop, too
    begins: list[tuple[int, int, int]] = []
    for found in NUMBER.finditer(flat):
        start, end = found.span()
        if flat[start - 2] == "." and flat[flat.rfind(" ", 0, start - 1) + 1 : start - 1].lstrip("(").rstrip(".").lower() in TAKES_NUMBER:
            continue
        number = int(found[1])
        if not begins or number > begins[-1][0]:
            begins.append((number, start, end))
    if not begins:
        return [(1, flat[2:])] if len(flat) > 2 else []
    stops = [start for _, start, _ in begins[1:]] + [len(flat)]
    return [(number, flat[end:stop].strip()) for (number, _, end), stop in zip(begins, stops, strict=True)]


def effective_day(entry: str, low: str | None = None) -> date | None:
    found = found_at(DAY, "w.e.f.", entry, low or lower(entry))
    if not found:
        return None
    day, month, year = map(int, found.groups())
    try:
        return date(year, month, day) if FIRST_YEAR <= year <= LAST_YEAR else None
    except ValueError:
        return None


def act(entry: str) -> tuple[str, int, int] | None:
    """Name as printed, number and year of the amending act."""
    found = ACT.search(entry) if "Act" in entry else None
    return (" ".join(found[0].split()), int(found[2]), int(found[3])) if found else None


def event(entry: str, low: str | None = None) -> str | None:
    low = low or lower(entry)
    for head, verb, name in _HEADS:
        if head in low and found_at(verb, head, entry, low):
            return name
    return None


def _first(pattern: re.Pattern, head: str, entry: str, low: str) -> str | None:
    found = found_at(pattern, head, entry, low)
    return found[1].strip() if found else None


FIELDS = {
    "ordinal": "int", "event": "string", "act": "string", "act_number": "int", "act_year": "int", "section": "string",
    "effective": "date", "replaced": "string", "ibid": "string", "verbatim": "string",
}
DATED = ("ordinal", "event", "effective")  # all that :func:`intervals` asks for
_ARROW = {"int": pa.int32(), "string": pa.string(), "date": pa.date32()}


def dated(note: str) -> list[tuple]:
    """The ``DATED`` fields of each entry of a note."""
    rows = []
    for number, text in entries(note):
        low = lower(text)
        kind = event(text, low)
        rows.append((number, kind or "unread", effective_day(text, low) if kind else None))
    return rows


def read(note: str) -> list[tuple]:
    """All ``FIELDS`` of each entry of a note; ``ibid`` is null, ``resolved`` or ``open``."""
    rows, last = [], None
    for number, text in entries(note):
        low = lower(text)
        kind = event(text, low)
        own = act(text) if kind else None
        back = "ibid" in text.lower() and own is None and kind is not None
        last = own or last
        named = own or (last if back else None) or (None, None, None)
        rows.append((
            number, kind or "unread", *named, _first(SECTION, "s.", text, low) if kind else None, effective_day(text, low) if kind else None,
            _first(REPLACED, "for", text, low) if kind else None, ("resolved" if last else "open") if back else None, text,
        ))
    return rows


def events(notes: DataFrame, note: str, fields: tuple[str, ...] = tuple(FIELDS)) -> DataFrame:
    """The columns of ``notes`` but the note, with ``fields``, all of ``FIELDS`` or ``DATED``: a row for each entry.
    Entries come as a column of Arrow batches; a table function would hand over notes and rows one by one."""
    if fields not in (DATED, tuple(FIELDS)):
        raise ValueError(f"fields are {DATED} or {tuple(FIELDS)}")
    reader, types = dated if fields == DATED else read, [(name, _ARROW[FIELDS[name]]) for name in fields]

    def run(batch: pa.Array) -> pa.Array:
        rows, ends = [], [0]
        for text in batch.to_pylist():
            rows += reader(text or "")
            ends.append(len(rows))
        columns = zip(*rows, strict=True) if rows else [()] * len(types)
        held = [pa.array(values, kind) for values, (_, kind) in zip(columns, types, strict=True)]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(held, fields=[pa.field(*kind) for kind in types]))

    listed = arrow_udf(run, f"array<struct<{', '.join(f'{name}:{FIELDS[name]}' for name in fields)}>>")
    return notes.select(*[c for c in notes.columns if c != note], F.inline(listed(note)))


def intervals(found: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, version, valid_from, valid_to, standing, n_events``: what dated events make of a provision. Events
    of one day make one version; it holds until the day before the next (null: until now). Omitted and
    repealed provisions stand again when words are inserted or substituted."""
    ends = F.max(F.when(F.col("event").isin("omitted", "repealed"), F.col("ordinal")))
    begins = F.max(F.when(F.col("event").isin("inserted", "substituted", "commenced"), F.col("ordinal")))
    # dealt by the keys alone, so that days, versions and what is joined to them by the keys need no other deal
    daily = found.where("effective is not null and event <> 'unread'").select(*keys, "ordinal", "event", "effective").repartition(*keys).groupBy(*keys, F.col("effective").alias("valid_from")).agg(F.count(F.lit(1)).alias("n_events"), ends.alias("_ends"), begins.alias("_begins"))
    change = F.when(F.coalesce("_ends", F.lit(-1)) > F.coalesce("_begins", F.lit(-1)), "out").when(F.col("_begins").isNotNull(), "in")
    line = Window.partitionBy(*keys).orderBy("valid_from")
    so_far = F.last(change, ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, 0))
    return daily.select(
        *keys, F.row_number().over(line).alias("version"), "valid_from", F.date_sub(F.lead("valid_from").over(line), 1).alias("valid_to"),
        F.coalesce(so_far, F.lit("in")).alias("standing"), "n_events",
    )


def in_force(asked: DataFrame, keys: list[str], day: Column, versions: DataFrame) -> DataFrame:
    """``asked`` with ``version`` and ``standing`` on ``day``: version 0, standing ``in``, before the first
    event and for provisions without any. ``versions`` are those of :func:`intervals`, of which one at most holds on a day."""
    held = versions.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("version").alias("_version"), F.col("standing").alias("_standing"), "valid_from", "valid_to")
    same = [F.col(k) == F.col(f"_{k}") for k in keys]
    covers = F.col("_day").between(F.col("valid_from"), F.coalesce("valid_to", F.lit(date(9999, 12, 31))))
    found = asked.withColumn("_day", day).join(held, [*same, covers], "left")
    return found.select(*asked.columns, F.coalesce("_version", F.lit(0)).alias("version"), F.coalesce("_standing", F.lit("in")).alias("standing"))
