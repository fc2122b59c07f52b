"""Conversation structure repair: the cheapest edits that make roles alternate.

Rows are kept, given another role or deleted, and rows without text inserted, so that the initials of
the roles read ``(s?(ua)+)?``: perhaps a system row, then user and assistant in turns, or nothing.
Keeping costs nothing, a new role ``REROLE``, a deletion ``DELETE``, an insertion ``INSERT``, and a
truncated row that stays ``TRUNCATED`` more. Blank rows and rows that were said before have to go. Of
edits that cost the same, those whose initials (D, I, K, R) read first in ASCII order are taken.

Secondary-sorted streaming: rows are shuffled by conversation and sorted by turn, and a generator over
Arrow batches carries the state of the dynamic programme from row to row and from batch to batch. The
first stream runs from the last turn to the first: its state is the cost of what is still to come,
for each of four states of the pattern, and for each row it leaves one small number, the best edit in
each of these states (two bits each). These backpointers go with their rows to a table in the shared
folder. The second stream runs from the first turn to the last, follows them, and writes the repaired
rows or one line for each conversation. So a task holds four costs, or one state, whatever the length
of a conversation; only the string of edits, a letter for each row, is as long as its conversation.
A conversation is one stream: its repair cannot be split, though its memory does not grow.

Whether a row was said before (equal role and text, earlier in the conversation) is found by the first
turn of each (conversation, role, digest of the text) that comes in several turns, an aggregate that
is combined before the shuffle; copies within a turn are neighbours in the sorted stream.

Defined results: a null role or text is one blank; a null turn comes first; rows of one turn go by role
and text, in the order of their bytes; a null conversation id is a conversation of its own; an empty
role is one blank, as it has no initial; rows that repeat are rows said before; extra columns are
ignored, whatever their names; texts of any length are taken whole; an empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, ShortType, StringType, StructField, StructType

from florilege.llm.scratch import Scratch

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
SOUND, BLANK, SAID, CUT = range(4)
#: States of the pattern: nothing yet, after s, after u, after a.
NOTHING, AFTER_S, AFTER_U, AFTER_A = range(4)
#: The state that an inserted or renamed row leads to.
NEXT = {NOTHING: AFTER_U, AFTER_S: AFTER_U, AFTER_U: AFTER_A, AFTER_A: AFTER_U}
KEPT = {(NOTHING, "s"): AFTER_S, (NOTHING, "u"): AFTER_U, (AFTER_S, "u"): AFTER_U, (AFTER_U, "a"): AFTER_A, (AFTER_A, "u"): AFTER_U}
ROLE = {AFTER_U: "user", AFTER_A: "assistant"}
#: Costs after the last row: rows are inserted until the pattern may end.
AT_END = (0, 2 * INSERT, INSERT, 0)
EDITS = "DIKR"

_SPACE = " \t\n\v\f\r"


def step_back(after: tuple[int, ...], initial: str, fault: int) -> tuple[tuple[int, ...], int]:
    """Costs in front of a row, from those behind it, less their minimum, and the best edit in each
    state, two bits each."""
    own = []
    for state in range(4):
        edits = {"D": DELETE + after[state]}
        if fault in (SOUND, CUT):
            more = TRUNCATED if fault == CUT else 0
            if (state, initial) in KEPT:
                edits["K"] = more + after[KEPT[state, initial]]
            edits["R"] = REROLE + more + after[NEXT[state]]
        own.append(edits)
    cost = [min(e.values()) for e in own]
    for _ in range(3):  # inserted rows in front of the row; each costs, so they end
        cost = [min(c, INSERT + cost[NEXT[state]]) for state, c in enumerate(cost)]
    bits = 0
    for state, edits in enumerate(own):
        edits["I"] = INSERT + cost[NEXT[state]]
        bits |= EDITS.index(min(e for e, c in edits.items() if c == cost[state])) << 2 * state
    least = min(cost)
    return tuple(c - least for c in cost), bits


def _fault(text: str, said: bool) -> int:
    end = text.rstrip(_SPACE)
    return BLANK if not end else SAID if said else SOUND if end[-1] in ".!?" else CUT


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns], strict=True)


def _out(rows: Iterator[tuple], schema: pa.Schema, many: int = 500, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Batches of ``rows`` of bounded numbers of rows and characters."""
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += sum(len(v) for v in row if isinstance(v, str))
        if len(held) >= many or size >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema, strict=True)], schema=schema)


def _backward(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """From the last row of a conversation to the first: ``(conversation, number from the end, turn, role,
    text, fault, edits)``. A row waits for the one before it, of which it may be a copy."""
    costs, number, waiting = AT_END, 0, None
    seen: dict[tuple, tuple] = {}  # few: costs are less their minimum, initials all but s, u and a alike

    def judged(before: tuple | None) -> tuple:
        nonlocal costs
        conv, turn, role, text, again = waiting
        fault = _fault(text, again or before == waiting)
        at = costs, role[0] if role[0] in "sua" else "", fault
        if at not in seen:
            seen[at] = step_back(*at)
        costs, bits = seen[at]
        return conv, number, turn, role, text, fault, bits

    for row in _rows(batches):
        if waiting is not None:
            yield judged(row)
            number += 1
            if row[0] != waiting[0]:
                costs, number = AT_END, 0
        waiting = row
    if waiting is not None:
        yield judged(None)


def _forward(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """From the first row to the last, along the best edits: ``(row or None, edit, role, text)``; a row that
    goes has no role. After each conversation None comes."""
    state, conv, begun = NOTHING, None, False

    def insert() -> tuple:
        nonlocal state
        state = NEXT[state]
        return None, "I", ROLE[state], ""

    for row in _rows(batches):
        if begun and row[0] != conv:
            while state in (AFTER_S, AFTER_U):
                yield insert()
            yield None
            state = NOTHING
        conv, begun = row[0], True
        role, text, bits = row[3], row[4], row[6]
        while (edit := EDITS[bits >> 2 * state & 3]) == "I":
            yield insert()
        if edit == "D":
            yield row, "D", None, text
        elif edit == "K":
            state = KEPT[state, role[0]]
            yield row, "K", role, text
        else:
            state = NEXT[state]
            yield row, "R", ROLE[state], text
    if begun:
        while state in (AFTER_S, AFTER_U):
            yield insert()
        yield None


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    held: list[tuple] = []  # rows inserted in front of the first row, whose conversation is not yet known
    conv, known, position = None, False, 0
    for step in _forward(batches):
        if step is None:
            known, position = False, 0
            continue
        row, edit, role, text = step
        if row is not None and not known:
            conv, known = row[0], True
            for waiting in held:
                yield conv, position, None, *waiting
                position += 1
            held = []
        if role is None:
            continue
        if not known:
            held.append((edit, role, text))
            continue
        yield conv, position, None if row is None else row[2], edit, role, text
        position += 1


class _Report:
    def __init__(self):
        self.conv, self.turns, self.last, self.least, self.faults, self.illegal, self.cost = None, 0, None, None, [0, 0, 0, 0], 0, 0
        self.before: str | None = None
        self.audit, self.digest, self.empty = bytearray(), hashlib.sha256(), True

    def add(self, row: tuple | None, edit: str, role: str | None, text: str) -> None:
        self.audit += edit.encode()
        if row is not None:
            self.conv, _, turn, own, _, fault, _ = row
            if turn is not None and turn != self.last:
                self.turns += 1
                self.least = turn if self.least is None else self.least
                self.last = turn
            self.faults[fault] += 1
            self.illegal += self.before is not None and self.before + own[0] not in ("su", "ua", "au")
            self.before = own[0]
            if edit != "D" and fault == CUT:
                self.cost += TRUNCATED
        self.cost += {"D": DELETE, "I": INSERT, "K": 0, "R": REROLE}[edit]
        if role is not None:
            self.digest.update(("" if self.empty else "\n").encode() + f"{role}:{text}".encode())
            self.empty = False

    def line(self) -> tuple:
        gaps = self.last - self.least + 1 - self.turns if self.turns else 0
        return self.conv, gaps, *self.faults[1:], self.illegal, self.cost, self.audit.decode(), self.digest.hexdigest()


def _reports(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    report = _Report()
    for step in _forward(batches):
        if step is None:
            yield report.line()
            report = _Report()
        else:
            report.add(*step)


LINE = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _spread(df: DataFrame, make, fields: list[StructField]) -> DataFrame:
    """``df`` through a generator of rows whose first column is the conversation."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = StructType([StructField("conv_id", df.schema["conv_id"].dataType), *fields])
    arrow = to_arrow_schema(schema)
    return df.mapInArrow(lambda batches: _out(make(batches), arrow), schema)


def with_edits(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """A table of ``rows`` with their faults and best edits: ``conv_id, _n, turn, role, text, fault, edits``.
    ``_n`` counts from the end of a conversation."""
    blank = lambda c: F.when(c.isNull() | (c == ""), " ").otherwise(c)
    base = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), blank(F.col("role")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text")).withColumn("_digest", F.sha2("text", 256))
    at: Column = F.struct(F.col("turn").isNotNull().alias("has"), F.coalesce("turn", F.lit(0)).alias("turn"))
    keys = ["conv_id", "role", "_digest"]
    firsts = base.groupBy(*keys).agg(F.min(at).alias("first"), F.max(at).alias("last")).where("first <> last").select(*[F.col(k).alias(f"_of_{k}") for k in keys], "first")
    firsts = scratch.write(firsts, "said")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    flagged = base.join(firsts, same, "left").select("conv_id", "turn", "role", "text", F.coalesce(at > F.col("first"), F.lit(False)).alias("again"))
    dealt = flagged.repartition("conv_id").sortWithinPartitions("conv_id", F.desc_nulls_last("turn"), F.desc("role"), F.desc("text"))
    fields = [StructField("_n", LongType()), StructField("turn", LongType()), StructField("role", StringType()), StructField("text", StringType()), StructField("fault", ShortType()), StructField("edits", ShortType())]
    return scratch.write_texts(_spread(dealt, _backward, fields), "edits")


def _onward(edits: DataFrame) -> DataFrame:
    return edits.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("_n"))


def repair(rows: DataFrame) -> DataFrame:
    """``conv_id, position, turn, edit, role, text``: the repaired rows; inserted ones have no turn."""
    scratch = Scratch(rows.sparkSession, "conversations")
    fields = [StructField("position", LongType()), StructField("turn", LongType()), *[StructField(k, StringType()) for k in ("edit", "role", "text")]]
    return scratch.write_texts(_spread(_onward(with_edits(rows, scratch)), _repaired, fields), "repaired")


def report(rows: DataFrame) -> DataFrame:
    """One line for each conversation: gaps in its turns, faults, illegal neighbours, the cost, the edits and
    the digest of the repaired rows."""
    scratch = Scratch(rows.sparkSession, "conversations")
    fields = [*[StructField(k, LongType()) for k in LINE], StructField("audit", StringType()), StructField("repaired_sha256", StringType())]
    return scratch.write_texts(_spread(_onward(with_edits(rows, scratch)), _reports, fields), "report")


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` with drops, blanks, cut ends, copies and wrong roles, drawn by the CRC of their place."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    drawn = rows.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), (F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20).alias("_d")).where("_d <> 0")
    text = F.when(F.col("_d") == 1, "").when(F.col("_d") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    changed = drawn.select("conv_id", "turn", F.when(F.col("_d") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), F.when(F.col("_d") == 3, 2).otherwise(1))))
    return changed.select("conv_id", "turn", "role", "text")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line for each of the ``conversations``, after damage."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    lines = report(damaged(rows)).withColumnRenamed("conv_id", "_of")
    every = rows.select("conv_id").distinct().join(lines, F.col("conv_id").eqNullSafe(F.col("_of")), "left")
    counts = [F.coalesce(k, F.lit(0).cast("long")).alias(k) for k in LINE]
    return every.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
