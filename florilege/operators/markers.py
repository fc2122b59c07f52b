"""What stands nearest: markers for spans, by one sweep over merged places; headings in their longest rise.

:func:`nearest` merges spans, markers and guards of a text by place, and gives each span the nearest marker
before or behind it within a reach, unless a guard stands between. Windows over the merged places say it
in one pass; no pair of span and marker is made. :func:`ascending` keeps of numbered headings a longest
rising sequence, so a table of contents or one stray high number does not spoil what follows.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HEADING = re.compile(r"^[ \t]*(\d{1,4})([A-Z]{0,2})\. +(\S[^\n]*)$", re.MULTILINE)


def nearest(spans: DataFrame, markers: DataFrame, guards: DataFrame | None, key: str, reach: int) -> DataFrame:
    """``key, start, end, label, marker, gap, side`` for each of ``spans`` that has a marker in reach.

    ``spans``: ``key, start, end``; ``markers``: those and ``label``; ``guards``: ``key, start, end``. ``gap``
    are the characters between, ``side`` is ``before`` or ``behind``; of two equally near the one before.
    A guard cuts where it begins between the two. Spans of one place are one.
    """
    point = lambda df, role: df.select(key, "start", "end", F.lit(role).alias("role"), (F.col("label") if role == "marker" else F.lit(None).cast("string")).alias("label"))
    merged = point(spans.select(key, "start", "end").distinct(), "span").unionByName(point(markers, "marker"))
    if guards is not None:
        merged = merged.unionByName(point(guards, "guard"))
    line = Window.partitionBy(key).orderBy("start", "end", "role")
    before, behind = line.rowsBetween(Window.unboundedPreceding, -1), line.rowsBetween(1, Window.unboundedFollowing)
    marker = F.when(F.col("role") == "marker", F.struct("start", "end", "label"))
    guard = F.when(F.col("role") == "guard", F.col("start"))
    seen = merged.withColumns({
        "_m0": F.last(marker, ignorenulls=True).over(before), "_g0": F.last(guard, ignorenulls=True).over(before),
        "_m1": F.first(marker, ignorenulls=True).over(behind), "_g1": F.first(guard, ignorenulls=True).over(behind),
    }).where("role = 'span'")
    gap0, gap1 = F.greatest(F.col("start") - F.col("_m0.end"), F.lit(0)), F.greatest(F.col("_m1.start") - F.col("end"), F.lit(0))
    near0 = F.when(F.col("_m0").isNotNull() & (gap0 <= reach) & ~F.coalesce(F.col("_g0") > F.col("_m0.start"), F.lit(False)), gap0)
    near1 = F.when(F.col("_m1").isNotNull() & (gap1 <= reach) & ~F.coalesce(F.col("_g1") < F.col("_m1.start"), F.lit(False)), gap1)
    first = near0.isNotNull() & (near1.isNull() | (near0 <= near1))
    best = F.when(first, F.struct(F.col("_m0.label").alias("label"), F.col("_m0.start").alias("marker"), near0.alias("gap"), F.lit("before").alias("side"))).when(
        near1.isNotNull(), F.struct(F.col("_m1.label").alias("label"), F.col("_m1.start").alias("marker"), near1.alias("gap"), F.lit("behind").alias("side"))
    )
    return seen.select(key, "start", "end", best.alias("_b")).where("_b is not null").select(key, "start", "end", "_b.*")


def longest_rise(keys: list) -> list[int]:
    """Places of a longest strictly rising subsequence, by piles; each pile's last card links back."""
    tops: list = []
    last: list[int] = []
    back = [-1] * len(keys)
    for i, k in enumerate(keys):
        pile = bisect_left(tops, k)
        back[i] = last[pile - 1] if pile else -1
        if pile == len(tops):
            tops.append(k)
            last.append(i)
        else:
            tops[pile], last[pile] = k, i
    out, i = [], last[-1] if last else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def headings(text: str) -> list[tuple[int, int, str, str]]:
    """``place, number, suffix, title`` of the lines that read as numbered headings."""
    return [(m.start(1), int(m[1]), m[2], m[3].strip()) for m in HEADING.finditer(text)]


def _sections(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for key, text in zip(batch["key"], batch["text"], strict=True):
            found = headings(text or "")
            kept = longest_rise([(number, len(suffix), suffix) for _, number, suffix, _ in found])
            stops = [found[i][0] for i in kept[1:]] + [len(text or "")]
            rows += [(key, place + 1, *found[i], stop - found[i][0]) for place, (i, stop) in enumerate(zip(kept, stops))]  # without headings there is a stop too many
        yield pd.DataFrame(rows, columns=["key", "place", "start", "number", "suffix", "title", "size"])


def ascending(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, place, start, number, suffix, title, size``: the headings of each text that rise, by number, then
    suffix (none, A to Z, AA on), and how many characters each section holds."""
    slim = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    return slim.mapInPandas(_sections, "key long, place int, start int, number int, suffix string, title string, size int").withColumnRenamed("key", key)
