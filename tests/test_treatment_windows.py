"""What is said behind a citation, against a plain reading of the patterns."""

from __future__ import annotations

import random
import re

from florilege.functions import passages


def plain(text: str, window: int, near: int) -> list[tuple]:
    out = []
    for i, m in enumerate(re.finditer(passages.CITATION, text), 1):
        reach = lambda n, m=m: re.split(passages.NEXT_CASE, text[m.end() : m.end() + n], maxsplit=1, flags=re.ASCII)[0]
        marker = re.search(passages.ANNOTATION, reach(window))
        said = next((name for pattern, name in passages.TREATMENTS if re.search(pattern, reach(near))), "cites")
        out.append((i, m[0], marker[1].lower() if marker else "", said))
    return out


def test_windows_are_those_of_a_plain_reading(spark):
    rng = random.Random(9)
    parts = ["(2019) 4 SCC 17", "(1999) 123 REP 123456789", "((2001) 1 AB 2", "(19) 4 X 1", " v. ", " v ", "\tv.\n", "\n\n", "\n \t\n", "\x0bv ", "v", "\r", "\u2028", "é😀", ", Overruled", "not overruled", " relied on", "Followed",
             "per incuriam", " partly overruled", "doubted ", "x" * 25, " the court held ", "\n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 40))) for _ in range(400)] + ["", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    for window, near in ((220, 80), (30, 12)):
        got = sorted(tuple(r) for r in passages.treatments(df, "id", "t", window, near).collect())
        assert got == sorted((k, *row) for k, t in enumerate(texts) for row in plain(t or "", window, near))
        assert len({r[4] for r in got}) > 3


def test_the_window_is_not_read_by_a_class_of_everything(spark):
    plan = passages.treatments(spark.createDataFrame([(1, "a")], "id long, t string"), "id", "t")._jdf.queryExecution().optimizedPlan().toString()
    assert "[\\s\\S]" not in plan and plan.count("regexp_extract_all(") == 1
