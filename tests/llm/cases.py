"""Small documents with every awkward case: nulls, empties, one very long text, copies, clashing columns."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, _bucket string, comp int, cls string"


def awkward(spark, extra=()):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = prose(200)
    texts = [None, "", "   \n\t ", "one", "a b c d e", base, base, base + " tail", prose(30), "x" * 5, prose(20_000), "ÉCOLE école", "123 456", *extra]
    rows = [(i, t, None if i % 3 else "en", None if i % 4 == 0 else f"s{i % 2}", None, i, "b", 7, "c") for i, t in enumerate(texts)]
    rows.append(rows[5])  # a repeated row
    rows.append((None, base, "en", "s0", None, 0, "b", 7, "c"))  # a null id
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
