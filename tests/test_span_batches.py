"""Spans that are looked up together, and texts handed over in slices."""

from __future__ import annotations

import random
import time

import pandas as pd

from florilege.functions.text import TEXT_ROWS, in_slices
from florilege.operators import spans as sp


def _plain(span: str, text: str) -> tuple[int, int]:
    for size in range(min(len(span), len(text)), 0, -1):
        held = [text.find(span[i : i + size]) for i in range(len(span) - size + 1)]
        if any(at >= 0 for at in held):
            return size, min(at for at in held if at >= 0)
    return 0, -1


def test_longest_shared_of_many_spans_against_plain():
    rng = random.Random(5)
    word = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    for letters in ("a", "ab", "abc é\U0001F600"):
        text = word(letters, 60)
        asked = [word(letters + "z", rng.randint(1, 30)) for _ in range(40)] + ["y", text, text[5:40] + "z", "z" + text[-7:], text + text]
        assert sp.longest_shared_all(asked, sp.Source(text)) == [_plain(s, sp.Source(text).folded) for s in asked]
    assert sp.longest_shared_all(["ab"], sp.Source("")) == [(0, -1)] and sp.longest_shared_all([], sp.Source("ab")) == []


def test_many_absent_spans_of_a_long_text_take_no_pass_each():
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(30_000)]
    asked = [" ".join(rng.choice(words) for _ in range(12)) for _ in range(500)]
    began = time.time()
    read = list(sp.judge_all(asked, sp.Source(" ".join(words))))
    assert {r["verdict"] for r in read} == {"absent"} and time.time() - began < 15


def test_gaps_of_a_text_that_repeats_are_read_without_long_comparisons():
    text = "the same words " * 4000
    span = text[:3000] + "q" + text[:3000] + "q" + text[:3000]
    began = time.time()
    assert sp.judge(span, sp.Source(text))["verdict"] in ("partial", "absent")
    assert time.time() - began < 15


def test_slices_keep_all_rows():
    batch = pd.DataFrame({"key": range(2 * TEXT_ROWS + 1)})
    cut = list(in_slices(iter([batch, batch.iloc[:0]])))
    assert [len(c) for c in cut] == [TEXT_ROWS, TEXT_ROWS, 1] and pd.concat(cut).equals(batch)
