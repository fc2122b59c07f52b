"""What workers make of whole texts leaves them a slice at a time."""

from __future__ import annotations

import pandas as pd
import pytest

from florilege.functions import references
from florilege.functions.text import TEXT_ROWS
from florilege.operators import documents, furniture


@pytest.mark.parametrize("run", [documents._chunk, furniture._find_all, references._spots(references.PATTERNS)])
def test_a_large_batch_comes_out_in_slices(run):
    n = 3 * TEXT_ROWS
    batch = pd.DataFrame({"key": range(n), "text": ["Version 1.2 of a text. " * 5] * n})
    out = list(run(iter([batch])))
    assert len(out) == 3 and all(len(set(o.iloc[:, 0])) == TEXT_ROWS for o in out)
    assert sorted(set(pd.concat(out).iloc[:, 0])) == list(range(n))
