"""What a block of the vector index gives for the queries that read it."""

from __future__ import annotations

import numpy as np
import pandas as pd

from florilege.operators import vector_index as vi


def test_a_block_gives_one_frame_for_all_its_queries():
    rng = np.random.default_rng(2)
    held = [{"key": i, "tag": None if i == 3 else i % 2, "scale": 0.01, "code": rng.integers(-99, 99, 4).astype(np.int8).tobytes()} for i in range(30)]
    asked = [{"query_id": q, "q": rng.standard_normal(4), "wanted": wanted} for q, wanted in ((0, None), (1, 1), (99, 7), (5, None))]
    out = list(vi._scored(rng.standard_normal((2, 4)), 6)(iter([pd.DataFrame({"list": [1], "held": [held], "asked": [asked]})])))
    assert len(out) == 1
    got = out[0].groupby("query_id")["key"].agg(set).to_dict()
    assert {q: len(k) for q, k in got.items()} == {0: 6, 1: 6, 5: 6} and 0 not in got[0] and all(k % 2 == 1 and k not in (1, 3) for k in got[1])
    nothing = [{"query_id": 99, "q": rng.standard_normal(4), "wanted": 7}]
    assert not list(vi._scored(rng.standard_normal((2, 4)), 6)(iter([pd.DataFrame({"list": [1], "held": [held], "asked": [nothing]})])))
