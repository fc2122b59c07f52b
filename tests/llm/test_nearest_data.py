"""Recall of the nearest-neighbour search on vectors that are not alike to random ones."""

from __future__ import annotations

import numpy as np
import pytest

from florilege.llm import nearest


def _vectors(kind: str, n: int = 4000, d: int = 48) -> np.ndarray:
    rng = np.random.default_rng(3)
    if kind == "clusters":
        return rng.standard_normal((40, d))[rng.integers(0, 40, n)] + 0.1 * rng.standard_normal((n, d))
    if kind == "few directions":
        return rng.standard_normal((n, 4)) @ rng.standard_normal((4, d)) + 0.05 * rng.standard_normal((n, d))
    x = rng.standard_normal((n, d))  # the rows that ask are unlike the others
    x[::20] = 0.3 * x[::20] - 2
    return x


@pytest.mark.parametrize("kind", ["clusters", "few directions", "other queries"])
def test_recall_does_not_need_unrelated_vectors(spark, kind):
    x = _vectors(kind)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got: dict[int, set[int]] = {}
    for r in nearest.search(rows).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    asked = np.arange(0, len(x), 20)
    scores = x[asked] @ x.T
    scores[np.arange(len(asked)), asked] = -np.inf
    best = np.argsort(-scores, axis=1)[:, :20]
    assert np.mean([len(got[int(q)] & set(b.tolist())) / 20 for q, b in zip(asked, best, strict=True)]) >= 0.9
