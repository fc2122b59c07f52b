"""Lines of a text that look like furniture, on pages whose layout is known."""

from __future__ import annotations

import pytest

from florilege.operators import furniture as fu
from florilege.plans.registry import ORACLE_SQL, QUERIES
from tests.oracle import connect, same

FOOT = "- 1 -\nHC-KAR\nWP No. 12 of 2021"


def text_of(*special: tuple[int, str], lines: int = 30) -> str:
    at = dict(special)
    return "\n".join(at.get(i, f"line {i}") for i in range(lines))


@pytest.fixture(scope="module")
def folder(spark, sf, tmp_path_factory):
    texts = [
        text_of((6, "Over."), (13, "Over."), (27, "Over.")),  # at the foot of three pages, and nowhere else
        text_of((6, "Over."), (13, "Over."), (17, "Over."), lines=18),
        text_of((2, "- 9 -"), (3, "Page 3"), (4, "HC-KAR"), (8, "WP No. 3 of 2020"), (9, "WP No. 3 of 2020"), (13, "- 2 -"), (14, "WP No. 12 of 2021")),
        text_of((1, "WP No. 12 of 2021"), (2, "WP No. 12 of 2021"), lines=5),
        text_of((6, ""), (13, " "), (20, "")), text_of(lines=7), "", "one", None,
    ]
    path = tmp_path_factory.mktemp("pages")
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings", "pages", "benchmark", "labels", "conversations"):
        (path / f"{name}.parquet").symlink_to(f"{sf}/{name}.parquet")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_lines_of_the_documents_stay(spark, folder):
    same(QUERIES["doc_page_furniture"](spark, folder), connect(folder), ORACLE_SQL["doc_page_furniture"])


def test_only_a_whole_foot_goes():
    layout = ("page_rule_dash", "court_stamp", "case_number")
    text = f"WP No. 12 of 2021\na\n{FOOT}\n- 2 -\nHC-KAR\nb\n{FOOT}"
    assert [s["rule"] for s in fu.find(text, layout)] == ["case_number", *layout, *layout]
    assert [s["rule"] for s in fu.find(text)] == ["case_number", *layout, "page_rule_dash", "court_stamp", *layout]
    assert fu.find("", layout) == fu.find("- 2 -", layout) == []
