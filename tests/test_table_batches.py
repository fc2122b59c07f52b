"""Tables are read a batch at a time; simple pages without a parser, with what the parser gives."""

from __future__ import annotations

import random

import pytest

from florilege.operators import html_tables as ht
from florilege.plans.registry import QUERIES


def test_pages_cut_at_their_tags_give_what_the_parser_gives(monkeypatch):
    rng = random.Random(6)
    parts = ["<table>", "</table>", "<tr>", "</tr>", "<td>", "</TD >", "<th>", '<td colspan="2">', '<td class="a b"\n rowspan="2">', "<br>", "<b>", "</b>", " x ", "a&amp;b", "&nbsp;", "&lt", "A & B", ">", "1 > 0", "y"]
    odd = [*parts, "<br/>", "<!-- <td> -->", "< td>", "<td rowspan=2>", "<script>", "</script>", "<style>", "<td a='<'>", "<title>", "<"]
    pages = ["<table>" + "".join(rng.choice(of) for _ in range(rng.randrange(40))) for of in (parts, odd) for _ in range(1500)]
    got = [ht.grids(p) for p in pages]
    fed = []
    monkeypatch.setattr(ht._Tables, "read", lambda self, html: (fed.append(html), self.feed(html), self.close()))
    assert got == [ht.grids(p) for p in pages] and len(fed) == len(pages)


def test_a_simple_page_needs_no_parser(monkeypatch):
    monkeypatch.setattr(ht._Tables, "feed", lambda self, html: pytest.fail("parsed"))
    assert ht.grids('<table><tr><td colspan="2">a&amp;b</tr></table>') == [[{0: ("a&b", False), 1: ("a&b", False)}]]


def test_spans_that_are_no_decimal_numbers():
    assert ht.grids('<table><tr><td rowspan="²">a</table>') == [[{0: ("a", False)}]]


@pytest.mark.parametrize("name", ["doc_table_rows", "doc_table_refusals"])
def test_rows_go_to_workers_in_batches(spark, sf, name):
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "BatchEvalPythonUDTF" not in plan
