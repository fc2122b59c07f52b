"""HTML tables to rows and refusals."""

from __future__ import annotations

from florilege.operators import html_tables as ht

FIELDS = {"case": ["Case No.", "Case Number"], "party": ["Party Name"], "judge": ["Before"]}
LABELS = {ht._plain(s): f for f, all_ in FIELDS.items() for s in [f, *all_]}


def texts(html):
    return [[{c: t for c, (t, _) in row.items()} for row in grid] for grid in ht.grids(html)]


def read(html):
    return [row for grid in ht.grids(html) for row in ht.read_table(grid, LABELS, "case", {"case", "party"})]


def test_spans_fill_the_grid():
    html = "<table><tr><td rowspan=2>a<td colspan='2'>b</tr><tr><td>c<td>d</tr><tr><td rowspan=0>e</tr><tr><td>f</tr></table>"
    assert texts(html) == [[{0: "a", 1: "b", 2: "b"}, {0: "a", 1: "c", 2: "d"}, {0: "e"}, {0: "e", 1: "f"}]]


def test_marks_scripts_and_inner_tables():
    html = "<table><tr><td>a&amp;b <script>x</script><br>c<table><tr><td>inner</table></td><td> d </table> after"
    assert texts(html) == [[{0: "a&b c", 1: "d"}], [{0: "inner"}]]
    assert texts("") == [] and texts("<table></table>") == [[]] and texts("<table><td>x") == [[{0: "x"}]]
    assert texts("<td>x</td><table><tr><td colspan=oops rowspan=-1>y</table>") == [[{0: "y"}]]


def test_columns_go_by_the_printed_labels():
    rows = read("<table><tr><td>Sr<td>CASE NO<td>Party  name:</tr><tr><td>1<td>A 1/20<td>Rao</tr></table>")
    assert rows == [("refused", "header", {"0": "Sr", "1": "CASE NO", "2": "Party name:"}), ("read", None, {"Sr": "1", "case": "A 1/20", "party": "Rao"})]


def test_half_read_rows_are_partial():
    rows = read("<table><tr><th>Case No.<th>Party Name</tr><tr><td>A 1<td></tr><tr><td><td>Rao</tr><tr><td> <td></tr><tr><th>Case No.<th>Party Name</tr></table>")
    assert [r[:2] for r in rows] == [("refused", "header"), ("partial", "lacks party"), ("refused", "no_key"), ("refused", "empty_row"), ("refused", "repeated_header")]


def test_tables_that_name_no_case_are_refused():
    assert [r[:2] for r in read("<table><tr><th>Before<th>Party Name</tr><tr><td>J<td>Rao</tr></table>")] == [("refused", "header"), ("refused", "no_key_column")]
    assert [r[:2] for r in read("<table><tr><td>a<td>b</tr><tr><td>c</tr></table>")] == [("refused", "no_header")] * 2


def test_rows_and_refusals_add_up(spark):
    pages = [(1, "<table><tr><th>Case No.<th>Party Name</tr><tr><td>A<td>B</table><table><tr><td>x</table>"), (2, "no table"), (3, None), (4, "<table><tr><td>Case No.<td>Before</tr><tr><td>Z<td>J</table>")]
    got = ht.table_rows(spark.createDataFrame(pages, "id long, html string"), "html", FIELDS, "case", ["party"]).collect()
    assert sorted((r["id"], r["table_no"], r["row_no"], r["state"]) for r in got) == [(1, 0, 0, "refused"), (1, 0, 1, "read"), (1, 1, 0, "refused"), (4, 0, 0, "refused"), (4, 0, 1, "partial")]
