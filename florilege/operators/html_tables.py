"""Tables in HTML to named cells, a row for each row of a table, refusals included.

A table is laid out as a grid: a cell that spans rows or columns stands in each place that it covers. Its
header is the first row of which two cells or more carry known labels, or all are header cells; what stands
above it is not data. Columns are named by their labels; unknown ones keep their text as name. Each
row that is seen comes out once, with a state:

* ``read``: every required field has text;
* ``partial``: a required field lacks text, but the key has it; ``refusal`` lists what lacks;
* ``refused``: nothing that can be used; ``refusal`` says why: ``above_header``, ``header``, ``repeated_header``,
  ``no_header`` (the table has none, all its rows), ``no_key_column``, ``no_key``, ``empty_row``.

So read, partial and refused rows add up to the rows of all tables of a page; a page that could not be read
is never taken for one that lists nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from florilege.functions.text import TEXT_ROWS

#: What HTML allows a cell to span.
MOST_COLUMNS, MOST_ROWS = 1000, 65_534
#: A tag that needs no parser: closed, with plain attributes in double quotes or none.
_TAG = re.compile(r'<(/?)([A-Za-z][A-Za-z0-9]*)((?:[ \n]+[A-Za-z][A-Za-z-]*="[^"<>&]*")*)[ \n]*>')
_ATTRIBUTE = re.compile(r'([A-Za-z][A-Za-z-]*)="([^"]*)"')
#: Elements whose content is not read as tags.
_RAW = {"script", "style", "textarea", "title", "iframe", "noembed", "noframes", "noscript", "plaintext", "xmp"}


class _Tables(HTMLParser):
    """Rows of every table: cells as (text, header cell, columns, rows). A table within a cell is a table of
    its own, and its text is not the cell's."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tables: list[list[list[tuple[str, bool, int, int]]]] = []
        self.open: list[int] = []
        self.cells: list[list | None] = []
        self.silent = 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.silent += 1
        elif tag == "table":
            self.tables.append([])
            self.open.append(len(self.tables) - 1)
            self.cells.append(None)
        elif self.open and tag == "tr":
            self._close()
            self.tables[self.open[-1]].append([])
        elif self.open and tag in ("td", "th"):
            self._close()
            if not self.tables[self.open[-1]]:
                self.tables[self.open[-1]].append([])
            span = {k: int(v) if (v or "").strip().isdecimal() else 1 for k, v in attrs if k in ("colspan", "rowspan")}
            self.cells[-1] = [[], tag == "th", min(max(span.get("colspan", 1), 1), MOST_COLUMNS), min(span.get("rowspan", 1), MOST_ROWS)]
        elif self.open and tag == "br" and self.cells[-1]:
            self.cells[-1][0].append(" ")

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.silent = max(0, self.silent - 1)
        elif self.open and tag in ("td", "th", "tr"):
            self._close()
        elif self.open and tag == "table":
            self._close()
            self.open.pop()
            self.cells.pop()

    def handle_data(self, data):
        if self.open and self.cells[-1] and not self.silent:
            self.cells[-1][0].append(data)

    def read(self, html: str) -> None:
        """The whole of a page. One that has simple tags only is cut at them, any other is parsed."""
        pieces = _TAG.split(html)
        if any("<" in text for text in pieces[::4]) or not _RAW.isdisjoint(name.lower() for name in pieces[2::4]):
            self.feed(html)
            self.close()
            return
        if pieces[0]:
            self.handle_data(unescape(pieces[0]))
        for shut, name, attributes, text in zip(pieces[1::4], pieces[2::4], pieces[3::4], pieces[4::4], strict=True):
            if shut:
                self.handle_endtag(name.lower())
            else:
                self.handle_starttag(name.lower(), [(k.lower(), v) for k, v in _ATTRIBUTE.findall(attributes)] if attributes else [])
            if text:
                self.handle_data(unescape(text) if "&" in text else text)

    def _close(self):
        if self.cells[-1]:
            text, head, columns, rows = self.cells[-1]
            self.tables[self.open[-1]][-1].append((" ".join("".join(text).split()), head, columns, rows))
            self.cells[-1] = None


def grids(html: str) -> list[list[dict[int, tuple[str, bool]]]]:
    """Each table as rows of {column: (text, header cell)}."""
    parser = _Tables()
    parser.read(html)
    for at in parser.open:
        parser._close()
    out = []
    for table in parser.tables:
        grid: list[dict[int, tuple[str, bool]]] = [{} for _ in table]
        for i, row in enumerate(table):
            column = 0
            for text, head, columns, rows in row:
                while column in grid[i]:
                    column += 1
                # a span of no rows reaches to the end of the table
                for r in range(i, len(table) if rows == 0 else min(len(table), i + rows)):
                    for c in range(column, column + columns):
                        grid[r].setdefault(c, (text, head))
                column += columns
        out.append(grid)
    return out


def _plain(label: str) -> str:
    return "".join(c for c in label.lower() if c.isalnum())


def read_table(grid: list[dict[int, tuple[str, bool]]], labels: dict[str, str], key: str, required: set[str]) -> Iterator[tuple[str, str | None, dict[str, str]]]:
    """``state, refusal, cells`` of each row. ``labels``: plain label to field."""

    def named(row: dict[int, tuple[str, bool]]) -> dict[int, str]:
        return {c: labels.get(_plain(text), text) for c, (text, _) in row.items() if text}

    def is_header(row: dict[int, tuple[str, bool]]) -> bool:
        known = {labels[_plain(t)] for t, _ in row.values() if _plain(t) in labels}
        return len(known) >= 2 or (len(row) >= 2 and all(head for _, head in row.values()))

    top = next((i for i, row in enumerate(grid) if is_header(row)), None)
    if top is None:
        yield from (("refused", "no_header", {str(c): t for c, (t, _) in row.items()}) for row in grid)
        return
    names = named(grid[top])

    def repeats(row: dict[int, tuple[str, bool]]) -> bool:
        """Whether :func:`named` says of it what it says of the header; mostly the first cell tells."""
        held = [(c, text) for c, (text, _) in row.items() if text]
        return len(held) == len(names) and all(c in names and names[c] == labels.get(_plain(text), text) for c, text in held)

    for i, row in enumerate(grid):
        cells = {names[c]: text for c, (text, _) in row.items() if c in names and text}
        lacks = sorted(f for f in required if not cells.get(f))
        if i <= top:
            yield "refused", "header" if i == top else "above_header", {str(c): t for c, (t, _) in row.items()}
        elif not cells:
            yield "refused", "empty_row", {}
        elif repeats(row):
            yield "refused", "repeated_header", {}
        elif key not in names.values():
            yield "refused", "no_key_column", cells
        elif key in lacks:
            yield "refused", "no_key", cells
        elif lacks:
            yield "partial", "lacks " + ", ".join(lacks), cells
        else:
            yield "read", None, cells


SCHEMA = "table_no int, row_no int, state string, refusal string, cells map<string,string>"


def table_rows(pages: DataFrame, html: str, fields: dict[str, list[str]], key: str, required: list[str]) -> DataFrame:
    """The columns of ``pages`` but ``html``, with those of ``SCHEMA``: a row for each row of each table.

    ``fields``: the labels, in any case and with any marks, under which pages print each field.
    """
    labels = {_plain(spelled): field for field, all_ in fields.items() for spelled in [field, *all_]}
    needed = {key, *required}

    others = [f for f in pages.schema if f.name != html]
    out = StructType([*others, *StructType.fromDDL(SCHEMA)])
    kinds = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            # a batch counts rows, texts may be long
            for begin in range(0, whole.num_rows, TEXT_ROWS):
                batch = whole.slice(begin, TEXT_ROWS)
                at, found = [], []
                for i, text in enumerate(batch.column(html).to_pylist()):
                    for number, grid in enumerate(grids(text or "")):
                        for row_no, (state, refusal, cells) in enumerate(read_table(grid, labels, key, needed)):
                            at.append(i)
                            found.append((number, row_no, state, refusal, list(cells.items())))
                if found:
                    kept = [batch.column(f.name).take(pa.array(at, pa.int32())) for f in others]
                    yield pa.RecordBatch.from_arrays([*kept, *(pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True))], names=out.names)

    return pages.mapInArrow(run, out)
