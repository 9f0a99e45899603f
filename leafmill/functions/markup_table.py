"""HTML tables to rows of cells, with a tolerant scanner.

A row is (cells, is_header); a cell is (text, colspan, rowspan, images,
blocks). Blocks are the cell's paragraphs and nested tables, at most three
deep. Unclosed cells, rows and tables end where the next one begins or the
text ends. Repeated neighbouring rows count once, and at most ``MOST_ROWS``
rows are kept.
"""

from __future__ import annotations

import html
import re
from typing import NamedTuple

MOST_ROWS, MOST_COLUMNS, DEEPEST = 200, 40, 3


class Cell(NamedTuple):
    text: str
    colspan: int = 1
    rowspan: int = 1
    images: int = 0
    blocks: tuple = ()

    @property
    def filled(self) -> bool:
        return bool(self.text.strip()) or self.images > 0


Row = tuple[list[Cell], bool]


def _count(value: str | None) -> int:
    try:
        return max(1, min(1000, int(value or 1)))
    except ValueError:
        return 1


class _OpenCell:
    def __init__(self, tag: str, attrs: dict[str, str]):
        self.header = tag == "th"
        self.colspan, self.rowspan = _count(attrs.get("colspan")), _count(attrs.get("rowspan"))
        self.images = 0
        self.paragraphs: list[str] = [""]
        self.blocks: list[tuple[str, object]] = []

    def end_paragraph(self) -> None:
        raw = self.paragraphs[-1]
        text = "\n".join(" ".join(line.split()) for line in raw.split("\n")).strip() if "\n" in raw else " ".join(raw.split())
        if text:
            self.blocks.append(("text", text))
        self.paragraphs.append("")

    def cell(self) -> Cell:
        self.end_paragraph()
        text = "\n".join(v if k == "text" else "\n".join(c.text for cells, _ in v for c in cells if c.text) for k, v in self.blocks)
        several = len(self.blocks) > 1 or any(k == "table" for k, _ in self.blocks)
        return Cell(text, self.colspan, self.rowspan, self.images, tuple(self.blocks) if several else ())


_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<(/?)([a-zA-Z][a-zA-Z0-9]*)([^<>]*)>|[^<]+|<", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(text)} if text and text != "/" else {}


class _Reader:
    """A stack of open tables; each holds finished rows, the open row and the open cell."""

    def __init__(self) -> None:
        self.open: list[dict] = []
        self.rows: list[Row] = []

    def read(self, text: str) -> None:
        for m in _TOKEN.finditer(text):
            if m[2]:
                if m[1]:
                    self.end(m[2].lower())
                else:
                    self.start(m[2].lower(), m[3])
            elif self.open and not m[0].startswith("<!--"):
                self.text(html.unescape(m[0]) if "&" in m[0] else m[0])

    def _cell(self) -> _OpenCell | None:
        return self.open[-1]["cell"] if self.open else None

    def _close_cell(self) -> None:
        t = self.open[-1]
        if t["cell"] is not None:
            t["heads"].append(t["cell"].header)
            t["row"].append(t["cell"].cell())
            t["cell"] = None

    def _close_row(self) -> None:
        t = self.open[-1]
        self._close_cell()
        if t["row"]:
            t["rows"].append((t["row"], t["head"] or all(t["heads"])))
        t["row"], t["heads"] = [], []

    def _close_table(self) -> None:
        self._close_row()
        rows = self.open.pop()["rows"]
        if (outer := self._cell()) is not None:
            if rows and len(self.open) < DEEPEST:
                outer.end_paragraph()
                outer.blocks.append(("table", rows))
        elif all(t["cell"] is None for t in self.open):
            self.rows += rows

    def start(self, tag: str, attrs: str) -> None:
        if tag == "table":
            if self.open and self._cell() is None:
                self._close_row()
            self.open.append({"rows": [], "row": [], "heads": [], "cell": None, "head": False})
            return
        if not self.open:
            return
        t = self.open[-1]
        if tag == "tr":
            self._close_row()
        elif tag in ("td", "th"):
            self._close_cell()
            t["cell"] = _OpenCell(tag, _attributes(attrs))
        elif tag == "thead":
            t["head"] = True
        elif tag == "tbody":
            self._close_row()
            t["head"] = False
        elif (cell := t["cell"]) is not None:
            if tag == "br":
                cell.paragraphs[-1] += "\n"
            elif tag in ("p", "div", "li"):
                cell.end_paragraph()
            elif tag == "img":
                cell.images += 1
            elif tag == "input" and (own := _attributes(attrs)).get("type") == "checkbox":
                cell.paragraphs[-1] += "☑" if "checked" in own else "☐"

    def end(self, tag: str) -> None:
        if not self.open:
            return
        if tag == "table":
            self._close_table()
        elif tag == "tr":
            self._close_row()
        elif tag in ("td", "th"):
            self._close_cell()
        elif tag == "thead":
            self._close_row()
            self.open[-1]["head"] = False
        elif tag in ("p", "div", "li") and (cell := self._cell()) is not None:
            cell.end_paragraph()

    def text(self, data: str) -> None:
        if (cell := self._cell()) is not None:
            cell.paragraphs[-1] += data.replace("\n", " ")


def read_table(text: str | None) -> list[Row]:
    """The rows of all top-level tables in a text, in order; none if there is no table."""
    if not text or "<table" not in text.lower():
        return []
    reader = _Reader()
    reader.read(text)
    while reader.open:
        reader._close_table()
    rows: list[Row] = []
    for row in reader.rows:
        if not rows or row[0] != rows[-1][0]:
            rows.append(row)
    return rows[:MOST_ROWS]
