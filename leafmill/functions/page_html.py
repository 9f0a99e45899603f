"""Pages that a model wrote as HTML, read as layout entries.

A page is a list of ``div`` blocks with a label and a box of four numbers from
0 to 1000; what stands in a block becomes the entry's text by the label.
"""

from __future__ import annotations

import html
import re

from leafmill.functions import blocks

GRID = 1000
# Labels by how their blocks are read.
PICTURES, DIAGRAMS, TABLES, FORMULAS, LISTS, BLANK = ("Image", "Figure"), ("Diagram",), ("Table",), ("Equation-Block",), ("List-Group",), "Blank-Page"

_DIV = re.compile(r"<!--.*?-->|<(/?)div\b([^<>]*)>", re.S | re.I)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'<>]+))")
_TABLE = re.compile(r"<table\b", re.I)
_IMAGE = re.compile(r"<img\b([^<>]*)>", re.I)
_MATH = re.compile(r"<math\b[^>]*>\s*(.*?)\s*</math>", re.S | re.I)
_BOX_OF_TAG = re.compile(r"(<[a-z][^<>]*?)\s+data-bbox\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s<>]+)", re.I)


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(text)}


def divs(page: str) -> list[tuple[dict[str, str], str]]:
    """Attributes and inside of the outermost blocks; of all labelled ones if some other tag stands around them. An unclosed block runs to the end."""
    stack: list[tuple[str, int]] = []
    found: list[tuple[int, int, dict, str]] = []

    def close(end: int) -> None:
        attributes, start = stack.pop()
        found.append((len(stack), start, _attributes(attributes), page[start:end]))

    for m in _DIV.finditer(page):
        if m[2] is None:
            continue
        if not m[1]:
            stack.append((m[2], m.end()))
        elif stack:
            close(m.start())
    while stack:
        close(len(page))
    found.sort(key=lambda f: f[1])
    head = re.sub(r"<!--.*?-->", "", page, flags=re.S).lstrip().lower()
    if head.startswith("<") and not head.startswith("<div"):
        return [(a, inner) for _, _, a, inner in found if a.get("data-label")]
    return [(a, inner) for depth, _, a, inner in found if depth == 0]


def box(text: str | None, width: int, height: int) -> list[int] | None:
    """A box of four numbers on the grid, in pixels of the page and within it; None if there aren't four."""
    try:
        numbers = [round(float(v)) for v in (text or "").split()]
    except (ValueError, OverflowError):
        return None
    if len(numbers) != 4:
        return None
    return [max(0, min(size, round(v * (size / GRID)))) for v, size in zip(numbers, (width, height, width, height))]


def entries_of_page(page: str | None, width: int, height: int) -> list[tuple[str, list[int], str, str | None]]:
    """category, box in pixels, text and source of each block of a page; blank pages and blocks without a box give none."""
    out = []
    for attributes, inner in divs(page or ""):
        label = attributes.get("data-label") or "Text"
        place = box(attributes.get("data-bbox"), width, height)
        if label == BLANK or place is None:
            continue
        source = None
        if label in PICTURES:
            image = _IMAGE.search(inner)
            text = _attributes(image[1]).get("alt", "") if image else ""
        elif label in TABLES or label not in DIAGRAMS and _TABLE.search(inner):
            label, text = "Table", _MATH.sub(lambda m: f"${m[1]}$" if m[1] else "", _BOX_OF_TAG.sub(r"\1", inner))
        elif label in FORMULAS:
            math = [x for x in _MATH.findall(inner) if x]
            text = " ".join(html.unescape(" ".join(math) if _MATH.search(inner) else re.sub(r"<[^<>]*>", " ", inner)).replace("$", "").split())
        elif label in LISTS:
            text = blocks.list_text(inner) or ""
        else:
            text = blocks.block_text(_MATH.sub(r"$\1$", inner)) or ""
            if label in DIAGRAMS and place[0] <= place[2] and place[1] <= place[3]:
                label, source = "Image", "diagram-recovered"
        out.append((label, place, text, source))
    return out
