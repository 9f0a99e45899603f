"""Pieces of HTML as plain text: blocks, lists with numbers, what stands outside tables; and event frames."""

from __future__ import annotations

import html
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_TAG = re.compile(r"<!--.*?-->|<(/?)([a-zA-Z][a-zA-Z0-9]*)([^<>]*)>|[^<]+|<", re.S)
# Tags that end a line, and the numerals of list types.
LINE_ENDS = {"p", "div", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "table", "blockquote", "pre"}
ROMAN = (("x", 10), ("ix", 9), ("v", 5), ("iv", 4), ("i", 1))


def _tokens(text: str):
    for m in _TAG.finditer(text):
        yield (m[2] or "").lower(), bool(m[1]), m[3] or "", "" if m[2] or m[0].startswith("<!--") else html.unescape(m[0])


def block_text(text: str | None) -> str | None:
    """Text of a block: a new line for breaks and ends of blocks, boxes for checkboxes, blanks squeezed."""
    if text is None:
        return None
    out = []
    for tag, closing, attrs, data in _tokens(text):
        if data:
            out.append(re.sub(r"\s+", " ", data))
        elif tag == "br" or tag in LINE_ENDS:
            out.append("\n")
        elif tag == "input" and "checkbox" in attrs:
            out.append("☑" if "checked" in attrs else "☐")
    return re.sub(r"\n{2,}", "\n", "\n".join(" ".join(x.split()) for x in "".join(out).split("\n"))).strip("\n")


def roman(n: int) -> str:
    """Small Roman numerals to 15, digits beyond."""
    if not 0 < n <= 15:
        return str(n)
    out = ""
    for sign, value in ROMAN:
        while n >= value:
            out, n = out + sign, n - value
    return out


def numeral(n: int, kind: str) -> str:
    """The n-th label of a list: letters wrap after 26."""
    if kind in ("a", "A"):
        return chr(ord(kind) + (n - 1) % 26)
    if kind in ("i", "I"):
        return roman(n) if kind == "i" else roman(n).upper()
    return str(n)


def list_text(text: str | None) -> str | None:
    """A list as lines: a dash or the item's number by ``type`` and ``start``, nested lists two blanks further in."""
    if text is None:
        return None
    stack: list[list] = []
    lines: list[str] = []
    for tag, closing, attrs, data in _tokens(text):
        if tag in ("ul", "ol"):
            if closing:
                if stack:
                    stack.pop()
            else:
                kind = (re.search(r"type\s*=\s*[\"']?([aAiI1])", attrs) or [None, "1"])[1]
                start = int((re.search(r"start\s*=\s*[\"']?(\d{1,6})", attrs) or [None, "1"])[1])
                stack.append([tag, kind, start])
        elif tag == "li" and not closing:
            label = "-"
            if stack and stack[-1][0] == "ol":
                label = numeral(stack[-1][2], stack[-1][1]) + "."
                stack[-1][2] += 1
            lines.append("  " * max(0, len(stack) - 1) + label + " ")
        elif data and data.strip():
            if lines:
                lines[-1] += (" " if lines[-1][-1:] not in (" ", "") else "") + " ".join(data.split())
            else:
                lines.append(" ".join(data.split()))
    return "\n".join(x.rstrip() for x in lines)


def outside_tables(text: str | None) -> str | None:
    """What stands outside all tables; a table that isn't closed swallows the rest."""
    if text is None:
        return None
    depth, at, out = 0, 0, []
    for m in re.finditer(r"<(/?)table\b[^>]*>", text, re.I):
        if m[1]:
            depth = max(0, depth - 1)
            if not depth:
                at = m.end()
        else:
            if not depth:
                out.append(text[at : m.start()])
            depth += 1
    return "".join(out) + ("" if depth else text[at:])


def frames(stream: Column) -> Column:
    """Frames of an event stream, parted by blank lines: event and data; data of several lines joined by newlines."""
    parts = F.filter(F.split(F.regexp_replace(stream, "\r", ""), "\n\n+"), lambda x: F.trim(x) != "")
    field = lambda x, name: F.array_join(F.transform(F.filter(F.split(x, "\n"), lambda y: F.startswith(y, F.lit(name + ":"))), lambda y: F.ltrim(F.substr(y, F.lit(len(name) + 2)))), "\n")
    return F.transform(parts, lambda x: F.struct(field(x, "event").alias("event"), field(x, "data").alias("data")))


def span_style(flags: Column, font: Column, colour: Column) -> list[Column]:
    """bold, italic and the three parts of the colour of a text span by its flag bits, font name and packed colour."""
    low = F.lower(F.coalesce(font, F.lit("")))
    bold = (flags.bitwiseAND(16) != 0) | low.rlike("bold|black|heavy")
    italic = (flags.bitwiseAND(2) != 0) | low.rlike("italic|oblique")
    part = lambda n: F.shiftright(colour, n).bitwiseAND(255)
    return [bold.alias("bold"), italic.alias("italic"), part(16).alias("red"), part(8).alias("green"), part(0).alias("blue")]


def markdown_rows(text: Column) -> Column:
    """Rows of cells of a Markdown table: lines with a bar, without rules, edge cells that are empty dropped."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.contains(x, F.lit("|")) & ~x.rlike(r"^[\s|:-]+$"))
    cells = F.transform(lines, lambda x: F.split(F.regexp_replace(F.trim(x), r"^\||\|$", ""), r"\|"))
    return F.filter(F.transform(cells, lambda r: F.transform(r, lambda c: F.trim(c))), lambda r: F.exists(r, lambda c: c != ""))


def emphasised(text: str | None, share: float = 0.5) -> tuple[bool, bool]:
    """bold and italic: whether tags of either stand around a ``share`` of a block's text."""
    depth, covered, total = {"bold": 0, "italic": 0}, {"bold": 0, "italic": 0}, 0
    kinds = {"b": "bold", "strong": "bold", "i": "italic", "em": "italic"}
    for tag, closing, _, data in _tokens(text or ""):
        if tag in kinds:
            depth[kinds[tag]] = max(0, depth[kinds[tag]] + (-1 if closing else 1))
        elif data:
            n = len("".join(data.split()))
            total += n
            for kind in covered:
                covered[kind] += n if depth[kind] else 0
    return total > 0 and covered["bold"] >= share * total, total > 0 and covered["italic"] >= share * total
