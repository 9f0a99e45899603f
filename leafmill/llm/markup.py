"""Markup in texts, found and turned into clean text by boosted trees over the nodes of a tolerant document tree.

HTML, Markdown, wiki and LaTeX stand side by side in one text, often unclosed
or escaped. A scanner proposes a node wherever markup may begin: tags,
environments, fences, runs of list lines, table rows, marks in a line. Nodes
nest by their spans. Each has features: its kind, the density of text, signs,
links and nodes in its whole subtree, attribute tokens, depth, sibling and
neighbour statistics, and how much markup of each sort the text has. Boosted trees turn them into the log-odds that the node is
real. Decoding picks the set of nodes of most total log-odds in which no
ancestor contradicts a descendant: nothing stands within code, and a list
within a list belongs to it. Cleaning takes away what was chosen and frames
(paragraph tags, comments, preambles); what only looks like markup stays.

The trees are fitted on texts that a seeded generator writes: plain sentences
of the corpus (a bounded sample, ``CARRIERS``), markup of all sorts put around
them, and signs that look like markup but belong to the text. Everything else
reads whole texts, all rows, in one narrow pass.

Defined results: null, empty and blank texts have no elements and an unchanged
clean text; equal texts give equal rows for each document; unclosed code runs
to the text's end; a lone sign without its partner is text.
"""

from __future__ import annotations

import dataclasses
import functools
import html
import random
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm import trees
from leafmill.llm.sampling import bounded_sample

#: Plain texts from which the generator takes its sentences, and texts it writes.
CARRIERS, WRITTEN, SEED = 400, 2500, 7
ELEMENTS = ("heading", "list", "code", "formula", "table", "inline")

# Names of tags and environments by what they make.
HEADING_TAGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
LIST_TAGS = {"ul", "ol", "dl"}
CODE_TAGS = {"pre", "syntaxhighlight", "source", "listing", "xmp"}
FORMULA_TAGS = {"math"}
TABLE_TAGS = {"table"}
FRAME_TAGS = {"html", "head", "body", "title", "style", "script", "meta", "link", "p", "div", "section", "article", "header", "footer", "main", "nav", "document"}
PART_TAGS = {"li", "tr", "td", "th", "tbody", "thead", "tfoot", "caption", "dt", "dd", "colgroup", "col"}
INLINE_TAGS = set("a b i u s em strong span font br ref sup sub small big code tt kbd img mark del ins abbr cite q strike nowiki input center var samp".split())
LIST_ENVIRONMENTS = {"itemize", "enumerate", "description"}
CODE_ENVIRONMENTS = {"verbatim", "lstlisting", "minted", "Verbatim", "alltt"}
FORMULA_ENVIRONMENTS = {"equation", "align", "gather", "multline", "eqnarray", "displaymath", "math"}
TABLE_ENVIRONMENTS = {"tabular", "tabularx", "longtable", "table", "array"}
HEADING_COMMANDS = ("part", "chapter", "section", "subsection", "subsubsection", "paragraph", "subparagraph")
INLINE_COMMANDS = ("textbf", "textit", "emph", "underline", "texttt", "textsc", "footnote", "cite", "ref", "href", "url", "includegraphics")

KINDS = (
    "tag_heading", "tag_list", "tag_code", "tag_formula", "tag_table", "tag_inline", "entity",
    "atx", "setext", "wiki_heading", "tex_heading", "list_lines", "hash_list", "env_list", "fence", "env_code",
    "dollar", "dollars", "tex_paren", "tex_bracket", "env_formula", "pipe_table", "wiki_table", "env_table",
    "star", "stars", "low", "lows", "quotes", "link", "image", "wiki_link", "template", "tex_inline", "backtick", "strike", "footmark", "indent_code",
)
KIND = {k: i for i, k in enumerate(KINDS)}
ELEMENT_OF = [
    "heading", "list", "code", "formula", "table", "inline", "inline",
    "heading", "heading", "heading", "heading", "list", "list", "list", "code", "code",
    "formula", "formula", "formula", "formula", "formula", "table", "table", "table",
    *["inline"] * 12, "inline", "code",
]

_ESCAPED = re.compile(r"&lt;/?(?:p|div|h[1-6]|ul|ol|li|table|tr|td|pre|code|math|strong|em|span|font|br|a|b|i)\b", re.I)
#: Attributes of a tag: none, or some with a value; words alone are text between angle brackets.
_ATTRIBUTES = re.compile(r"\s*(?:(?:nowrap|compact|checked|disabled|hidden|noshade|reversed|selected)?|.*=.*)\s*/?\s*", re.S | re.I)
_ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]{1,31});")
_ANY = re.compile(r"[<&\\$`~*_|#{\[]|^[ \t]*(?:[-+•][ \t]|\d+[.)][ \t]|={1,6})|^[-]{2,}|''", re.M)
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:\s[^<>]*)?)>|<!--.*?-->|<![A-Za-z][^<>]*>|&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]{1,9});", re.S)
_ENV = re.compile(r"\\(begin|end)\{([a-zA-Z]+)\*?\}")
_COMMAND = re.compile(r"\\(" + "|".join((*HEADING_COMMANDS, *INLINE_COMMANDS)) + r")\*?(?:\[[^\]\n]*\])?\{")
_LINES = re.compile(
    r"^(?P<atx>[ ]{0,3}(?P<hashes>#{1,6})[ \t]+\S[^\n]*)$"
    r"|^(?P<wiki>(?P<eq>={1,6})[ \t]*[^=\n][^\n]*?(?P=eq)[ \t]*)$"
    r"|^(?P<setext>={3,}|-{3,})[ \t]*$"
    r"|^(?P<fence>[ ]{0,3}(?P<tick>```+|~~~+)[^\n`~]*)$"
    r"|^(?P<item>[ \t]*(?P<mark>[-+•]|\d{1,3}[.)]|[*#:;]{1,4}|[a-z][.)])(?P<gap>[ \t]+)\S[^\n]*|(?P<tight>[*]{1,4})[^\s*][^*\n]*)$"
    r"|^(?P<open>[ \t]*\{\|[^\n]*)$|^(?P<pipe>[ \t]*\|[^\n]*)$",
    re.M,
)
_BRACE = re.compile(r"[{}]")
_MARKED = re.compile(r"[ \t]*(?:[-+*#|>=]|\d+[.)])[ \t]")
# Spans end at the first mark that can close them, however far; none runs over another opening mark of its own kind.
_SPANS = re.compile(
    r"(?=[$\\!\[{'*_~`])(?:(?P<dollars>\$\$(?=[^$])(?:(?!\$\$).)+\$\$)"
    r"|(?P<dollar>(?<![\\$])\$(?=[^\s$])[^$\n]+(?<=[^\s\\])\$(?![$\d]))"
    r"|(?P<tex_paren>\\\((?:(?!\\\().)+?\\\))|(?P<tex_bracket>\\\[(?:(?!\\\[).)+?\\\])"
    r"|(?P<image>!\[[^\]\n]*\]\([^)\n]*\))|(?P<wiki_link>\[\[[^\[\]\n]+\]\])|(?P<footmark>\[\^[^\]\n]+\])|(?P<link>\[[^\[\]\n]+\]\([^()\s]+\))"
    r"|(?P<template>\{\{[^{}]+\}\})"
    r"|(?P<quotes>'{2,5}(?=[^'\s])[^'\n]+(?:'[^'\n]+)*?'{2,5})"
    r"|(?P<stars>\*\*(?=[^\s*])[^*\n]+(?<=[^\s*])\*\*)|(?P<star>(?<!\*)\*(?=[^\s*])[^*\n]+(?<=[^\s*])\*(?!\*))"
    r"|(?P<lows>__(?=[^\s_])[^_\n]+(?<=[^\s_])__)|(?P<low>(?<![_\w])_(?=[^\s_])[^_\n]+(?<=[^\s_])_(?![_\w]))"
    r"|(?P<strike>~~(?=[^\s~])[^~\n]+(?<=[^\s~])~~)|(?P<backtick>(?<!`)`(?=[^`\s])[^`\n]+`(?!`)))",
    re.S,
)
_ENDING = ".!?。！？;；:：,，"
_ENDS = re.compile(rf"[{_ENDING}]\s*$")
# Tokens of attributes that tell layout from content.
ATTRIBUTE_TOKENS = ("class", "style", "id", "href", "align", "data", "name", "size")
LINKS = {"link", "image", "wiki_link", "footmark"}
WIDTH = len(KINDS) + 32


@dataclasses.dataclass(slots=True)
class Node:
    start: int
    end: int
    kind: int
    inner: tuple[int, int]
    attrs: str = ""
    closed: bool = True
    run: int = 1
    parent: int = -1
    children: list[int] = dataclasses.field(default_factory=list)


def unescaped(text: str) -> str:
    """Escaped markup counts like markup: one level is undone where whole tags are escaped."""
    return _signs_of(text.replace("&amp;", "&")) if _ESCAPED.search(text) else text


def _signs_of(text: str) -> str:
    """The text with its closed entities as signs; an ampersand of an address stays."""
    return _ENTITY.sub(lambda m: html.unescape(m.group()), text)


def _tags(text: str, nodes: list[Node]) -> list[tuple[int, int]]:
    """Nodes of tags and entities; returns spans of comments, frames' styles and the like, in which nothing is proposed."""
    hidden, stack, sections = [], [], {"heading": HEADING_TAGS, "list": LIST_TAGS, "code": CODE_TAGS, "formula": FORMULA_TAGS, "table": TABLE_TAGS}
    what = {t: k for k, ts in sections.items() for t in ts}
    raw = ""
    for m in _TAG.finditer(text):
        name = m.group(2)
        if name is None:
            if m.group().startswith("&"):
                if not raw:
                    nodes.append(Node(m.start(), m.end(), KIND["entity"], m.span(), m.group()))
            else:
                hidden.append(m.span())
            continue
        low, closing = name.lower(), bool(m.group(1))
        if not _ATTRIBUTES.fullmatch(m.group(3)):
            continue
        if raw and not (closing and low == raw):
            continue
        if low in ("style", "script", "title"):
            if closing:
                raw = ""
                if stack and stack[-1][0] == low:
                    hidden.append((stack.pop()[1], m.end()))
            else:
                raw = low
                stack.append((low, m.start(), m.end(), ""))
            continue
        if low in what:
            if closing:
                at = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == low), -1)
                if at >= 0:
                    _, start, inner, attrs = stack[at]
                    for name2, start2, inner2, attrs2 in stack[at + 1 :]:
                        if name2 in what:
                            nodes.append(Node(start2, m.start(), KIND["tag_" + what[name2]], (inner2, m.start()), attrs2, closed=False))
                    del stack[at:]
                    nodes.append(Node(start, m.end(), KIND["tag_" + what[low]], (inner, m.start()), attrs))
                if low in CODE_TAGS:
                    raw = ""
            elif not m.group(3).rstrip().endswith("/"):
                if low in CODE_TAGS:
                    raw = low
                stack.append((low, m.start(), m.end(), m.group(3)))
        elif low in INLINE_TAGS and not closing:
            nodes.append(Node(m.start(), m.end(), KIND["tag_inline"], m.span(), low + m.group(3)))
    for low, start, inner, attrs in stack:
        if low in what:
            nodes.append(Node(start, len(text), KIND["tag_" + what[low]], (inner, len(text)), attrs, closed=False))
    return hidden


def _tex(text: str, nodes: list[Node]) -> None:
    groups = {"list": LIST_ENVIRONMENTS, "code": CODE_ENVIRONMENTS, "formula": FORMULA_ENVIRONMENTS, "table": TABLE_ENVIRONMENTS}
    what = {e: k for k, es in groups.items() for e in es}
    stack: list[tuple[str, int, int]] = []
    for m in _ENV.finditer(text):
        name = m.group(2)
        if m.group(1) == "begin":
            stack.append((name, m.start(), m.end()))
            continue
        at = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), -1)
        if at >= 0:
            _, start, inner = stack[at]
            del stack[at:]
            if name in what:
                nodes.append(Node(start, m.end(), KIND["env_" + what[name]], (inner, m.start())))
    closing: dict[int, int] = {}
    braces: list[int] = []
    for m in _BRACE.finditer(text):
        if m.group() == "{":
            braces.append(m.start())
        elif braces:
            closing[braces.pop()] = m.start()
    for m in _COMMAND.finditer(text):
        end = closing.get(m.end() - 1)
        if (closed := end is not None) is False:  # up to the paragraph's end
            end = text.find("\n\n", m.end())
            end = len(text) if end < 0 else end
        nodes.append(Node(m.start(), end + closed, KIND["tex_heading" if m.group(1) in HEADING_COMMANDS else "tex_inline"], (m.end(), end), m.group(1), closed=closed))


def _block_lines(text: str, nodes: list[Node]) -> None:
    group: list[re.Match] = []
    pipes: list[re.Match] = []
    fence: re.Match | None = None
    wiki_open: re.Match | None = None

    def close_list() -> None:
        if group:
            hashes = group[0].group("item").lstrip().startswith("#")
            body = sum(bool(_ENDS.search(g.group())) for g in group)
            nodes.append(Node(group[0].start(), group[-1].end(), KIND["hash_list" if hashes else "list_lines"], (group[0].start(), group[-1].end()), group[0].group("mark") or "*", run=len(group), closed=2 * body >= len(group)))
            group.clear()

    def close_table() -> None:
        if pipes:
            rule = len(pipes) > 1 and set(pipes[1].group().strip()) <= set("|-: ")
            nodes.append(Node(pipes[0].start(), pipes[-1].end(), KIND["pipe_table"], (pipes[0].start(), pipes[-1].end()), "rule" if rule else "", run=len(pipes)))
            pipes.clear()

    for m in _LINES.finditer(text):
        if fence is not None:
            if m.group("fence") and m.group("tick")[:3] == fence.group("tick")[:3] and m.group().strip() == m.group("tick"):
                nodes.append(Node(fence.start(), m.end(), KIND["fence"], (fence.end(), m.start())))
                fence = None
            continue
        if group and not (m.group("item") and m.start() == group[-1].end() + 1) and not (m.group("atx") and m.start() == group[-1].end() + 1):
            close_list()
        if pipes and not (m.group("pipe") and m.start() == pipes[-1].end() + 1):
            close_table()
        if m.group("fence"):
            fence = m
        elif m.group("open"):
            wiki_open = m
        elif m.group("pipe"):
            line = m.group().strip()
            if wiki_open is not None:
                if line.startswith("|}"):
                    nodes.append(Node(wiki_open.start(), m.end(), KIND["wiki_table"], (wiki_open.end(), m.start()), wiki_open.group(), run=text.count("\n", wiki_open.start(), m.end())))
                    wiki_open = None
            elif line.count("|") >= 2:
                pipes.append(m)
        elif m.group("atx"):
            inner = m.start() + m.group().index("#") + len(m.group("hashes"))
            nodes.append(Node(m.start(), m.end(), KIND["atx"], (inner, m.end()), m.group("hashes")))
            if m.group("hashes") == "#":
                before = nodes[-2] if len(nodes) > 1 else None
                if before is not None and before.kind == KIND["hash_list"] and before.end + 1 == m.start():
                    before.end, before.inner, before.run = m.end(), (before.inner[0], m.end()), before.run + 1
                    nodes.append(nodes.pop(-2))
                else:
                    nodes.append(Node(m.start(), m.end(), KIND["hash_list"], (m.start(), m.end()), "#", closed=bool(_ENDS.search(m.group()))))
        elif m.group("wiki"):
            width = len(m.group("eq"))
            nodes.append(Node(m.start(), m.end(), KIND["wiki_heading"], (m.start() + width, m.end() - width), m.group("eq")))
        elif m.group("setext"):
            start = text.rfind("\n", 0, max(0, m.start() - 1)) + 1
            title = text[start : max(0, m.start() - 1)]
            if title.strip() and not _MARKED.match(title):
                nodes.append(Node(start, m.end(), KIND["setext"], (start, start + len(title)), m.group()[0]))
        elif m.group("item"):
            group.append(m)
    close_list()
    close_table()
    if fence is not None:
        nodes.append(Node(fence.start(), len(text), KIND["fence"], (fence.end(), len(text)), closed=False))


def nodes_of(text: str) -> list[Node]:
    """The tree of proposed nodes of a text, ancestors before descendants."""
    nodes: list[Node] = []
    hidden = _tags(text, nodes) if "<" in text or "&" in text else []
    if "\\" in text:
        _tex(text, nodes)
    _block_lines(text, nodes)
    for m in _SPANS.finditer(text):
        nodes.append(Node(m.start(), m.end(), KIND[m.lastgroup], m.span()))
    if hidden:
        hidden.sort()
        starts = [a for a, _ in hidden]
        nodes = [n for n in nodes if not ((k := bisect_right(starts, n.start) - 1) >= 0 and n.start < hidden[k][1])]
    nodes.sort(key=lambda n: (n.start, -n.end, n.kind))
    stack: list[int] = []
    for i, n in enumerate(nodes):
        while stack and nodes[stack[-1]].end <= n.start:
            stack.pop()
        while stack and nodes[stack[-1]].end < n.end:  # crossing spans are siblings
            stack.pop()
        if stack:
            n.parent = stack[-1]
            nodes[stack[-1]].children.append(i)
        stack.append(i)
    return nodes


_SORT = np.array([0] * 7 + [1, 1, 2, 3, 1, 2, 3, 1, 3] + [1, 1, 3, 3, 3, 1, 2, 3] + [1, 1, 1, 1, 2, 1, 1, 2, 2, 3, 1, 1, 1, 1])


SIGN, DIGIT, BLANK, ALNUM = 1, 2, 4, 8


@functools.cache
def _classes() -> np.ndarray:
    """What a code point is, a bit each; those above the first plane count as letters."""
    out = np.full(0x10001, ALNUM, np.uint8)
    for k in range(0x10000):
        ch = chr(k)
        out[k] = BLANK if ch.isspace() else (ALNUM | DIGIT * ch.isdecimal()) if ch.isalnum() or ch == "_" else SIGN
    return out


def features(text: str, nodes: list[Node]) -> np.ndarray:
    """One row of features for each node, over its whole span; sums over spans are differences of running sums."""
    out = np.zeros((len(nodes), WIDTH), np.float32)
    kinds = np.array([n.kind for n in nodes])
    out[np.arange(len(nodes)), kinds] = 1
    sorts = np.log1p(np.bincount(_SORT[kinds], minlength=4))
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    what = _classes()[np.minimum(points, 0x10000)]
    seen = (what & BLANK) == 0
    total = {bit: np.concatenate(([0], np.cumsum((what & bit) > 0))) for bit in (SIGN, DIGIT, ALNUM)}
    begins = seen & np.concatenate(([True], ~seen[:-1]))
    words = np.concatenate(([0], np.cumsum(begins)))
    at = np.arange(len(points))
    last = np.concatenate(([-1], np.maximum.accumulate(np.where(seen, at, -1))))  # last visible sign before a place
    following = np.concatenate((np.minimum.accumulate(np.where(seen, at, len(points))[::-1])[::-1], [len(points)]))
    ends = np.flatnonzero(points == 10)
    lines_before = np.searchsorted(ends, [n.start for n in nodes])
    lines_after = np.searchsorted(ends, [n.end for n in nodes])
    # From the leaves up: nodes below, and length of links; from the root down: depth and what stands above.
    below, links = [0] * len(nodes), [0] * len(nodes)
    for i in range(len(nodes) - 1, -1, -1):
        n = nodes[i]
        if KINDS[n.kind] in LINKS or n.kind == KIND["tag_inline"] and n.attrs.startswith("a "):
            links[i] = n.end - n.start
        if n.parent >= 0:
            below[n.parent] += 1 + below[i]
            links[n.parent] += links[i]
    above: list[tuple[int, int, int, int]] = []
    last_end, last_kind = -99, -1
    for i, n in enumerate(nodes):
        if n.parent < 0:
            above.append((0, 0, 0, 0))
        else:
            depth, in_code, in_list, in_table = above[n.parent]
            e = ELEMENT_OF[nodes[n.parent].kind]
            above.append((depth + 1, in_code | (e == "code"), in_list | (e == "list"), in_table | (e == "table")))
        a, b = n.inner
        b = max(a, b)
        size = max(1, b - a)
        n_words = words[b] - words[a] + (0 < a < b and seen[a] and not begins[a])
        closes = last[b] >= a and text[last[b]] in _ENDING
        line_start = ends[lines_before[i] - 1] if lines_before[i] else -1
        line_end = ends[lines_after[i]] if lines_after[i] < len(ends) else len(text)
        low = n.attrs.lower()
        out[i, len(KINDS) :] = (
            np.log1p(max(1, n.end - n.start)), n_words, closes, (total[SIGN][b] - total[SIGN][a]) / size, (total[DIGIT][b] - total[DIGIT][a]) / size, (total[ALNUM][b] - total[ALNUM][a]) / size,
            n.run, n.closed, *above[i], len(n.children), np.log1p(below[i]), min(1.0, links[i] / size),
            last[n.start] <= line_start, following[n.end] >= line_end, len(n.attrs), n.start - last_end < 3 and last_kind == n.kind,
            *(t in low for t in ATTRIBUTE_TOKENS), *sorts, np.log1p(len(text)),
        )
        last_end, last_kind = n.end, n.kind
    return out


_BLOCKED = {"heading": 1, "list": 2, "table": 4}


def decode(nodes: list[Node], odds: np.ndarray) -> list[bool]:
    """The consistent choice of most total log-odds.

    A state is the set of elements that the chosen ancestors block. From the
    leaves up each node has its best total for every state, taken or not; from
    the roots down the choices follow the states.
    """
    own = [_BLOCKED.get(ELEMENT_OF[n.kind], 0) for n in nodes]
    shuts = [_inside(ELEMENT_OF[n.kind]) for n in nodes]
    adds = [None if "*" in s else sum(_BLOCKED[e] for e in s) for s in shuts]
    skipped = [[0.0] * 8 for _ in nodes]  # the children's best, by state
    best = [[0.0] * 8 for _ in nodes]
    taken = [[False] * 8 for _ in nodes]
    for i in range(len(nodes) - 1, -1, -1):
        rest, value = skipped[i], float(odds[i])
        for state in range(8):
            with_it = value + (0.0 if adds[i] is None else rest[state | adds[i]])
            taken[i][state] = not own[i] & state and with_it > rest[state]
            best[i][state] = with_it if taken[i][state] else rest[state]
        if nodes[i].parent >= 0:
            up = skipped[nodes[i].parent]
            for state in range(8):
                up[state] += best[i][state]
    chosen = [False] * len(nodes)
    states: list[int | None] = []
    for i, n in enumerate(nodes):
        state = 0 if n.parent < 0 else states[n.parent]
        if state is not None and taken[i][state]:
            chosen[i] = True
            state = None if adds[i] is None else state | adds[i]
        states.append(state)
    return chosen


def _inside(element: str) -> tuple[str, ...]:
    """Elements that can't stand within an element; * for none at all."""
    return {"code": ("*",), "formula": ("*",), "heading": ("heading", "list"), "list": ("list",), "table": ("table", "list", "heading")}.get(element, ())


@dataclasses.dataclass
class Model:
    boosted: trees.Boosted

    def read(self, texts: list[str]) -> list[tuple[str, list[Node]]]:
        """For each text, the text in which nodes count and the real nodes, in order."""
        parsed, blocks = [], []
        for t in texts:
            t = unescaped(t)
            nodes = nodes_of(t) if _ANY.search(t) else []
            parsed.append((t, nodes))
            if nodes:
                blocks.append(features(t, nodes))
        if not blocks:
            return [(t, []) for t, _ in parsed]
        odds = self.boosted.log_odds(np.concatenate(blocks))
        out, at = [], 0
        for t, nodes in parsed:
            chosen = decode(nodes, odds[at : at + len(nodes)])
            at += len(nodes)
            out.append((t, [n for n, c in zip(nodes, chosen) if c]))
        return out


# ---- training texts


class Writer:
    """Writes texts with known markup from plain sentences."""

    def __init__(self, sentences: list[str], rng: random.Random):
        self.sentences, self.rng = sentences, rng

    def sentence(self) -> str:
        return self.rng.choice(self.sentences)

    def title(self) -> str:
        return " ".join(self.sentence().rstrip(".。").split()[: self.rng.randint(1, 4)])[:30] or "Title"

    def word_marked(self, sort: str) -> str:
        r, parts = self.rng, self.sentence().split(" ")
        k = r.randrange(len(parts))
        w = parts[k]
        parts[k] = r.choice({
            "html": [f"<b>{w}</b>", f"<i>{w}</i>", f"<em>{w}</em>", f'<strong class="hl">{w}</strong>', f"<span style='font-size:9pt'>{w}</span>", f"<font color=red>{w}</font>", f'<a href="images/x.png">{w}</a>', f"<br/>&nbsp; {w}", f"{w}<sup>1</sup>", f"{w}&nbsp;"],
            "md": [f"**{w}**", f"*{w}*", f"__{w}__", f"_{w}_", f"[{w}](images/x.png)", f"{w} ![scan](images/x.png)", f"~~{w}~~", f"`{w}`", f"{w}[^1]"],
            "wiki": [f"'''{w}'''", f"''{w}''", f"[[Annex {r.randint(1, 90)}|{w}]]", f"{w}<ref>A{r.randint(1, 999)}</ref>", "{{Scan}}" + w],
            "tex": [rf"\textbf{{{w}}}", rf"\emph{{{w}}}", rf"\underline{{{w}}}", w + rf"\footnote{{A-{r.randint(1, 99)}}}", w + rf"\cite{{a{r.randint(1, 9)}}}"],
        }[sort])
        return " ".join(parts)

    def formula(self) -> str:
        n = self.rng.randint(2, 999)
        return self.rng.choice([r"\frac{F}{A} = %d" % n, r"E = %d\,\mathrm{GPa}" % n, r"\sigma_{m} \le %d" % n, "p_1 V_1 = p_2 V_2", r"x^2 + y^2 = %d" % n, "E = mc^2", r"Q = %d \cdot \sqrt{h}" % n])

    def code(self) -> str:
        n = self.rng.randint(2, 999)
        return self.rng.choice([
            "for x in items:\n    check(x, %d)\n    total += 1" % n, "mode = fast\nlimit = %d" % n, "open v_%d\n# wait\nclose v_%d" % (n, n),
            '{"a": [10, 20, %d], "b": 2}' % n, "SELECT id FROM t WHERE n > %d" % n, "- a\n- b_%d_c\n* c" % n, "graph TD\n  A[start] --> B{ok}\n  B --> C[end %d]" % n, "# title %d\n1. x\n2. y" % n,
            "| a | b |\n| %d | c |" % n, "**x** = $y_%d$ && `z`" % n,
        ])

    def distractor(self) -> str:
        r = self.rng
        n, m = r.randint(1, 999), r.randint(1, 999)
        return r.choice([
            f"a_{n}_b = {{{m}}}", f"<{n} mm / >{m} mm", f"$ {n} ; $ {m}", f"~{n} ^{m}^2", f"[{n}] *) #{m}", f"{n} < {m} & {n + m} > 3", f"C:\\temp\\{n}_x", f"- {n} -", f"[{n}]", f"{n}/{m}",
            f"{r.randint(10, 60)}. {self.sentence()}", f"snake_case_{n} and other_name_{m}", f"{n} * {m} * 2 = {n * m * 2}", f"x{n} & y{m}; z", f"({n}) {self.sentence()}", f"#{n} - {m}", f"A|B|{n}", f"~{n} kg", f"100 \\% of {n}", "* * *", "-- " + self.sentence(), f"**{n}", f"{{{n}}}", f"price ${n} or ${m}", "– " + self.sentence(),
        ])

    def block(self, sort: str) -> tuple[str, list[str], str]:
        """A block, the elements it makes, and its kind."""
        r = self.rng
        kind = r.choices(("text", "inline", "heading", "list", "code", "formula", "mathline", "table", "odd"), (7, 5, 4, 4, 3, 2, 2, 3, 3))[0]
        html_list = lambda items: "".join(f"<li>{x}</li>" if r.random() < 0.7 else f"<li>{x}\n" for x in items)
        if kind == "text" or kind == "odd":
            body = " ".join(self.sentence() for _ in range(r.randint(1, 3))) if kind == "text" else self.distractor()
            if r.random() < 0.15:
                body += " " + self.distractor()
            if sort == "html":
                body = r.choice(["<p>%s</p>", "<P ALIGN=left>%s", "<div data-bbox=\"1 2 3 4\">%s</div>", "<div><p>%s"]) % body
            return body, [], kind
        if kind == "inline":
            body = self.word_marked(sort)
            return (f"<p>{body}</p>" if sort == "html" else body), ["inline"], kind
        if kind == "heading":
            t = self.title()
            return r.choice({
                "html": [f"<h{r.randint(1, 4)}>{t}</h2>".replace("</h2>", ""), f'<h2 class="sec">{t}</h2>', f"<H3>{t}</H3>", f"<h1 id='h1'>{t}</h1>"],
                "md": ["#" * r.randint(1, 4) + f" {t}", f"# {t}", f"## {t} ##", f"{t}\n" + "=" * r.randint(4, 20), f"{t}\n" + "-" * r.randint(4, 20)],
                "wiki": ["{0} {1} {0}".format("=" * r.randint(1, 4), t)], "tex": [rf"\section{{{t}}}", rf"\subsection*{{{t}}}", rf"\section*{{{t}}}\label{{sec:a}}", rf"\paragraph{{{t}}}"],
            }[sort]), ["heading"], kind
        if kind == "list":
            items = [self.sentence() for _ in range(r.randint(2, 4))]
            if sort == "html":
                inner = html_list(items)
                if r.random() < 0.3:
                    inner += f"<li>{items[0]}<ul>{html_list(items[:1])}</ul></li>"
                tag = r.choice(["ul", "ol"])
                return f"<{tag}>{inner}</{tag}>", ["list"], kind
            if sort == "tex":
                env = r.choice(["itemize", "enumerate"])
                inner = "\n".join(rf"  \item {x}" for x in items)
                if r.random() < 0.3:
                    inner += "\n  \\begin{itemize}\n  \\item " + items[0] + "\n  \\end{itemize}"
                return f"\\begin{{{env}}}\n{inner}\n\\end{{{env}}}", ["list"], kind
            marks = {"md": ["- ", "* ", "+ ", "- [ ] ", "1. ", "2) "], "wiki": ["* ", "# ", "*", "# "]}[sort]
            mark = r.choice(marks)
            lines = [mark.replace("1", str(k + 1) if r.random() < 0.7 else "1") + x for k, x in enumerate(items)]
            if r.random() < 0.3:
                lines.insert(1, ("    " + mark if sort == "md" else "** ") + self.sentence())
            return "\n".join(lines), ["list"], kind
        if kind == "code":
            c = self.code()
            return r.choice({
                "html": [f"<pre>{html.escape(c, False)}</pre>", f"<pre><code>{html.escape(c, False)}</code></pre>", f"<PRE>{c}</PRE>"], "md": [f"```\n{c}\n```", f"~~~text\n{c}\n~~~", f"```sql\n{c}\n```"],
                "wiki": [f'<syntaxhighlight lang="ini">\n{c}\n</syntaxhighlight>', f"<pre>{c}</pre>"], "tex": [f"\\begin{{verbatim}}\n{c}\n\\end{{verbatim}}", f"\\begin{{lstlisting}}\n{c}\n\\end{{lstlisting}}"],
            }[sort]), ["code"], kind
        f = self.formula()
        if kind == "formula":
            return r.choice({
                "html": [f'<math display="block">{f}</math>', f'<div class="math">\\[{f}\\]</div>'], "md": [f"$${f}$$", f"$$\n{f}\n$$"],
                "wiki": [f":<math>{f}</math>", f'<math display="block">{f}</math>'], "tex": [f"\\begin{{equation}}\n{f}\n\\end{{equation}}", f"\\[{f}\\]", f"$${f}$$"],
            }[sort]), ["formula"], kind
        if kind == "mathline":
            return self.sentence() + " " + {"html": rf"\({f}\)", "md": f"${f}$", "wiki": f"<math>{f}</math>", "tex": f"${f}$"}[sort], ["formula"], kind
        cols = r.randint(2, 4)
        rows = [[str(r.randint(1, 9999)) for _ in range(cols)] for _ in range(r.randint(2, 4))]
        if sort == "html":
            return "<table>" + "".join("<tr>" + "".join(f"<td>{x}</td>" for x in row) + "</tr>" for row in rows) + "</table>", ["table"], kind
        if sort == "md":
            lines = ["| " + " | ".join(row) + " |" for row in rows]
            return "\n".join([lines[0], "| " + " | ".join(["---"] * cols) + " |", *lines[1:]]), ["table"], kind
        if sort == "wiki":
            return '{| class="grid"\n' + "\n".join("|-\n| " + " || ".join(row) for row in rows) + "\n|}", ["table"], kind
        return f"\\begin{{tabular}}{{{'l' * cols}}}\n" + "\n".join(" & ".join(row) + r" \\" for row in rows) + "\n\\end{tabular}", ["table"], kind

    def text(self) -> tuple[str, list[tuple[int, int, str]]]:
        """A text and the spans of its blocks with the element that each makes ('' for none)."""
        r = self.rng
        sorts = r.sample(["html", "md", "wiki", "tex"], 1 if r.random() < 0.8 else 2)
        plain = r.random() < 0.2
        gap = "\n\n" if sorts != ["html"] else r.choice(["\n\n", "\n", ""])
        out, spans, at = [], [], 0
        for _ in range(r.randint(2, 12)):
            sort = r.choice(sorts)
            body, elements, _ = self.block(sort)
            if plain and elements:
                body, elements = (self.distractor() if r.random() < 0.3 else self.sentence()), []
            spans.append((at, at + len(body), elements[0] if elements else ""))
            out.append(body)
            at += len(body) + len(gap)
        return gap.join(out), spans


def training_rows(sentences: list[str], texts: int = WRITTEN, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Features and truth of the proposed nodes of written texts: a node is real if its block makes its element and no node of that element stands above it in the block."""
    writer = Writer(sentences, random.Random(seed))
    rows, truth = [np.zeros((0, WIDTH), np.float32)], []
    for _ in range(texts):
        text, spans = writer.text()
        nodes = nodes_of(text)
        if not nodes:
            continue
        rows.append(features(text, nodes))
        starts = [a for a, _, _ in spans]
        for n in nodes:
            k = bisect_right(starts, n.start) - 1
            a, b, element = spans[max(k, 0)]
            real = element == ELEMENT_OF[n.kind] and n.start < b
            up = n.parent
            while real and up >= 0:
                if nodes[up].start >= a and ELEMENT_OF[nodes[up].kind] == element and element != "inline":
                    real = False
                up = nodes[up].parent
            truth.append(real)
    return np.concatenate(rows), np.array(truth, float)


def fit(sentences: list[str]) -> Model:
    if not sentences:
        sentences = ["The part was tested before delivery.", "See page 4 for the position of the holes."]
    return Model(trees.fit(*training_rows(sentences)))


def fit_on(documents: DataFrame, carriers: int = CARRIERS) -> Model:
    """A model whose training texts carry sentences of about ``carriers`` documents without a sign of markup."""
    plain = (F.length("text").between(80, 4000)) & ~F.col("text").rlike(r"[<>&\\$`~*_|#{}\[\]=]")
    texts = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    rows = bounded_sample(texts.where(plain), carriers, documents.count())
    own = [s.strip() for r in rows for s in re.split(r"(?<=[.!?])\s+|(?<=。)|\n+", r.text)]
    return fit([s for s in own if 6 <= len(s) <= 300])


# ---- results


def elements(real: list[Node]) -> dict[str, int]:
    """How many elements of each kind the real nodes make."""
    out: dict[str, int] = {}
    for n in real:
        e = ELEMENT_OF[n.kind]
        out[e] = 1 if e == "inline" else out.get(e, 0) + 1
    return out


_FRAMES = FRAME_TAGS | PART_TAGS | LIST_TAGS | TABLE_TAGS | HEADING_TAGS | CODE_TAGS | FORMULA_TAGS
_STRIP = re.compile(r"<!--.*?-->|<(style|script|title)\b.*?</\1>|</?([a-zA-Z][a-zA-Z0-9]*)((?:\s[^<>]*)?)>|<![A-Za-z][^<>]*>", re.S | re.I)
_ROWS = re.compile(r"</tr>|<tr\b[^>]*>", re.I)
_CELLS = re.compile(r"<t[dh]\b[^>]*>", re.I)
_FRAME = re.compile(r"\\(?:documentclass|usepackage)(?:\[[^\]]*\])?\{[^}]*\}|\\(?:begin|end)\{document\}|\\label\{[^}]*\}|\\maketitle")


def _flat(text: str, closed: frozenset[str] = frozenset(), tex: bool = False) -> str:
    """A piece without frames' and blocks' tags, the closing tags named ``closed``, comments and TeX frames; TeX's escaped signs as signs if ``tex``."""

    def tag(m: re.Match) -> str:
        name = (m.group(2) or "").lower()
        if not name:
            return ""
        if name in ("p", "div") and _ATTRIBUTES.fullmatch(m.group(3)):
            return "\n"
        gone = name in _FRAMES and _ATTRIBUTES.fullmatch(m.group(3)) or m.group().startswith("</") and name in closed
        return "" if gone else m.group()

    if "<" in text:
        text = _STRIP.sub(tag, text)
    if "\\" in text:
        text = _FRAME.sub("", text)
        if tex:
            text = text.replace("\\%", "%").replace("\\&", "&")
    return text


def _cells(text: str, kind: str, flat) -> str:
    if kind == "tag_table":
        rows = [[flat(c).strip() for c in _CELLS.split(r)[1:]] for r in _ROWS.split(text)]
    elif kind == "env_table":
        body = re.sub(r"^\{[^}]*\}", "", text.strip())
        rows = [[flat(c).strip() for c in re.split(r"(?<!\\)&", r)] for r in body.split("\\\\") if r.strip()]
    elif kind == "wiki_table":
        rows = [[c.strip() for c in re.split(r"\|\||!!", line.lstrip("|! "))] for line in text.split("\n") if line.strip() and not line.startswith(("|-", "{|", "|}"))]
    else:
        rows = [[c.strip() for c in line.strip().strip("|").split("|")] for line in text.split("\n") if set(line.strip()) - set("|-: ")]
    return "\n".join("| " + " | ".join(r) + " |" for r in rows if r)


def _list(text: str, kind: str, flat) -> str:
    if kind == "tag_list":
        text = re.sub(r"<li\b[^>]*>", "\n- ", text, flags=re.I)
    elif kind == "env_list":
        text = re.sub(r"\\(begin|end)\{\w+\}", "", text).replace("\\item", "\n-")
    lines = [re.sub(r"^[ \t]*(?:[-+•*#:;]+|\d+[.)]|[a-z][.)])[ \t]*(?:\[[ xX]\][ \t]*)?", "- ", x) for x in flat(text).split("\n") if x.strip()]
    return "\n".join(x if x.startswith("- ") else "- " + x.strip() for x in lines)


def clean(text: str, real: list[Node]) -> str:
    """The text with headings as '#', lists as '-', code fenced, formulas in '$', tables in '|', and all other chosen markup and frames taken away."""
    closed = frozenset(n.attrs.split()[0].lower() for n in real if KINDS[n.kind] == "tag_inline" and n.attrs.split())
    tex = any(KINDS[n.kind].startswith(("tex_", "env_")) for n in real) or bool(_FRAME.search(text))
    flat = functools.partial(_flat, closed=closed, tex=tex)

    def written(n: Node, inner: list[Node]) -> str:
        """A node as it stands in clean text; ``inner`` are the nodes within it."""
        kind, e = KINDS[n.kind], ELEMENT_OF[n.kind]
        body = text[n.inner[0] : n.inner[1]]
        if e == "heading":
            level = int(n.attrs.count("#") or n.attrs.count("=") or 1) if kind in ("atx", "wiki_heading") else 1
            return "\n" + "#" * min(level, 6) + " " + " ".join(flat(filled(n, inner)).strip(" #\n").split()) + "\n"
        if e == "list":
            return "\n" + _list(filled(n, inner), kind, flat) + "\n"
        if e == "code":
            code = _signs_of(re.sub(r"^\s*<code\b[^<>]*>|</code>\s*$", "", body)) if kind == "tag_code" else body
            return "\n```\n" + code.strip("\n") + "\n```\n"
        if e == "formula":
            return "$" + re.sub(r"^(\\[\[(]|\$+)|(\\[\])]|\$+)$", "", body.strip()).strip() + "$"
        if e == "table":
            return "\n" + _cells(filled(n, inner), kind, flat) + "\n"
        return _inline(n)

    def _inline(n: Node) -> str:
        kind, piece = KINDS[n.kind], text[n.start : n.end]
        if kind == "tag_inline":
            return "\n" if n.attrs[:2].lower() == "br" else ""
        if kind == "entity":
            return html.unescape(piece).replace("\xa0", " ")
        if kind == "tex_inline":
            return text[n.inner[0] : n.inner[1]] if n.attrs in ("textbf", "textit", "emph", "underline", "texttt", "textsc") else ""
        if kind in ("link", "image"):
            return re.sub(r"^!?\[([^\]]*)\].*$", r"\1", piece, flags=re.S)
        if kind == "wiki_link":
            return piece[2:-2].rpartition("|")[2]
        if kind in ("template", "footmark"):
            return ""
        return piece.strip("*_'~`")

    def filled(n: Node, inner: list[Node]) -> str:
        """The inside of a block with the nodes in it written; those of its lists and headings keep their lines."""
        out, at = [], n.inner[0]
        for c in inner:
            if c.start < at or c.end > n.inner[1] or ELEMENT_OF[c.kind] not in ("inline", "formula"):
                continue
            out.append(text[at : c.start])
            out.append(written(c, []))
            at = c.end
        out.append(text[at : n.inner[1]])
        return "".join(out)

    out, at = [], 0
    for k, n in enumerate(real):
        if n.start < at:
            continue
        out.append(flat(text[at : n.start]))
        at = n.end
        j = k + 1
        while j < len(real) and real[j].start < n.end:
            j += 1
        out.append(written(n, real[k + 1 : j]))
    out.append(flat(text[at:]))
    return re.sub(r"\n{3,}", "\n\n", "".join(out)).strip() if real or "<" in text or "\\" in text else text


#: Texts parsed together, which bounds a worker's memory.
AT_ONCE = 256


def _mapped(rows: DataFrame, model: Model, write, schema: str) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(model)  # a fixed size: trees times nodes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(start, AT_ONCE)
                out = write(part, found)
                if out is not None:
                    yield out

    return rows.mapInArrow(run, schema)


def found(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, element, seq of every element of ``documents(doc_id, text)``."""

    def write(part: pa.RecordBatch, m: Model) -> pa.RecordBatch | None:
        ids, names, seqs = [], [], []
        for doc_id, (_, real) in zip(part.column(0).to_pylist(), m.read(part.column(1).to_pylist())):
            for e, n in elements(real).items():
                ids.extend([doc_id] * n)
                names.extend([e] * n)
                seqs.extend(range(1, n + 1))
        return pa.record_batch([pa.array(ids, pa.int64()), pa.array(names, pa.string()), pa.array(seqs, pa.int32())], names=["doc_id", "element", "seq"]) if ids else None

    slim = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.length("text") > 0)
    return _mapped(slim, model, write, "doc_id long, element string, seq int")


def cleaned(rows: DataFrame, model: Model, keys: list[str]) -> DataFrame:
    """``keys`` and the clean text of ``rows(*keys, text)``."""

    def write(part: pa.RecordBatch, m: Model) -> pa.RecordBatch:
        texts = part.column(part.num_columns - 1).to_pylist()
        read = m.read([t or "" for t in texts])
        new = [None if t is None else clean(*r) if r[0] else t for t, r in zip(texts, read)]
        return pa.record_batch([*part.columns[:-1], pa.array(new, pa.string())], names=[*keys, "text"])

    slim = rows.select(*keys, F.col("text").cast("string").alias("text"))
    return _mapped(slim, model, write, slim.schema)
