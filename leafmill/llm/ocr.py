"""Noise of scanned pages: furniture, broken and misread words; and the text without it.

One pass over all texts counts and decides: word counts come from the middle
of lines, where no word is broken; furniture templates are lines, numbers
masked and glyphs made alike, that stand at page borders nearly always and
repeat within documents; page words are those before numbers that count up at
borders; and the texts that are pages are written down once, for the two steps
that read them.

Skip-gram vectors come from the pages by one aggregation: every word has fixed
random signs, drawn from its hash, and a word's vector is the sum of the signs
of the words around it, frequent ones damped as skip-gram training subsamples
them, less what chance would give. So no trainer's partitions or rounds decide
them, and rare words have them as well.

Then each page is read once. A rare word is linked to the words it may be a
misreading of (a stroke skeleton finds them, an alignment proves the edits);
the odds of a link are the ratio of the counts, weighed by the vectors: how much
the neighbour's is like the rare word's own or, where that one comes too rarely
to have any, how well it fits the words around. The best neighbour whose odds
reach ``LINK`` is the correction. Lines that are furniture are
named, words broken at line ends are joined by the counts, and what remains
flows into paragraphs.

What is sent to all tasks is bounded: ``VOCABULARY`` words with their vectors
and ``TEMPLATES`` templates. Where a corpus has more, the rest stays a table,
and each text gets what it needs of it, vectors too, by a join; so results do
not depend on the two bounds. Counts cover all rows.

Defined results: null, empty and blank texts have no lines of noise and stay
as they are; lines are split at newline only, so a form feed belongs to its
line; a text is a page if it is labelled scanned, holds a form feed or has
lines that break like a page's, and only pages have rows or are repaired;
equal texts with equal labels give equal rows; other columns are ignored.
"""

from __future__ import annotations

import dataclasses
import functools
import itertools
import math
import re
import unicodedata
from collections import ChainMap, Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.session import cut_lineage

VOCABULARY, TEMPLATES = 200_000, 20_000
#: A word is known from this count; a neighbour comes this often; a word is much rarer than another from this ratio.
KNOWN, OFTEN, RATIO = 3, 5, 20
#: Odds that a link of a rare word and a neighbour needs.
LINK = 200
#: What a cosine adds to the logarithm of the odds: the cosine that adds nothing, the slope, the least and the most. For two vectors, then for a vector and one context.
ALIKE, FITTING = (0.4, 10.0, -4.0, 3.0), (0.2, 8.0, -0.25, 3.0)
#: A furniture template: documents it comes in, share of its lines at page borders, share of its documents that repeat it.
TEMPLATE_DOCS, AT_BORDER, REPEATED = 3, 0.6, 0.25
#: A page word: share of its lines at the edge of a text or beside a form feed, share of those after another that count up by one.
AT_EDGE, COUNTED_UP = 0.3, 0.8
#: Lines longer than this are taken for titles only where they stand at a page's border; a printed line is no longer than WIDEST.
TITLE, WIDEST = 70, 140
#: Words on each side that make a context; words above this share of all are damped in it.
WINDOW, FREQUENT = 3, 1e-3
#: Signs of a vector: the bits of a 64-bit hash.
VECTOR = 64
AT_ONCE = 256

# What a glyph or pair of glyphs is misread as.
MISREAD = {
    "e": ["c"], "a": ["@"], "i": ["1", "l"], "o": ["0"], "t": ["f"], "s": ["5"], "u": ["ii"], "l": ["1", "i"], "d": ["cl"], "m": ["rn"],
    "g": ["q"], "h": ["b"], "b": ["6"], "in": ["m"], "ri": ["n"], "li": ["h"], "w": ["vv"], "rn": ["m"], "c": ["e"], "f": ["t"], "n": ["ri"],
    "O": ["0"], "I": ["l", "1"], "S": ["5"], "B": ["8", "6"],
}
# Strokes that make glyphs of one skeleton alike.
_STROKES = str.maketrans({"m": "ııı", "n": "ıı", "r": "ı", "i": "ı", "l": "ı", "1": "ı", "u": "ıı", "h": "ıı", "b": "ıı", "6": "ıı", "d": "eı", "c": "e", "w": "vv", "@": "a", "0": "o", "5": "s", "8": "ıı", "f": "t", "q": "g"})
# Signs that stand for a hyphen at a line's end.
HYPHEN_SIGNS = "-¬–‐‑­="

_TOKEN = re.compile(r"(?:[^\W_㐀-鿿]+|@)+")
_PLAIN_TOKENS = re.compile(r"[\w@]+").findall
_NO_TOKEN = re.compile(r"[_㐀-鿿]")
_HAN = re.compile(r"[㐀-鿿]")
_CODE = re.compile(r"[A-Z]{1,3}-\d+|[A-Z]\d+/\d+|\d+\.\d+\.[A-Z]\d+")
_NUMBERLIKE = re.compile(r"[\dOolISB]*\d[\dOolISB]*")
_DIGIT, _LETTER = re.compile(r"\d"), re.compile(r"[^\W\d_]")
_ZERO = re.compile(r"[​-‏⁠﻿]|­(?=.)")
_SUFFIX = re.compile(r"(?:\s*[|–—]\s*|\s+-\s+|\s{2,})[\dOlISB]{1,4}$")
_D = r"[\dOlISB]{1,5}"
_PAGE_FORMS = [
    ("slash", re.compile(rf"({_D})\s?/\s?{_D}")), ("square", re.compile(rf"\[\s?({_D})\s?\]")), ("dash", re.compile(rf"[-–—]\s?({_D})\s?[-–—]")),
    ("round", re.compile(rf"\(\s?({_D})\s?\)")), ("named", re.compile(rf"[^\W\d_]{{1,12}}\.?\s({_D})(?:\s[^\W\d_]{{1,4}}\.?\s{_D})?")), ("han", re.compile(rf"第\s?({_D})\s?页(?:\s?[，,]?\s?共\s?{_D}\s?页)?")),
    ("roman", re.compile(r"([ivxlIVXL]{1,7})")), ("bare", re.compile(rf"({_D})")),
]
_NAMED = dict(_PAGE_FORMS)["named"]
# The word for page, as its glyph skeleton has it.
_PAGE_WORDS = ("page", "página", "pagina", "seite", "страница", "стр", "pág", "pag", "p", "s", "blatt", "sheet", "hoja", "folha", "feuille", "лист")
_NUMBER = str.maketrans({"O": "0", "o": "0", "l": "1", "I": "1", "S": "5", "B": "8"})
_ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50}
_CLOSED = re.compile(r"[.!?。！？:;：；…)”»\]]\s*$")
_FOREIGN = re.compile(r"[|<>\\{}$#*_`]")


@functools.lru_cache(maxsize=200_000)
def skeleton(word: str) -> str:
    return word.lower().translate(_STROKES)


@functools.lru_cache(maxsize=200_000)
def edits(true: str, read: str, most: int = 3) -> int:
    """Least number of plausible misreadings that turn ``true`` into ``read``; most + 1 if there is no such way."""
    n, m = len(true), len(read)

    @functools.cache
    def least(i: int, j: int, left: int) -> int:
        while i < n and j < m and true[i] == read[j]:
            # An equal glyph may still begin a misread pair: try that only where a pair could.
            if left and true[i : i + 2] in MISREAD and len(MISREAD[true[i : i + 2]][0]) == 1 and read.startswith(tuple(MISREAD[true[i : i + 2]]), j):
                break
            i, j = i + 1, j + 1
        if i == n or j == m:
            return 0 if i == n and j == m else most + 1
        best = most + 1
        if true[i] == read[j]:
            best = least(i + 1, j + 1, left)
        if left:
            for width in (1, 2):
                for to in MISREAD.get(true[i : i + width], ()) if i + width <= n else ():
                    if read.startswith(to, j):
                        best = min(best, 1 + least(i + width, j + len(to), left - 1))
        return best

    return least(0, 0, most)


def number(text: str, roman: bool = False) -> int | None:
    """A number with misread digits, or a Roman one."""
    low = text.lower()
    if roman and low and set(low) <= set("ivxl"):
        values = [_ROMAN[ch] for ch in low]
        return sum(-v if k + 1 < len(values) and v < values[k + 1] else v for k, v in enumerate(values))
    text = text.translate(_NUMBER)
    return int(text) if text.isdigit() else None


def page_number(line: str, words: frozenset[str] = frozenset()) -> tuple[str, int] | None:
    """Form and number of a line that may hold only a page number; ``words`` are skeletons of page words besides the fixed ones."""
    s = line.strip()
    return _page_number(s, words) if 0 < len(s) <= 30 else None


@functools.lru_cache(maxsize=50_000)
def _page_number(s: str, words: frozenset[str]) -> tuple[str, int] | None:
    for form, pattern in _PAGE_FORMS:
        m = pattern.fullmatch(s)
        if not m:
            continue
        if form == "named" and not _page_word(word := re.match(r"[^\W\d_]+", s).group()) and skeleton(word) not in words:
            return None
        value = number(m.group(1), form == "roman")
        if value is not None and (form != "bare" or any(ch.isdigit() for ch in s) or s in ("l", "I")):
            return form, value
    return None


@functools.lru_cache(maxsize=10_000)
def _page_word(word: str) -> bool:
    own = skeleton(word)
    return any(skeleton(w) == own for w in _PAGE_WORDS)


def named_number(line: str) -> tuple[str, int] | None:
    """The skeleton of the word and the number of a line that is a word and a number."""
    s = line.strip()
    if not 0 < len(s) <= 30 or not (m := _NAMED.fullmatch(s)) or (value := number(m.group(1))) is None:
        return None
    return skeleton(re.match(r"[^\W\d_]+", s).group()), value


def template(line: str) -> tuple[str, bool]:
    """A line with numbers and codes masked and glyphs made alike, without a page number at its end, and whether there was one."""
    return _template(line.strip())


@functools.lru_cache(maxsize=50_000)
def _template(s: str) -> tuple[str, bool]:
    cut = _SUFFIX.sub("", s)
    masked = _NUMBERLIKE.sub("#", _CODE.sub("#", cut))
    # A digit within a word is a misread letter, not a number.
    words = [w if "#" not in w or set(w) <= set("#.,/-|–()[]") else skeleton(o) for w, o in zip(masked.split(), _CODE.sub("#", cut).split())]
    return skeleton(" ".join(words)), cut != s


def lines_of(text: str) -> list[str]:
    """Lines with accents composed and invisible signs taken away, but for a soft hyphen at a line's end."""
    if not text.isascii():
        text = _ZERO.sub("", unicodedata.normalize("NFC", text))
    return text.split("\n")


def broken_like_a_page(lines: list[str]) -> bool:
    """True if a line ends before its sentence does, near the width of the text.

    In a text that has lines no page could hold, two lines of one block must do
    so, each followed by a line that goes on in lower case.
    """
    widest = max(map(len, lines), default=0)
    if widest <= WIDEST:
        return any(_breaks(a, b, widest) for a, b in zip(lines, lines[1:]))
    for blank, block in itertools.groupby(lines, lambda x: not x.strip()):
        block = [] if blank else list(block)
        if len(block) > 2 and 40 <= (widest := max(map(len, block))) <= WIDEST:
            if sum(_breaks(a, b, widest) and (b.lstrip()[0].islower() or bool(_HAN.match(b.lstrip()))) for a, b in zip(block, block[1:])) > 1:
                return True
    return False


def _breaks(line: str, following: str, widest: int) -> bool:
    s = line.rstrip()
    return len(s) >= 0.5 * widest and bool(following.strip()) and not _CLOSED.search(s) and not _FOREIGN.search(s)


def is_page(text: str, label: str | None) -> bool:
    return label == "scanned" or "\f" in text or broken_like_a_page(text.split("\n"))


def at_edge(k: int, full: list[int], lines: list[str]) -> bool:
    """True if the k-th line that isn't blank is the first or last of the text or beside a form feed."""
    return k == 0 or k == len(full) - 1 or "\f" in lines[full[k]] or "\f" in lines[full[k + 1]]


def border(k: int, full: list[int], lines: list[str], words: frozenset[str] = frozenset()) -> bool:
    """True if the k-th line that isn't blank stands at a page's border."""
    return at_edge(k, full, lines) or page_number(lines[full[k - 1]], words) is not None or page_number(lines[full[k + 1]], words) is not None


# ---- what is learnt from the corpus


def counted(texts: list[tuple[str, bool]]) -> tuple[Counter, dict[str, list[int]], dict[str, list[int]]]:
    """Counts over (text, whether it is a page).

    Words in the middle of lines. For each template of lines of pages that may
    be titles: documents, lines, lines at borders, documents that repeat it.
    For each word before a number alone on a line: documents, lines, lines at
    edges, lines whose number is one above that of the line before.
    """
    middle: list[str] = []
    furniture: dict[str, list[int]] = defaultdict(lambda: [0, 0, 0, 0])
    named: dict[str, list[int]] = defaultdict(lambda: [0, 0, 0, 0])
    for text, page in texts:
        plain = text
        if not text.isascii():
            plain = _NO_TOKEN.sub(" ", _ZERO.sub("", unicodedata.normalize("NFC", text)))
        elif "_" in text:
            plain = text.replace("_", " ")
        for line in plain.split("\n"):
            middle += _PLAIN_TOKENS(line)[1:-1]
        if not page:
            continue
        lines = lines_of(text)
        full = [i for i, x in enumerate(lines) if x.strip()]
        if len(full) < 3:
            continue
        seen: dict[str, int] = {}
        last: dict[str, int] = {}
        for k, i in enumerate(full):
            line = lines[i]
            if found := named_number(line):
                word, value = found
                row = named[word]
                row[0] += word not in last
                row[1] += 1
                row[2] += at_edge(k, full, lines)
                row[3] += last.get(word, value) + 1 == value
                last[word] = value
            if _CLOSED.search(line) or page_number(line) or len(line.strip()) > TITLE and not border(k, full, lines):
                continue
            t, numbered = template(line)
            if not _LETTER.search(t):
                continue
            row = furniture[t]
            row[1] += 1
            row[2] += numbered or border(k, full, lines)
            seen[t] = seen.get(t, 0) + 1
        for t, n in seen.items():
            furniture[t][0] += 1
            furniture[t][3] += n > 1
    return Counter(middle), furniture, named


@functools.lru_cache(maxsize=200_000)
def signs(word: str) -> np.ndarray:
    """The fixed random signs of a word as a context of others."""
    return np.unpackbits(np.frombuffer(xxhash.xxh3_64_digest(word), np.uint8)).astype(np.float32) * 2 - 1


@dataclasses.dataclass
class Model:
    words: dict[str, int]
    furniture: frozenset[str]
    #: Unit vectors of words in lower case, in steps of 1/127.
    vectors: dict[str, np.ndarray]
    #: What the three above leave out: kind (word, line or skeleton), key, word, docs, vector. Tasks have True in its place.
    rest: DataFrame | bool | None = None
    #: Weight of a frequent word in a context; mean of a context word.
    damped: dict[str, float] = dataclasses.field(default_factory=dict)
    mean: np.ndarray | None = None
    page_words: frozenset[str] = frozenset()
    #: The corpus's own pages (doc_id, text), as written down while counting; not sent to tasks.
    pages: DataFrame | None = None

    def __post_init__(self) -> None:
        # Words too frequent to be a misreading of any other; templates without a number.
        self.most = max(self.words.values(), default=1 << 62)
        self.common = frozenset(w for w, n in self.words.items() if n * RATIO > self.most)
        self.unnumbered = self.rest is not None or any("#" not in t for t in self.furniture)
        self.by_skeleton: dict[str, list[str]] = defaultdict(list)
        for w, n in self.words.items():
            if n >= OFTEN and len(w) >= 3 and w.isalpha():
                self.by_skeleton[skeleton(w)].append(w)

    def __getstate__(self) -> tuple:
        return self.words, self.furniture, self.vectors, None if self.rest is None else True, self.damped, self.mean, self.page_words, None

    def __setstate__(self, state: tuple) -> None:
        self.words, self.furniture, self.vectors, self.rest, self.damped, self.mean, self.page_words, self.pages = state
        self.__post_init__()

    def with_more(self, rows: list[dict]) -> Model:
        """This model and rows of the rest."""
        if not rows:
            return self
        own = object.__new__(Model)
        own.__dict__ |= self.__dict__
        own.words = ChainMap({r["word"]: r["docs"] for r in rows if r["kind"] != "line"}, self.words)
        own.common = self.common | {w for w, n in own.words.maps[0].items() if n * RATIO > self.most}
        own.furniture = self.furniture | {r["key"] for r in rows if r["kind"] == "line"}
        own.vectors = ChainMap({r["word"].lower(): np.frombuffer(r["vector"], np.int8) for r in rows if r["vector"]}, self.vectors)
        alike: dict[str, set[str]] = defaultdict(set)
        for r in rows:
            if r["kind"] == "skeleton":
                alike[r["key"]].add(r["word"])
        own.by_skeleton = ChainMap({k: self.by_skeleton.get(k, []) + sorted(ws) for k, ws in alike.items()}, self.by_skeleton)
        return own

    def count(self, word: str) -> int:
        return max(self.words.get(word, 0), self.words.get(word.lower(), 0))

    def known(self, word: str) -> bool:
        return self.count(word) >= KNOWN

    def stands_alone(self, part: str, whole: str) -> bool:
        """True if ``part`` is a word beside ``whole``: known, and not so much rarer as the fragments of ``whole`` are at any size of the corpus."""
        return self.known(part) and self.count(part) * RATIO > self.count(whole)

    def correction(self, word: str, around: list[str]) -> str | None:
        """The neighbour of a rare word that it is most likely a misreading of, or None if none reaches the odds.

        A word with a digit or sign in it is none, so vectors can only speak for its neighbours.
        """
        alike = self.by_skeleton.get(skeleton(word), ()) if len(word) >= 3 else ()
        if not alike or len(alike) == 1 and alike[0] == word:
            return None
        rare = max(1, self.words.get(word, 0))
        best, score, context = None, 0.0, None
        for u in alike:
            if u == word or self.words[u] <= rare:
                continue
            cost = edits(u, word)
            if cost > 3 or cost > 1 + len(u) // 4:
                continue
            if context is None:
                own = self.vectors.get(word.lower())
                context, kind = (self.context(around), FITTING) if own is None else (own / 127, ALIKE)
            added = self.support(u, context, kind)
            odds = math.log(self.words[u] / rare) + (added if word.isalpha() else max(added, 0.0))
            if odds < LEAST_ODDS:
                continue
            s = odds - 1.5 * cost
            if best is None or s > score or s == score and u < best:
                best, score = u, s
        return best

    def context(self, around: list[str]) -> np.ndarray:
        """The direction of the words around, less what chance would give; zeros if there are none."""
        if self.mean is None or not around:
            return np.zeros(VECTOR)
        low = ["0" if w.isdigit() else w.lower() for w in around]  # numbers are one context
        total = sum(signs(w) * self.damped.get(w, 1.0) for w in low) - len(low) * self.mean
        return total / (np.linalg.norm(total) + 1e-9)

    def support(self, word: str, direction: np.ndarray, kind: tuple[float, float, float, float]) -> float:
        """What the cosine of a word's vector and a direction adds to the logarithm of the odds; 0 if either is unknown."""
        neutral, slope, least, most = kind
        own = self.vectors.get(word.lower())
        if own is None or not direction.any():
            return 0.0
        return min(most, max(least, slope * (float(own @ direction) / 127 - neutral)))


LEAST_ODDS = math.log(LINK)


SURVEY = "kind string, key string, docs long, lines long, borders long, repeats long, doc_id long"


def survey(documents: DataFrame) -> DataFrame:
    """All that one pass over ``documents(text, scan_type)`` gives, as rows of SURVEY: counts by kind (word, line, named) and key, and a row of kind page with the text as key.

    Tasks add up their own counts; the same key comes once from each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: list[dict] = [Counter(), defaultdict(lambda: [0, 0, 0, 0]), defaultdict(lambda: [0, 0, 0, 0])]

        def flush() -> Iterator[pa.RecordBatch]:
            for kind, rows in zip(("word", "line", "named"), sums):
                if rows:
                    values = [[n] for n in rows.values()] if kind == "word" else list(rows.values())
                    columns = [pa.array([v[c] if c < len(v) else 0 for v in values], pa.int64()) for c in range(4)]
                    yield pa.record_batch([pa.array([kind] * len(rows)), pa.array(list(rows)), *columns, pa.nulls(len(rows), pa.int64())], names=names)
                rows.clear()

        for batch in batches:
            for start in range(0, batch.num_rows, AT_ONCE):
                ids, texts, labels = (c.to_pylist() for c in batch.slice(start, AT_ONCE).columns)
                judged = [(t, is_page(t, label)) for t, label in zip(texts, labels)]
                for own, new in zip(sums, counted(judged)):
                    if isinstance(own, Counter):
                        own.update(new)
                        continue
                    for key, row in new.items():
                        own[key] = [a + b for a, b in zip(own[key], row)]
                pages = [(i, t) for i, (t, page) in zip(ids, judged) if page]
                if pages:
                    zeros = [pa.array([0] * len(pages), pa.int64())] * 4
                    yield pa.record_batch([pa.array(["page"] * len(pages)), pa.array([t for _, t in pages], pa.string()), *zeros, pa.array([i for i, _ in pages], pa.int64())], names=names)
                if sum(map(len, sums)) > 300_000:
                    yield from flush()
        yield from flush()

    names = [part.split()[0] for part in SURVEY.split(", ")]
    slim = documents.select((F.col("doc_id") if "doc_id" in documents.columns else F.lit(None)).cast("long"), F.col("text").cast("string").alias("text"), "scan_type")
    return slim.where(F.length(F.trim("text")) > 0).mapInArrow(run, SURVEY)


def corpus_counts(surveyed: DataFrame) -> DataFrame:
    """kind (word, line or named), key, docs, lines, borders, repeats over all texts."""
    sums = ("docs", "lines", "borders", "repeats")
    return surveyed.where("kind <> 'page'").groupBy("kind", "key").agg(*(F.sum(c).alias(c) for c in sums))


def context_sums(pages: DataFrame, damped: dict[str, float]) -> DataFrame:
    """word, n, vector: over all pages, how often each word comes and the sum of the signs of the words within WINDOW of it; the word "" has the sums of all words.

    Tasks add up their own words; then a word's partial sums, one from each
    task at most for each flush, meet in one partition.
    """
    schema = "word string, n long, vector binary"

    def batch_of(sums: dict[str, list]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(list(sums), pa.string()), pa.array([r[0] for r in sums.values()], pa.int64()), pa.array([r[1].astype(np.float32).tobytes() for r in sums.values()], pa.binary())], names=["word", "n", "vector"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, list] = {"": [0, np.zeros(VECTOR)]}
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                ids: dict[str, int] = {}
                at: list[int] = []
                for text in batch.column(0).slice(start, 64).to_pylist():
                    at += [ids.setdefault("0" if w.isdigit() else w, len(ids)) for w in _TOKEN.findall("\n".join(lines_of(text)).lower())]
                    at += [-1] * WINDOW  # no context across texts
                at = np.array(at)
                words = list(ids)
                if not words:
                    continue
                table = np.stack([signs(w) for w in words]) * np.array([damped.get(w, 1.0) for w in words], np.float32)[:, None]
                own = np.where(at[:, None] >= 0, table[at], np.float32(0))
                near = np.zeros_like(own)
                for k in range(1, WINDOW + 1):
                    near[k:] += own[:-k]
                    near[:-k] += own[k:]
                near, at = near[at >= 0], at[at >= 0]
                order = np.argsort(at, kind="stable")
                added, n = np.add.reduceat(near[order], np.r_[0, np.cumsum(np.bincount(at))[:-1]]), np.bincount(at)
                sums[""][0] += int(n.sum())
                sums[""][1] += added.sum(0)
                for w, row, times in zip(words, added, n.tolist()):
                    if len(w) >= 3 and w.isalpha():
                        if w in sums:
                            sums[w][0] += times
                            sums[w][1] = sums[w][1] + row
                        else:
                            sums[w] = [times, row]
                if len(sums) > 100_000:
                    yield batch_of(sums)
                    sums = {"": [0, np.zeros(VECTOR)]}
        yield batch_of(sums)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, list] = {}
        for batch in batches:
            for w, n, v in zip(*(c.to_pylist() for c in batch.columns)):
                row = sums.setdefault(w, [0, np.zeros(VECTOR, np.float32)])
                row[0] += n
                row[1] = row[1] + np.frombuffer(v, np.float32)
        kept = {w: r for w, r in sums.items() if not w or r[0] >= OFTEN}
        if kept:
            yield batch_of(kept)

    return pages.select("text").mapInArrow(run, schema).repartition("word").mapInArrow(add, schema)


def skip_grams(pages: DataFrame, damped: dict[str, float]) -> tuple[DataFrame | None, np.ndarray | None]:
    """word and vector of all words that come often enough, and the mean of a context word."""
    sums = cut_lineage(context_sums(pages, damped))  # read for the mean and for the vectors
    total = sums.where("word = ''").first()
    if total is None or not total.n:
        return None, None
    mean = np.frombuffer(total.vector, np.float32) / total.n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(1).to_numpy()
            raw = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.float32).reshape(-1, VECTOR) - n[:, None] * mean
            unit = np.round(127 * raw / (np.linalg.norm(raw, axis=1, keepdims=True) + 1e-9)).astype(np.int8)
            yield pa.record_batch([batch.column(0), pa.array([v.tobytes() for v in unit], pa.binary())], names=["word", "vector"])

    return sums.where("word <> ''").mapInArrow(run, "word string, vector binary"), mean / (2 * WINDOW)


def _most_frequent(counts: DataFrame, most: int) -> list:
    """All rows above the least threshold that no more than ``most`` rows reach; thresholds are steps of a tenth."""
    step = F.floor(F.log("docs") / F.log(F.lit(1.1)))
    sizes = sorted(((r.step, r.n) for r in counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    total, least = 0, None
    for k, n in sizes:
        if total + n > most:
            break
        total, least = total + n, k
    return [] if least is None else counts.where(step >= least).collect()


def learn(documents: DataFrame) -> Model:
    """The model of a corpus ``documents(text, scan_type)``, with the corpus's pages if it has doc_id."""
    surveyed = cut_lineage(survey(documents))  # read for the counts, for the vectors and for what is found
    pages = surveyed.where("kind = 'page'").select("doc_id", F.col("key").alias("text"))
    at_borders = F.col("borders") >= AT_BORDER * F.col("lines")
    again = F.col("lines") - F.col("docs")  # lines that stand after another of their text
    counts = corpus_counts(surveyed).where(
        ((F.col("kind") == "word") & (F.col("docs") >= KNOWN))
        | ((F.col("kind") == "line") & (F.col("docs") >= TEMPLATE_DOCS) & at_borders & (F.col("repeats") >= REPEATED * F.col("docs")))
        | ((F.col("kind") == "named") & (again >= TEMPLATE_DOCS) & (F.col("borders") >= AT_EDGE * F.col("lines")) & (F.col("repeats") >= COUNTED_UP * again))
    )
    counts = cut_lineage(counts)  # read for the thresholds and for the rows above them
    top = {kind: _most_frequent(counts.where(F.col("kind") == kind), most) for kind, most in (("word", VOCABULARY), ("line", TEMPLATES), ("named", TEMPLATES))}
    words = {r.key: r.docs for r in top["word"]}
    known = counts.where("kind = 'word'")
    # No more than 1 / FREQUENT words can have that share of all.
    total = known.agg(F.sum("docs")).first()[0] or 0
    low = known.groupBy(F.when(F.col("key").rlike(r"^\d+$"), "0").otherwise(F.lower("key")).alias("w")).agg(F.sum("docs").alias("n")).where(F.col("n") > FREQUENT * total)
    damped = {r.w: (FREQUENT * total / r.n) ** 0.5 for r in low.collect()}
    vectors, mean = skip_grams(pages, damped)
    least = min((r.docs for r in top["word"]), default=1 << 62)
    near = {}
    if vectors is not None:
        wanted = known.where(F.col("docs") >= max(least, OFTEN)).select(F.lower("key").alias("word")).distinct()  # at most VOCABULARY
        near = {r.word: np.frombuffer(r.vector, np.int8) for r in vectors.join(wanted, "word", "left_semi").collect()}
    left = functools.reduce(lambda a, b: a | b, ((F.col("kind") == kind) & (F.col("docs") < min((r.docs for r in top[kind]), default=1 << 62)) for kind in ("word", "line")))
    rest = counts.where(left).select("kind", "key", "docs")
    return Model(
        words, frozenset(r.key for r in top["line"]), near, None if rest.isEmpty() else by_key(rest, vectors),
        damped, mean, frozenset(r.key for r in top["named"]), pages,
    )


def by_key(counts: DataFrame, vectors: DataFrame | None) -> DataFrame:
    """kind, key, word, docs, vector of ``counts(kind, key, docs)``: words once by themselves and, if they may be corrections, once by their skeleton."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for kind, key, docs in zip(*(c.to_pylist() for c in batch.columns)):
                rows.append((kind, key, key, docs))
                if kind == "word" and docs >= OFTEN and len(key) >= 3 and key.isalpha():
                    rows.append(("skeleton", skeleton(key), key, docs))
            if rows:
                yield pa.record_batch([pa.array(c) for c in zip(*rows)], names=["kind", "key", "word", "docs"])

    rows = counts.mapInArrow(run, "kind string, key string, word string, docs long")
    if vectors is None:
        return rows.withColumn("vector", F.lit(None).cast("binary"))
    return rows.join(vectors.select(F.col("word").alias("low"), "vector"), F.lower(rows["word"]) == F.col("low"), "left").drop("low")


MORE = "kind string, key string, word string, docs long, vector binary"


def lines_lacking(text: str, model: Model) -> set[tuple[str, str]]:
    """Templates that reading a text asks for and ``model`` doesn't have."""
    lines = lines_of(text)
    keys: set[str] = set()
    for _, _, t, _ in _titles(lines, [i for i, x in enumerate(lines) if x.strip()], model):
        keys |= {t, t.removesuffix("#").rstrip(), t.removesuffix("#").rstrip(" |–-")}
    return {("line", k) for k in keys - model.furniture}


def words_lacking(text: str, model: Model) -> set[tuple[str, str]]:
    """Words and skeletons that reading a text asks for and ``model``, which has its templates, doesn't have."""
    lines = lines_of(text)
    noise: list[set[str]] = [set() for _ in lines]
    full = [i for i, x in enumerate(lines) if x.strip()]
    _numbers(lines, full, noise, _headers(lines, full, noise, model), model)
    body = [i for i in full if not noise[i]]
    words = {w for i in body for w in _TOKEN.findall(lines[i]) if not w.isdigit()}
    for i, j in zip(body, body[1:]):
        if h := _halves(lines[i], lines[j]):
            words |= {h[1], h[2], h[1] + h[2]}
    # A neighbour is more frequent than its word, so words of the model have none in the rest.
    return {k for w in words if w not in model.words for k in (("word", w), ("word", w.lower()), ("skeleton", skeleton(w)))}


def looked_up(rows: DataFrame, model: Model, shared) -> DataFrame:
    """Rows ``rows(text)``, or ``(text, scan_type)`` of which some are no pages, with ``more``: what each text needs of the model's rest, by joins on the key; templates first, as they say which lines are read."""
    kind = f"array<struct<{MORE.replace(' ', ':').replace(',:', ',')}>>"
    rows = rows.withColumns({"h": F.xxhash64("text"), "more": F.array().cast(kind)})
    for lacking in (lines_lacking, words_lacking):

        def run(batches: Iterator[pa.RecordBatch], lacking=lacking) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for h, text, label, more in zip(*(c.to_pylist() for c in batch.columns)):
                    if text and is_page(text, label):
                        out += [(h, *k) for k in lacking(text, shared.value.with_more(more))]
                if out:
                    yield pa.record_batch([pa.array(c) for c in zip(*out)], names=["h", "kind", "key"])

        wanted = rows.select("h", "text", F.col("scan_type") if "scan_type" in rows.columns else F.lit("scanned").alias("scan_type"), "more").mapInArrow(run, "h long, kind string, key string").distinct()
        new = wanted.join(model.rest, ["kind", "key"]).groupBy("h").agg(F.collect_list(F.struct("kind", "key", "word", "docs", "vector")).cast(kind).alias("new"))
        rows = rows.join(new, "h", "left").withColumn("more", F.concat("more", F.coalesce("new", F.array().cast(kind)))).drop("new")
    return rows.drop("h")


# ---- reading a text


@dataclasses.dataclass
class Reading:
    """Kinds of noise by line, from 0; words to put in the place of others; where a line's last word goes on."""

    noise: list[set[str]]
    fixed: list[dict[str, str]]
    goes_on: dict[int, tuple[int, str, str]]


def read(text: str, model: Model) -> Reading:
    lines = lines_of(text)
    noise: list[set[str]] = [set() for _ in lines]
    fixed: list[dict[str, str]] = [{} for _ in lines]
    full = [i for i, x in enumerate(lines) if x.strip()]
    goes_on: dict[int, tuple[int, str, str]] = {}
    headed = _headers(lines, full, noise, model)
    _numbers(lines, full, noise, headed, model)
    body = [i for i in full if not noise[i]]
    for i, j in zip(body, body[1:]):
        _broken(i, j, lines, noise, goes_on, model)
    tails = {j: right for _, (j, _, right) in goes_on.items()}
    tokens = [[], *(_TOKEN.findall(lines[i]) for i in body), []]
    for k, i in enumerate(body):
        # Vectors come from words across lines, so do contexts.
        _misread(i, lines, (tokens[k][-WINDOW:], tokens[k + 1], tokens[k + 2][:WINDOW]), noise, fixed, goes_on, tails, model)
    return Reading(noise, fixed, goes_on)


def _titles(lines: list[str], full: list[int], model: Model) -> Iterator[tuple[int, int, str, bool]]:
    """Place among the full lines, line, template and whether a number was cut off, of each line that may be a title."""
    for k, i in enumerate(full):
        line = lines[i]
        if not model.unnumbered and not _DIGIT.search(line) or _CLOSED.search(line) or page_number(line, model.page_words) is not None:
            continue
        if len(line.strip()) <= TITLE or border(k, full, lines, model.page_words):
            yield k, i, *template(line)


def _headers(lines: list[str], full: list[int], noise: list[set[str]], model: Model) -> bool:
    found = False
    own: dict[str, list[bool]] = defaultdict(list)
    short = list(_titles(lines, full, model))
    for k, _, t, numbered in short:
        if "#" in t and _LETTER.search(t):
            own[t].append(numbered or border(k, full, lines, model.page_words))
    for k, i, t, numbered in short:
        if t in model.furniture or numbered and t.removesuffix("#").rstrip() in model.furniture:
            noise[i].add("header")
            found = True
        elif t.endswith("#") and t.removesuffix("#").rstrip(" |–-") in model.furniture and border(k, full, lines, model.page_words):
            noise[i].add("header")
            found = True
        elif len(own.get(t, ())) > 1 and all(own[t]):  # a title of this text only, at the border of every page that has it
            noise[i].add("header")
            found = True
    return found


def _numbers(lines: list[str], full: list[int], noise: list[set[str]], headed: bool, model: Model) -> None:
    """Numbers of one form that count up from page to page; a single one must stand at a page's border or be of a form that nothing else has."""
    forms: dict[str, list[tuple[int, int, int]]] = defaultdict(list)
    for k, i in enumerate(full):
        if not noise[i] and (p := page_number(lines[i], model.page_words)):
            forms[p[0]].append((k, i, p[1]))
    if "roman" in forms and "bare" in forms:  # a lone l is a one or a roman fifty
        forms["bare"] = sorted(forms["bare"] + [(k, i, 1) for k, i, _ in forms["roman"] if lines[i].strip() in ("l", "I")])
    for form, rows in forms.items():
        longest: list[list[tuple[int, int, int]]] = []
        for row in rows:
            previous = [c for c in longest if c[-1][2] + 1 == row[2]]
            longest.append((max(previous, key=len) if previous else []) + [row])
        chain = max(longest, key=len)
        sure = form in ("slash", "square", "dash", "han", "named")
        for k, i, _ in rows:
            by_furniture = border(k, full, lines, model.page_words) or k > 0 and noise[full[k - 1]] or k + 1 < len(full) and noise[full[k + 1]]
            if len(chain) > 1 and any(i == c[1] for c in chain) or sure or by_furniture and (len(chain) == 1 or k in (0, len(full) - 1) or "\f" in lines[i] or k + 1 < len(full) and "\f" in lines[full[k + 1]]):
                noise[i].add("page_number")


def _halves(line: str, following: str) -> tuple[str, str, str] | None:
    """The sign at a line's end, what stands before it, what the following line begins with."""
    a, b = line.rstrip(), following.lstrip()
    if not a or not b:
        return None
    sign = a[-1] if a[-1] in HYPHEN_SIGNS else ""
    left, right = re.search(r"(?:[^\W_㐀-鿿]|@)+$", a[:-1] if sign else a), _TOKEN.match(b)
    return (sign, left.group(), right.group()) if left and right else None


def _broken(i: int, j: int, lines: list[str], noise: list[set[str]], goes_on: dict, model: Model) -> None:
    between = [k for k in range(i + 1, j)]
    furniture_between = any(noise[k] for k in between)
    if any(not lines[k].strip() for k in between) and not furniture_between:
        return
    raw = lines[i]
    a = raw.rstrip()
    if not (halves := _halves(raw, lines[j])):
        return
    sign, left, right = halves
    if not left[-1].isalpha() and left[-1] != "@" and not (left[-1].isdigit() and any(c.isalpha() for c in left[:-1]) and left[0].islower()):
        return
    if not (right[0].isalpha() or right[0] == "@"):
        return
    joined = left + right
    if sign:
        if right[0].isupper() and not left.isupper():
            return
        if right[0].isupper() and not model.known(joined):
            return
        both = model.known(left) and model.known(right)
        if sign == "-" and not model.known(joined) and (both or model.correction(left, []) and model.known(right)):
            return
        if sign == "-" and both and model.words.get(joined, 0) < KNOWN:
            return
    elif _HAN.search(raw) and _HAN.search(lines[j]):
        if raw != a or model.known(left) and model.known(right) and not model.known(joined):
            return
    else:
        if raw.rstrip("\r") != a and not model.known(joined):
            return
        if right[0].isupper() and not left.isupper():
            return
        parts = model.stands_alone(left, joined) + model.stands_alone(right, joined)
        if model.known(joined) and parts < 2:
            pass
        elif parts == 0 and left.isalpha() and right.isalpha() and not model.correction(right, []) and not model.correction(left, []) and (model.correction(joined, []) or left[0].isupper()):
            pass
        else:
            return
    noise[i].add("hyphen")
    goes_on[i] = (j, left, right)


def _misread(i: int, lines: list[str], tokens: tuple[list[str], list[str], list[str]], noise: list[set[str]], fixed: list[dict[str, str]], goes_on: dict, tails: dict[int, str], model: Model) -> None:
    line = lines[i]
    before, tokens, after = tokens
    codes = {t for c in _CODE.findall(line) for t in _TOKEN.findall(c)} if _DIGIT.search(line) else ()
    last = len(tokens) - 1
    common = model.common
    for k, w in enumerate(tokens):
        if k == 0 and i in tails:
            continue
        if k == last and i in goes_on:
            around = (before + tokens[:k])[-WINDOW:] + after[1:]
            j, left, right = goes_on[i]
            whole = left + right
            if model.words.get(whole, 0) < OFTEN and (u := model.correction(whole, around)):
                # The line that holds the first glyph that differs.
                at = next((x for x, (p, q) in enumerate(zip(u, whole)) if p != q), len(left))
                noise[i if at < len(left) else j].add("misread")
                fixed[i][whole] = u
            continue
        if w in common or len(w) < 2 or w.isdigit() or w in codes:
            continue
        if not w.isalpha() and _NUMBERLIKE.fullmatch(w):
            if _is_number(w, line, lines[i + 1] if i + 1 < len(lines) else ""):
                noise[i].add("misread")
                fixed[i][w] = w.translate(_NUMBER)
            continue
        if u := model.correction(w, (before + tokens[:k])[-WINDOW:] + (tokens[k + 1 :] + after)[:WINDOW]):
            noise[i].add("misread")
            fixed[i][w] = u


def _is_number(word: str, line: str, following: str) -> bool:
    """True for a number with letters in it that is no code, nor the part of one that a line's end cut off."""
    for m in re.finditer(rf"(?<![^\s“(„«〈\[]){re.escape(word)}(?P<tail>[^\s]*)", line):
        tail = m.group("tail")
        if re.match(r"[/-]", tail) and re.match(r"[A-Z]{1,3}-|[A-Z]\d+/", word + tail):
            continue
        if not tail and line.rstrip().endswith(word) and following.lstrip()[:1] in ("/", "-"):
            continue
        return True
    return bool(re.search(rf"\d[.,/:-]{re.escape(word)}(?![\w/-])", line)) and not re.search(rf"\d\.\d+\.{re.escape(word)}", line)


def repaired(text: str, model: Model) -> str:
    """The text in paragraphs: without furniture, words joined and corrected."""
    r = read(text, model)
    out: list[str] = []
    joined_to: dict[int, str] = {}
    lines = lines_of(text)
    widest = max(map(len, lines), default=0)
    pending = titled = False
    for i, line in enumerate(lines):
        if r.noise[i] & {"header", "page_number"}:
            continue
        line = line.replace("\f", "")
        s = line.strip()
        if not s:
            pending = bool(out) and i - 1 not in r.goes_on
            continue
        if i in joined_to:
            s = s[len(joined_to[i]) :].lstrip() if not s[len(joined_to[i]) :][:1].isspace() else s[len(joined_to[i]) :].strip()
        for w, u in r.fixed[i].items():
            s = re.sub(rf"(?<![^\W_]){re.escape(w)}(?![^\W_])", u, s)
        if i in r.goes_on:
            j, left, right = r.goes_on[i]
            tail = len(s) - s.rindex(left) if left in s else 0
            whole = left + right
            s = (s[: len(s) - tail] if tail else s + " ") + r.fixed[i].get(whole, whole)
            joined_to[j] = right
        if not s:
            continue
        after_end = not out or _CLOSED.search(out[-1]) is not None
        title = after_end and i not in r.goes_on and len(s) < 0.6 * widest and not _CLOSED.search(s) and not s[:1].islower()
        if not out or pending or titled or title or line[:1].isspace() and after_end:
            out.append(s)
        else:
            glue = "" if s[:1] in ",.;:!?)”。，；：！？" or _HAN.match(s) and _HAN.search(out[-1][-1:]) or out[-1][-1:] in "。，；：！？" else " "
            out[-1] += glue + s
        pending, titled = False, title
    return "\n\n".join(out)


def found(documents: DataFrame | None, model: Model) -> DataFrame:
    """doc_id, line_no (from 1), noise of the lines of the pages among ``documents(doc_id, text, scan_type)``; of the model's own corpus if None."""
    rows = model.pages if documents is None else pages_of(documents)
    shared = rows.sparkSession.sparkContext.broadcast(model)  # bounded by VOCABULARY and TEMPLATES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            ids, numbers, kinds = [], [], []
            for doc_id, text, *more in zip(*(c.to_pylist() for c in batch.columns)):
                for k, noise in enumerate(read(text, m.with_more(*more) if more else m).noise):
                    for kind in sorted(noise):
                        ids.append(doc_id)
                        numbers.append(k + 1)
                        kinds.append(kind)
            if ids:
                yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(numbers, pa.int32()), pa.array(kinds, pa.string())], names=["doc_id", "line_no", "noise"])

    if model.rest is not None:
        rows = looked_up(rows, model, shared)
    return rows.select("doc_id", "text", *(c for c in rows.columns if c == "more")).mapInArrow(run, "doc_id long, line_no int, noise string")


def pages_of(documents: DataFrame) -> DataFrame:
    """doc_id and text of the documents whose text is a page's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [bool(t) and is_page(t, label) for t, label in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield batch.select(["doc_id", "text"]).filter(pa.array(kept, pa.bool_()))

    slim = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "scan_type")
    return slim.where(F.length(F.trim("text")) > 0).mapInArrow(run, "doc_id long, text string")


def texts(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id and the repaired text of every document; texts that are no page's lines stay as they are."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            new = [t if not t or t.isspace() or not is_page(t, label) else repaired(t, m.with_more(*more) if more else m) for t, label, *more in zip(*(c.to_pylist() for c in batch.columns[1:]))]
            yield pa.record_batch([batch.column(0), pa.array(new, pa.string())], names=["doc_id", "text"])

    slim = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "scan_type")
    if model.rest is not None:
        slim = looked_up(slim, model, shared)
    return slim.mapInArrow(run, "doc_id long, text string")


def entry_texts(entries: DataFrame) -> DataFrame:
    """doc_id and the text of its page entries as a page shows it: a line each, a blank line where the order has a gap, a form feed between pages.

    Repeated and late entries take their own place once, with the least text
    where they differ; a document bounds the list.
    """
    once = entries.groupBy("doc_id", "page_index", "entry_idx").agg(F.min("text").alias("text")).where("text is not null")
    listed = once.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_index", "entry_idx", "text"))).alias("es"))
    before = lambda i: F.get("es", i - 1)
    sign = lambda e, i: F.when(i == 0, "").when(e["page_index"] != before(i)["page_index"], "\f").when(e["entry_idx"] > before(i)["entry_idx"] + 1, "\n").otherwise("")
    return listed.select("doc_id", F.array_join(F.transform("es", lambda e, i: F.concat(sign(e, i), e["text"])), "\n").alias("text"))
