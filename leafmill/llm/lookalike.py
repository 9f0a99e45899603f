"""One consistent form for texts that look alike.

Nodes are code points and short strings. Two nodes are tied if one is the
other's canonical or width, spacing, font or ligature form, if both are
invisible, a space, or a hyphen, or if they are letters of different scripts
that are drawn alike. Ties are transitive: union-find gives the look-alike
classes. Of each class the member that the corpus uses most becomes the
representative, and Aho-Corasick automata over all other members rewrite a text
from left to right, the longest member first: code points first, then strings
of them. A string is tied place by place: its node is the string of its
characters' representatives, which all of its spellings become in the first
rewriting, however many there are.

Letter case, visible accents, superscripts and subscripts, encircled signs,
fractions, digits, punctuation and line breaks are no ties.

Only nodes over the corpus alphabet are built. The alphabet is counted over
all texts, one row per code point and task; it is bounded by Unicode itself,
and so is the table of classes that goes to the executors.

Defined results: a null text stays null; an empty text stays empty; texts
without a visible character have no key and are never in a pair; repeated
rows are equal as stored and so no pair; other columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
import unicodedata
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Letters of Cyrillic and Greek that are drawn like Latin ones.
DRAWN_ALIKE = {
    "A": "АΑ", "B": "ВΒ", "C": "СϹ", "E": "ЕΕ", "H": "НΗ", "I": "ІΙӀ", "J": "ЈͿ", "K": "КΚ", "M": "МΜ",
    "N": "Ν", "O": "ОΟ", "P": "РΡ", "Q": "Ԛ", "S": "Ѕ", "T": "ТΤ", "W": "Ԝ", "X": "ХΧ", "Y": "ҮΥ", "Z": "Ζ",
    "a": "а", "c": "сϲ", "d": "ԁ", "e": "е", "h": "һ", "i": "і", "j": "јϳ", "o": "оο", "p": "р", "q": "ԛ",
    "s": "ѕ", "v": "ν", "w": "ԝ", "x": "х", "y": "у",
}
# Hyphens that are no dash.
HYPHENS = "-‐‑‒−﹣－"
# Invisible marks outside the format category.
INVISIBLE = "͏ᅟᅠ឴឵᠋᠌᠍ㅤﾠ"
# Decompositions that keep the look; <super>, <sub>, <circle> and <fraction> change it.
SAME_LOOK = {"<wide>", "<narrow>", "<small>", "<compat>", "<font>", "<noBreak>", "<square>", "<vertical>", "<initial>", "<medial>", "<final>", "<isolated>"}
#: Rows of one look that a task pairs with all rows of that look.
SIDE = 256


def invisible(ch: str) -> bool:
    return unicodedata.category(ch) == "Cf" or "︀" <= ch <= "️" or "\U000e0100" <= ch <= "\U000e01ef" or ch in INVISIBLE


def plain_form(ch: str) -> str | None:
    """The string of which ``ch`` is a form of the same look, fully decomposed; None if it is no such form."""
    found = unicodedata.decomposition(ch).split()
    if not found:
        if 0xAC00 <= ord(ch) <= 0xD7A3:
            return unicodedata.normalize("NFD", ch)
        return None
    if found[0].startswith("<"):
        if found[0] not in SAME_LOOK:
            return None
        found = found[1:]
        if found[0] == "0020" and len(found) > 1:  # a spacing accent
            return None
    parts = [chr(int(x, 16)) for x in found]
    return "".join(plain_form(p) or p for p in parts)


class Classes:
    """Union-find over strings."""

    def __init__(self) -> None:
        self.parent: dict[str, str] = {}

    def find(self, x: str) -> str:
        self.parent.setdefault(x, x)
        root = x
        while self.parent[root] != root:
            root = self.parent[root]
        while self.parent[x] != root:
            self.parent[x], x = root, self.parent[x]
        return root

    def tie(self, x: str, y: str) -> None:
        a, b = self.find(x), self.find(y)
        if a != b:
            self.parent[b] = a

    def members(self) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for x in self.parent:
            out.setdefault(self.find(x), []).append(x)
        return out


@functools.cache
def _composed() -> list[tuple[str, str]]:
    """Every character that is composed of others, but for Hangul, with its parts."""
    points = map(chr, itertools.chain(range(0xC0, 0xAC00), range(0xD7A4, 0xD800), range(0xF900, 0x10000), range(0x11000, 0x1E000), range(0x2F800, 0x2FA20)))
    return [(ch, form) for ch in points if len(form := unicodedata.normalize("NFD", ch)) > 1]


def _composable(alphabet: str) -> list[str]:
    """Characters outside an alphabet that composition can make of its characters."""
    own, parts = set(alphabet), set(unicodedata.normalize("NFD", alphabet))
    return [ch for ch, form in _composed() if ch not in own and parts.issuperset(form)]


def look_alike_classes(counts: dict[str, int]) -> dict[str, str]:
    """member -> representative, for all members that aren't their class's representative, given the corpus alphabet with counts."""
    drawn = {x: latin for latin, others in DRAWN_ALIKE.items() for x in others}
    classes, strings = Classes(), {}
    for ch in [*counts, *_composable("".join(counts))]:
        if invisible(ch):
            classes.tie("", ch)
            continue
        if unicodedata.category(ch) == "Zs":
            classes.tie(" ", ch)
            continue
        if ch in HYPHENS:
            classes.tie("-", ch)
            continue
        if ch in drawn:
            classes.tie(drawn[ch], ch)
        if form := plain_form(ch):
            if len(form) > 1:
                strings[ch] = form
            else:
                classes.tie(form, ch)
                if form in drawn:
                    classes.tie(drawn[form], form)
    for parts in set("".join(strings.values())):
        if parts in drawn:
            classes.tie(drawn[parts], parts)
    # A string's node is spelled in representatives, place by place, so that ties of strings are transitive too.
    weight = lambda s: counts.get(s, 0) if len(s) == 1 else min((counts.get(x, 0) for x in s), default=1 << 62)
    rank = lambda m: (weight(m), -len(m), [-ord(x) for x in m])
    single = {m: max(ms, key=rank) for ms in classes.members().values() for m in ms}
    for ch, form in strings.items():
        spelled = "".join(single.get(x, x) for x in form)
        classes.tie(ch, spelled)
        if len(composed := unicodedata.normalize("NFC", spelled)) == 1:
            classes.tie(ch, composed)
    chosen: dict[str, str] = {}
    for ms in classes.members().values():
        best = max(ms, key=rank)
        chosen.update({m: best for m in ms if m != best})
    # A representative must consist of representatives itself.
    settle = {m: _settled(r, chosen) for m, r in chosen.items()}
    return {m: r for m, r in settle.items() if m != r}


def _settled(text: str, chosen: dict[str, str]) -> str:
    """The text in representatives of representatives; a circle, which no text of one class gives, ends where it begins."""
    seen = set()
    while text not in seen:
        seen.add(text)
        text = chosen.get(text) if text in chosen else "".join(chosen.get(x, x) for x in text)
    return text


class Rewriter:
    """Greedy rewriting by all members of a table of classes: code points, then strings in the form that this gives them."""

    def __init__(self, table: tuple[tuple[str, str], ...]):
        self.steps = [self._step([(m, r) for m, r in table if (len(m) == 1) == single]) for single in (True, False)]

    @staticmethod
    def _step(table: list[tuple[str, str]]) -> tuple:
        automaton = ahocorasick.Automaton()
        for member, best in table:
            automaton.add_word(member, (len(member), best))
        automaton.make_automaton()
        ends = sorted({m[-1] for m, _ in table})
        return automaton, regex.compile("[" + "".join(map(regex.escape, ends)) + "]").search if ends else lambda text: None

    def __call__(self, text: str) -> str:
        if text.isascii() and self.steps[0][1](text) is None and self.steps[1][1](text) is None:
            return text
        # Marks on one letter in another order look the same.
        text = unicodedata.normalize("NFC", text)
        for automaton, may_match in self.steps:
            if may_match(text) is not None:
                out, at = [], 0
                for last, (length, best) in automaton.iter_long(text):
                    out.append(text[at : last + 1 - length])
                    out.append(best)
                    at = last + 1
                if out:
                    out.append(text[at:])
                    text = "".join(out)
        return text if text.isascii() else unicodedata.normalize("NFC", text)


@functools.lru_cache(maxsize=4)
def rewriter(table: tuple[tuple[str, str], ...]) -> Rewriter:
    return Rewriter(table)


def alphabet(*columns: DataFrame) -> dict[str, int]:
    """Every character of one-column text tables with its count, over all rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0x110000, np.int64)
        for batch in batches:
            text = "".join(x for x in batch.column(0).to_pylist() if x)
            total += np.bincount(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), minlength=0x110000)
        points = np.flatnonzero(total)
        yield pa.record_batch([pa.array(points.astype(np.int32)), pa.array(total[points])], names=["point", "n"])

    parts = [c.mapInArrow(count, "point int, n long") for c in columns]
    rows = functools.reduce(DataFrame.unionByName, parts).groupBy("point").agg(F.sum("n").alias("n")).collect()
    return {chr(r.point): r.n for r in rows}


def class_table(*columns: DataFrame) -> tuple[tuple[str, str], ...]:
    """The look-alike classes of a corpus: (member, representative), sorted."""
    return tuple(sorted((m, r) for m, r in look_alike_classes(alphabet(*columns)).items() if m))


def normalise(texts: DataFrame, table: Iterable[tuple[str, str]], keys: list[str], text: str = "text") -> DataFrame:
    """``keys`` and the consistent form of column ``text``."""
    table = tuple(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rewrite = rewriter(table)
        for batch in batches:
            new = [None if x is None else rewrite(x) for x in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.record_batch([*batch.columns[:-1], pa.array(new, pa.string())], names=[*keys, "text"])

    slim = texts.select(*keys, F.col(text).cast("string").alias("text"))
    return slim.mapInArrow(run, slim.schema)


def fingerprints(documents: DataFrame, table: Iterable[tuple[str, str]]) -> DataFrame:
    """doc_id, look and stored: 128-bit hashes of a text's consistent form and of the text as stored; texts with a visible character only."""
    table = tuple(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rewrite, digest = rewriter(table), xxhash.xxh3_128_digest
        for batch in batches:
            ids, looks, stored = [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                form = rewrite(text)
                if not form or form.isspace():
                    continue
                ids.append(doc_id)
                looks.append(digest(form))
                stored.append(digest(text))
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(looks, pa.binary()), pa.array(stored, pa.binary())], names=["doc_id", "look", "stored"])

    slim = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.length("text") > 0)
    return slim.mapInArrow(run, "doc_id long, look binary, stored binary")


def classes(prints: DataFrame) -> DataFrame:
    """doc_id, class_id (the smallest doc_id that looks the same) and n_spellings, for documents that look like a differently stored one.

    Aggregated on the look before anything is joined, so a text copied into a
    third of all rows costs one partial row per task.
    """
    groups = (
        prints.groupBy("look", "stored").agg(F.min("doc_id").alias("doc_id"))
        .groupBy("look").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("n_spellings"))
        .where("n_spellings > 1")
    )
    return prints.join(groups, "look").select("doc_id", "class_id", "n_spellings")


def pairs(prints: DataFrame) -> DataFrame:
    """doc_id_a < doc_id_b of documents stored differently that look the same.

    Looks with one spelling only are dropped by an aggregation first. What is
    left is joined on the look and a salt: one side of a look of n rows is
    spread over n / SIDE salts, the other comes once for each, so no task makes
    more than SIDE times n pairs of a look. The result has every pair, which a
    look of n rows and several spellings has about n * n of; ``classes`` says
    the same in n rows.
    """
    several = prints.groupBy("look").agg(F.min("stored").alias("lo"), F.max("stored").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo <> hi")
    kept = prints.join(several.select("look", (F.col("n") / SIDE).cast("int").alias("last")), "look")
    a = kept.select("look", F.pmod(F.xxhash64("doc_id"), F.col("last") + 1).cast("int").alias("salt"), F.col("doc_id").alias("doc_id_a"), F.col("stored").alias("stored_a"))
    b = kept.select("look", F.explode(F.sequence(F.lit(0), "last")).alias("salt"), F.col("doc_id").alias("doc_id_b"), F.col("stored").alias("stored_b"))
    return a.join(b, ["look", "salt"]).where("doc_id_a < doc_id_b and stored_a <> stored_b").select("doc_id_a", "doc_id_b").distinct()
