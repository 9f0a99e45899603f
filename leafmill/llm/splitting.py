"""Cutting texts above a size limit into overlapping pieces at natural boundaries, by recursive bisection.

Sizes are tokens of a public tokenizer. Every place between two tokens has a
strength: the end of a paragraph, a line, a sentence, a clause, a word, or
none of these; a place within a character is no place. A range above the
limit less the overlap is cut at the strongest place in the middle part of
it, the nearest to the midpoint among equals, and so are its halves. Then
each piece but the first gets the overlap's tokens before its start.

Defined results: texts within a limit, null and blank ones give no pieces;
pieces are numbered from 1; the pieces without their overlaps give the text
again, character for character; a text without natural boundaries is cut
between characters; where no place's overlap begins at a character's start,
the overlap is a little longer. ``n_tokens`` is the number of tokens of the
piece encoded on its own, ``first_token`` to ``last_token`` are its tokens
within the text; both numbers are within the limit, and where nothing is left
to cut so that they are, ``fits`` is false. Equal texts give equal pieces. A
limit that isn't larger than its overlap is refused.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.packing import all_limits
from leafmill.llm.tokenizer import Encoder, encoder, split_pattern, vocabulary_path

#: The middle part of a range in which a cut is looked for.
MIDDLE = 0.5
PARAGRAPH, LINE, SENTENCE, CLAUSE, WORD, CHARACTER, NONE = 6, 5, 4, 3, 2, 1, 0
# Signs that end sentences and clauses, and signs that may close them.
SENTENCE_ENDS, CLAUSE_ENDS, CLOSERS = ".!?…。！？", ",;:，；：、", "\"'”’»)）]】"
SCHEMA = "limit_id int, doc_id long, piece_no int, first_token int, last_token int, n_tokens int, fits boolean, text string"


# What a character is, a bit each: for every code point one byte.
END, CLAUSE_END, CLOSER, SPACE, HAN, WIDE = 1, 2, 4, 8, 16, 32
_IS = np.zeros(0x110000, np.uint8)
for _bit, _signs in ((END, SENTENCE_ENDS), (CLAUSE_END, CLAUSE_ENDS), (CLOSER, CLOSERS), (SPACE, " \t\n\x0b\x0c\r\xa0\u3000")):
    _IS[[ord(c) for c in _signs]] |= _bit
_IS[0x3400:0xA000] |= HAN
_IS[0x3000:] |= WIDE


def strengths(text: str, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Strength of the place before each token, and the character where each token begins (-1 within a character); ``ends`` are the tokens' ends in bytes."""
    raw = np.frombuffer(text.encode(), np.uint8)
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    lead = (raw & 0xC0) != 0x80
    char_at = np.cumsum(lead) - 1
    starts = np.concatenate(([0], ends[:-1]))
    whole = lead[starts]
    char = np.where(whole, char_at[starts], -1)
    c = np.maximum(char, 1)
    before, after = points[c - 1], points[np.minimum(c, len(points) - 1)]
    second = points[np.maximum(c - 2, 0)]
    kind_before, kind_after, kind_second = _IS[before], _IS[after], _IS[second]
    word = ((kind_before | kind_after) & (SPACE | HAN)) > 0
    said = np.where(kind_before & (CLOSER | SPACE), kind_second, kind_before)
    strength = np.full(len(starts), CHARACTER, np.int8)
    strength[word] = WORD
    strength[((said & CLAUSE_END) > 0) & word] = CLAUSE
    strength[((said & END) > 0) & (((kind_before | kind_after) & SPACE | said & WIDE) > 0)] = SENTENCE
    line = (before == 10) & (after != 10)
    strength[line] = LINE
    strength[line & (second == 10)] = PARAGRAPH
    # A place before the blank lines of a paragraph's end is as good as one after them.
    strength[(after == 10) & (before != 10) & (points[np.minimum(c + 1, len(points) - 1)] == 10)] = PARAGRAPH
    strength[~whole] = NONE
    strength[0] = NONE
    return strength, char


def cuts(strength: np.ndarray, limit: int, overlap: int) -> list[int]:
    """Where pieces begin: 0 and the cuts, rising."""
    total, most = len(strength), limit - overlap
    usable = strength.astype(np.int32).copy()
    if overlap:
        # The overlap must begin at a character's start, too.
        begin = np.arange(total) - overlap
        usable[(begin > 0) & (strength[np.maximum(begin, 0)] == NONE)] = NONE
    out, todo = [0], [(0, total)]
    while todo:
        a, b = todo.pop()
        if b - a <= (limit if a == 0 and b == total else most):
            continue
        middle, half = (a + b) // 2, max(1, int((b - a) * MIDDLE / 2))
        low, high = max(a + 1, middle - half), min(b, middle + half + 1)
        values, base = usable[low:high], low
        for wider in (usable, strength):
            if values.max(initial=0) == NONE:
                values, base = wider[a + 1 : b], a + 1
        if values.max(initial=0) == NONE:
            continue  # one character
        places = np.flatnonzero(values == values.max()) + base
        at = int(places[np.abs(places - middle).argmin()])
        out.append(at)
        todo += [(a, at), (at, b)]
    return sorted(out)


def pieces(enc: Encoder, text: str, ids: np.ndarray, limit: int, overlap: int, places: tuple[np.ndarray, np.ndarray] | None = None) -> list[tuple[int, int, int, bool, str]]:
    """(first token, token after the last, tokens on its own, whether it fits, text) of each piece, overlap included; ``places`` are the text's ``strengths``, if they are known."""
    strength, char = places or strengths(text, np.cumsum(enc.token_lengths(ids)))
    begins = cuts(strength, limit, overlap)
    out = []
    for k, a in enumerate(begins):
        b = begins[k + 1] if k + 1 < len(begins) else len(ids)
        out += _with_overlap(enc, text, strength, char, a, b, limit, overlap)
    return out


def _parts_words(text: str, at: int) -> bool:
    """True if the place is the end of a text or lies between a visible character and a blank.

    No piece of the split pattern goes on from a visible character into a
    blank, and none looks back, so the tokens on both sides are the same
    whether or not the text is cut there.
    """
    return at in (0, len(text)) or not text[at - 1].isspace() and text[at].isspace()


def _with_overlap(enc: Encoder, text: str, strength: np.ndarray, char: np.ndarray, a: int, b: int, limit: int, overlap: int) -> list[tuple[int, int, int, bool, str]]:
    first = max(0, a - overlap) if a else 0
    while first > 0 and char[first] < 0:
        first -= 1
    start, end = char[first], char[b] if b < len(char) else len(text)
    piece = text[start:end]
    # Encoded on its own a piece can have another number of tokens than within its text, unless both ends part words.
    size = b - first if _parts_words(text, start) and _parts_words(text, end) else enc.count(piece)
    fits = max(size, b - first) <= limit
    if not fits and b - a > 1:
        inner = np.where(char[a + 1 : b] >= 0, strength[a + 1 : b], -1)
        places = np.flatnonzero(inner == inner.max()) + a + 1
        if inner.max() >= 0:
            at = int(places[np.abs(places - (a + b) // 2).argmin()])
            return _with_overlap(enc, text, strength, char, a, at, limit, overlap) + _with_overlap(enc, text, strength, char, at, b, limit, overlap)
    return [(first, b, size, fits, piece)]


def split(documents: DataFrame, limits: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Pieces of every ``documents(doc_id, text)`` above a limit of ``limits(limit_id, max_tokens, overlap_tokens)``; one narrow pass for all limits."""
    path, pattern = path or vocabulary_path(), pattern or split_pattern()
    table = [(int(r.limit_id), int(r.max_tokens), int(r.overlap_tokens or 0)) for r in all_limits(limits) if r.max_tokens]
    if any(limit <= overlap for _, limit, overlap in table):
        raise ValueError("a limit must be larger than its overlap")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        rows: list[tuple] = []
        volume = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                ids = np.frombuffer(enc.encode(text), np.int32)
                above = [row for row in table if len(ids) > row[1]]
                places = strengths(text, np.cumsum(enc.token_lengths(ids))) if above else None
                for limit_id, limit, overlap in above:
                    for k, (a, b, n, fits, piece) in enumerate(pieces(enc, text, ids, limit, overlap, places)):
                        rows.append((limit_id, doc_id, k + 1, a, b - 1, n, fits, piece))
                        volume += len(piece)
                if volume > 4_000_000:
                    yield _batch(rows)
                    rows, volume = [], 0
        if rows:
            yield _batch(rows)

    slim = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.length("text") > 0)
    return slim.mapInArrow(run, SCHEMA)


@functools.cache
def _schema() -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    return pa.schema([(name, kinds[kind]) for name, kind in (part.split() for part in SCHEMA.split(", "))])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), _schema())], schema=_schema())
