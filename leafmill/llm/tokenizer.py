"""Encoding with a public byte-level BPE vocabulary by backtracking over longest matches.

The vocabulary's ids are its merge ranks. Every token above the single bytes
comes from one merge, found once per vocabulary (``splits``). Two adjacent
tokens are compatible if encoding their bytes together gives the same two
tokens again; the answer follows from walking both tokens' splits and is kept
in a table. A text's encoding is the one sequence whose adjacent tokens are
all compatible. The encoder takes the longest token at a position (all matches
of a piece come from one Aho-Corasick pass), falls back to the token's longest
proper prefix when it isn't compatible with the one before, and drops the
token before when none is; positions that failed are never tried again, so the
work is linear in the piece.

Pieces are those of the vocabulary's split pattern. A worker keeps the
encodings of up to ``CACHE`` pieces, and begins a new cache when it is full.

Defined results: null and empty texts give an empty list; blank texts are
encoded as they are; nothing is normalised.
"""

from __future__ import annotations

import base64
import functools
import importlib
from array import array
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Pieces of the split pattern whose encodings a worker keeps.
CACHE = 400_000
#: Longest piece that is kept; longer ones hardly come twice.
CACHED_LENGTH = 64
DEFAULT_FILE = "byte_bpe_50k.tiktoken"


def vocabulary_path(name: str = DEFAULT_FILE, package: str = "public_tokenizers") -> str:
    return importlib.import_module(package).path(name)


def split_pattern(package: str = "public_tokenizers") -> str:
    return importlib.import_module(package).PATTERN


class Encoder:
    """Encoder and decoder of one vocabulary file of lines ``base64 rank``."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        ranked = sorted((int(rank), base64.b64decode(token)) for token, rank in pairs)
        if [r for r, _ in ranked] != list(range(len(ranked))):
            raise ValueError("ranks must be 0, 1, 2, …")
        self.tokens: list[bytes] = [t for _, t in ranked]
        self.id_of: dict[bytes, int] = {t: i for i, t in enumerate(self.tokens)}
        self.pieces = regex.compile(pattern).findall
        self._known: dict[str, tuple[int, ...]] = {}
        self._compatible: dict[int, bool] = {}
        # Decoding: all tokens' bytes in one blob and where each begins.
        self.blob = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.offsets = np.concatenate(([0], np.cumsum([len(t) for t in self.tokens]))).astype(np.int64)
        self.size = len(self.tokens)
        self._learn_splits()
        self._matcher = ahocorasick.Automaton()
        for i, t in enumerate(self.tokens):
            self._matcher.add_word(t.decode("latin-1"), (len(t), i))
        self._matcher.make_automaton()
        self.shorter = [self._longest_proper_prefix(t) for t in self.tokens]

    def _learn_splits(self) -> None:
        """Each token's last merge: what merging its bytes with only the earlier ranks leaves."""
        self.left, self.right = list(range(self.size)), list(range(self.size))
        self.merge_of: dict[int, int] = {}
        for i, token in enumerate(self.tokens):
            if len(token) == 1:
                continue
            parts = [self.id_of[token[k : k + 1]] for k in range(len(token))]
            while len(parts) > 2:
                ranks = [self.merge_of.get(a * self.size + b, i) for a, b in zip(parts, parts[1:])]
                best = min(ranks)
                if best >= i:
                    raise ValueError(f"token {i} can't be reached by merges")
                k = ranks.index(best)
                parts[k : k + 2] = [best]
            self.left[i], self.right[i] = parts
            self.merge_of[parts[0] * self.size + parts[1]] = i

    def _longest_proper_prefix(self, token: bytes) -> int:
        for n in range(len(token) - 1, 0, -1):
            if (found := self.id_of.get(token[:n])) is not None:
                return found
        return -1

    def compatible(self, first: int, second: int) -> bool:
        """True if no merge across the border comes before the merges that made the two tokens."""
        key = first * self.size + second
        known = self._compatible.get(key)
        if known is not None:
            return known
        a, b, bound, fits = first, second, self.size + 1, True
        while True:
            joined = self.merge_of.get(a * self.size + b)
            if joined is not None and joined < bound:
                fits = False
                break
            # Undo the later of the two merges: on a tie the right token's, as merging goes from the left.
            if a > b:
                undone_left, bound = True, a
                if self.left[a] == a:
                    undone_left, bound = False, b + 1
            else:
                undone_left, bound = False, b + 1
                if self.left[b] == b:
                    undone_left, bound = True, a
            if undone_left:
                if self.left[a] == a:
                    break
                a = self.right[a]
            else:
                if self.left[b] == b:
                    break
                b = self.left[b]
        if len(self._compatible) > 4_000_000:
            self._compatible.clear()
        self._compatible[key] = fits
        return fits

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        raw = piece.encode()
        whole = self.id_of.get(raw)
        if whole is not None:
            return (whole,)
        end = len(raw)
        longest = [-1] * end
        for last, (length, token) in self._matcher.iter(raw.decode("latin-1")):
            start = last + 1 - length
            have = longest[start]
            if have < 0 or len(self.tokens[have]) < length:
                longest[start] = token
        open_at = bytearray(b"\x01") * (end + 1)
        taken: list[int] = []
        at, token = 0, longest[0]
        while True:
            before = taken[-1] if taken else -1
            while token >= 0:
                after = at + len(self.tokens[token])
                if open_at[after] and (before < 0 or self.compatible(before, token)):
                    break
                token = self.shorter[token]
            if token >= 0:
                taken.append(token)
                at = after
                if at == end:
                    return tuple(taken)
                token = longest[at]
            else:
                open_at[at] = 0
                token = taken.pop()
                at -= len(self.tokens[token])
                token = self.shorter[token]

    def encode(self, text: str | None) -> array:
        """Ids of a text."""
        out = array("i")
        known, extend = self._known, out.extend
        for piece in self.pieces(text) if text else ():
            ids = known.get(piece)
            if ids is None:
                ids = self._remember(piece)
            extend(ids)
        return out

    def _remember(self, piece: str) -> tuple[int, ...]:
        ids = self.encode_piece(piece)
        if len(piece) <= CACHED_LENGTH:
            if len(self._known) >= CACHE:
                self._known.clear()
            self._known[piece] = ids
        return ids

    def count(self, text: str | None) -> int:
        known, total = self._known, 0
        for piece in self.pieces(text) if text else ():
            ids = known.get(piece)
            total += len(self._remember(piece) if ids is None else ids)
        return total

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        """The bytes of some ids, gathered by the offset table."""
        ids = np.asarray(ids, np.int64)
        if not len(ids):
            return b""
        starts, lengths = self.offsets[ids], self.offsets[ids + 1] - self.offsets[ids]
        before = np.cumsum(lengths) - lengths
        return self.blob[np.arange(lengths.sum()) + np.repeat(starts - before, lengths)].tobytes()

    def token_lengths(self, ids: Iterable[int]) -> np.ndarray:
        ids = np.asarray(ids, np.int64)
        return self.offsets[ids + 1] - self.offsets[ids]


@functools.lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    """One encoder per worker process and vocabulary."""
    return Encoder(path, pattern)


def encode(documents: DataFrame, path: str | None = None, pattern: str | None = None, ids: bool = True) -> DataFrame:
    """doc_id and ``ids`` (array of int) or, without ``ids``, ``n_tokens`` of every ``documents(doc_id, text)``; one narrow pass."""
    path, pattern = path or vocabulary_path(), pattern or split_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for batch in batches:
            names, texts = batch.column(0), batch.column(1)
            if not ids:
                yield pa.record_batch([names, pa.array([enc.count(t.as_py()) for t in texts], pa.int32())], names=["doc_id", "n_tokens"])
                continue
            flat, ends = array("i"), array("i", [0])
            for t in texts:
                flat.extend(enc.encode(t.as_py()))
                ends.append(len(flat))
            lists = pa.ListArray.from_arrays(pa.array(np.frombuffer(ends, np.int32)), pa.array(np.frombuffer(flat, np.int32) if flat else np.empty(0, np.int32)))
            yield pa.record_batch([names, lists], names=["doc_id", "ids"])

    kind = T.StructField("ids", T.ArrayType(T.IntegerType())) if ids else T.StructField("n_tokens", T.IntegerType())
    slim = documents.select("doc_id", F.col("text").cast("string"))
    return slim.mapInArrow(run, T.StructType([slim.schema["doc_id"], kind]))


def decode(encoded: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id and text of ``encoded(doc_id, ids)``; a null list gives a null text."""
    path, pattern = path or vocabulary_path(), pattern or split_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for batch in batches:
            texts = [None if v is None else enc.decode_bytes(v).decode("utf-8", "replace") for v in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    slim = encoded.select("doc_id", "ids")
    return slim.mapInArrow(run, T.StructType([slim.schema["doc_id"], T.StructField("text", T.StringType())]))
