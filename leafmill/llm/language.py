"""Language of documents, translations and single-language segments, by error-correcting output codes.

Each language has a codeword; each bit of it is one question, "is the text in
one of these languages?", answered by a binary classifier over character
n-grams of words. A sentence's bits are decoded to the codeword of least loss,
each bit's loss weighted by how well its classifier did in training. The
share of the best codeword among all is the confidence; a sentence whose best
two codewords are too close is ambiguous and takes the language around it. A
text of which no sentence is clear is decoded as a whole and flagged ambiguous.

Each bit's classifier begins as the log-odds of its n-grams and is corrected
row by row where its vote is wrong or narrow (a perceptron with a margin).

The classifiers are fitted on a bounded sample of labelled rows (``SAMPLE``);
as labels may be wrong, rows that the first fit contradicts are left out of
the second. Sampled texts are read whole. All else reads every row and whole texts, in one
narrow pass.

Defined results: every document and translation has a row; null, empty or blank
texts and texts without a word have language ``und`` and confidence 0; texts
without a whole clear sentence are flagged ambiguous, and never contradict
their label; a translation has one row, by its largest share; of repeated rows (translations arrive several
times) one result row comes out; labels in another notation or with a region
count as the language they name; ``mul`` names no single language and fits a
text of several; extra columns are ignored.
"""

from __future__ import annotations

import dataclasses
import functools
import itertools
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.sampling import bounded_sample

#: Labelled rows that the classifiers are fitted on.
SAMPLE = 4000
BITS, BUCKETS, LONGEST = 15, 1 << 16, 4
#: Words whose scores a worker keeps.
CACHE = 300_000
#: Texts decoded together.
AT_ONCE = 256

# Notations of each language, lower case, without region or script.
NOTATIONS = {
    "en": "en eng english anglais englisch inglês inglés",
    "pt": "pt por portuguese português portugues",
    "es": "es spa spanish español espanol castellano",
    "fr": "fr fre fra french français francais",
    "de": "de ger deu german deutsch",
    "zh": "zh chi zho chinese cmn mandarin 中文 汉语",
    "ru": "ru rus russian русский",
}
LANGUAGES = tuple(NOTATIONS)
# Labels that say nothing.
SILENT = "und unknown n/a na none null ?? ? - xx zxx mis unk undefined"
MULTIPLE = "mul"
_LABEL = {x: lang for lang, names in NOTATIONS.items() for x in names.split()}

_WORDS = re.compile(r"[㐀-鿿]|[^\W\d_㐀-鿿]+(?:['’][^\W\d_㐀-鿿]+)*").findall
#: Quoted phrases (of one sentence at most), markup and addresses say nothing of the language.
_ASIDE = re.compile(r"“(?:[^”.!?…。！？\n]|\n(?!\s*\n)|[.!?…](?!\s))*[.!?…。！？]?\s*”|«(?:[^».!?…。！？\n]|\n(?!\s*\n)|[.!?…](?!\s))*[.!?…。！？]?\s*»|<[^<>\n]+>|\{\{[^{}]*\}\}|\$[^$\n]+\$|\\[a-zA-Z]+|&\w+;|https?://\S+|\[\[(?:[^\[\]|\n]*\|)?")
_MAYBE_ASIDE = re.compile(r"[“«<{$\\&\[]|https?:").search
_LATIN, _CYRILLIC = re.compile(r"[A-Za-zÀ-ɏ]").search, re.compile(r"[Ѐ-ԯ]").search
_WIDE = re.compile(r"[！-￮]").search
_END = re.compile(r"[.!?…][)\"”’\]*_]*\s+|[。！？]\s*|\n[ \t]*\n\s*|\f")
_WHOLE = ".!?…。！？"


def label_column(label: Column) -> Column:
    """The language that a label names; ``mul`` for several; empty for a label that says nothing; the label itself if it is none known."""
    low = F.lower(F.trim(F.coalesce(label, F.lit(""))))
    base = F.element_at(F.split(low, "[-_]"), 1)
    table = F.create_map(*itertools.chain.from_iterable((F.lit(k), F.lit(v)) for k, v in _LABEL.items()))
    return (
        F.when((low == "") | low.isin(SILENT.split()), F.lit(""))
        .otherwise(F.coalesce(F.try_element_at(table, low), F.try_element_at(table, base), low))
    )


def codewords(languages: int = len(LANGUAGES), bits: int = BITS) -> np.ndarray:
    """One row of +1/-1 for each language: dichotomies taken one by one, then exchanged while that moves near rows apart."""
    every = np.array([[1 if (mask >> k) & 1 else -1 for k in range(languages)] for mask in range(1, 1 << (languages - 1))])
    apart = (every[:, :, None] != every[:, None, :])[:, *np.triu_indices(languages, 1)].astype(float)

    def nearness(gap: np.ndarray) -> float:
        return float((0.5**gap).sum())

    chosen: list[int] = []
    gap = np.zeros(apart.shape[1])
    for _ in range(bits):
        best = min((k for k in range(len(every)) if k not in chosen), key=lambda k: nearness(gap + apart[k]))
        chosen.append(best)
        gap = gap + apart[best]
    changed = True
    while changed:
        changed = False
        for i, old in enumerate(chosen):
            rest = gap - apart[old]
            new = min((k for k in range(len(every)) if k not in chosen or k == old), key=lambda k: nearness(rest + apart[k]))
            if nearness(rest + apart[new]) < nearness(gap) - 1e-12:
                chosen[i], gap, changed = new, rest + apart[new], True
    return every[chosen].T.astype(np.float32)


CODE = codewords()


@functools.lru_cache(maxsize=CACHE)
def _grams(word: str) -> np.ndarray:
    """Buckets of a word's n-grams of 1 to LONGEST characters, with its borders."""
    word = f"<{word.lower()}>"
    digest = xxhash.xxh3_64_intdigest
    return np.array([digest(word[i : i + n]) % BUCKETS for n in range(1, LONGEST + 1) for i in range(len(word) - n + 1)], np.int32)


def words_of(sentence: str) -> list[str]:
    """The words of a sentence, but for those that mix Latin and Cyrillic letters: look-alikes, which say nothing of the language."""
    words = _WORDS(sentence)
    if _CYRILLIC(sentence) and _LATIN(sentence):
        return [w for w in words if not (_CYRILLIC(w) and _LATIN(w))]
    return words


def sentences(text: str) -> list[tuple[str, bool]]:
    """A text's sentences in order, and whether each is whole, that is ends in a closing sign; a paragraph's end parts them too."""
    if _WIDE(text):
        text = unicodedata.normalize("NFKC", text).replace(",", ", ")
    if _MAYBE_ASIDE(text):
        text = _ASIDE.sub(" ", text)
    out, at = [], 0
    for m in _END.finditer(text):
        out.append((text[at : m.start()], text[m.start()] in _WHOLE))
        at = m.end()
    rest = text[at:].rstrip(" \t\r\n\f)\"”’]*_")
    if rest:
        out.append((rest, rest[-1] in _WHOLE))
    return out


@dataclasses.dataclass
class Model:
    """Weights of the binary classifiers by n-gram bucket, and each bit's weight in decoding."""

    weights: np.ndarray
    bit_weight: np.ndarray

    def __post_init__(self) -> None:
        self._rows: dict[str, int] = {}
        self._table = np.zeros((1024, BITS + 1), np.float32)

    def __getstate__(self) -> dict:
        return {"weights": self.weights, "bit_weight": self.bit_weight}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.__post_init__()

    def _row(self, word: str) -> int:
        if len(self._rows) >= CACHE:
            self._rows.clear()
        k = len(self._rows)
        if k >= len(self._table):
            self._table = np.concatenate([self._table, np.zeros_like(self._table)])
        grams = _grams(word)
        self._table[k, :BITS] = self.weights[grams].sum(0)
        self._table[k, BITS] = len(grams)
        self._rows[word] = k
        return k

    def margins(self, sents: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """For each list of words: every bit's mean vote of its n-grams, and the number of n-grams."""
        rows, ends, known = [], [0], self._rows
        total = sum(map(len, sents))
        if len(known) + total > CACHE:
            known.clear()
        for words in sents:
            for w in words:
                r = known.get(w)
                rows.append(self._row(w) if r is None else r)
            ends.append(len(rows))
        sums = np.zeros((len(sents), BITS + 1), np.float32)
        some = np.flatnonzero(np.diff(ends))
        if len(some):
            sums[some] = np.add.reduceat(self._table[np.array(rows)], np.array(ends)[some], axis=0)
        n = sums[:, BITS]
        return sums[:, :BITS] / np.maximum(n, 1)[:, None], n

    def decode(self, sents: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest codeword and the confidence for each list of words; -1 and 0 without words."""
        if not sents:
            return np.zeros(0, int), np.zeros(0)
        votes, n = self.margins(sents)
        strength = votes * np.minimum(n, 60)[:, None] ** 0.5 * 2
        loss = np.stack([(np.logaddexp(0, -strength * row) * self.bit_weight).sum(1) for row in CODE], 1)
        odds = np.exp(-(loss - loss.min(1, keepdims=True)))
        share = odds.max(1) / odds.sum(1)
        best = loss.argmin(1)
        return np.where(n > 0, best, -1), np.where(n > 0, share, 0.0)


#: The vote below which a row corrects a bit, the size of a correction, and how often the rows are gone through.
MARGIN, RATE, ROUNDS = 0.1, 0.1, 2


def corrected(weights: np.ndarray, rows: list[tuple[np.ndarray, int]]) -> np.ndarray:
    """Weights after every row of (buckets, language index) moved the bits whose vote was wrong or narrow."""
    weights = weights.copy()
    for _ in range(ROUNDS):
        moved = False
        for grams, lang in rows:
            wrong = weights[grams].mean(0) * CODE[lang] < MARGIN
            if wrong.any():
                moved = True
                buckets, n = np.unique(grams, return_counts=True)
                # The mean of the text's n-grams moves by RATE.
                weights[buckets] += RATE * len(grams) / (n**2).sum() * n[:, None] * (CODE[lang] * wrong)
        if not moved:
            break
    return np.clip(weights, -4, 4).astype(np.float32)


def fit(rows: list[tuple[str, int]]) -> Model:
    """Binary classifiers of (text, language index) rows: each bit begins with its log-odds of every n-gram, with a prior that keeps rare ones near zero, and is corrected by the rows."""

    def counted(pairs: list[tuple[str, int]]) -> np.ndarray:
        counts = np.zeros((len(LANGUAGES), BUCKETS))
        for text, lang in pairs:
            words = words_of(_ASIDE.sub(" ", text))
            if words:
                counts[lang] += np.bincount(np.concatenate([_grams(w) for w in words]), minlength=BUCKETS)
        return counts

    def solve(counts: np.ndarray) -> np.ndarray:
        share = counts / np.maximum(counts.sum(1, keepdims=True), 1)  # every language weighs the same
        weights = np.zeros((BUCKETS, BITS), np.float32)
        for b in range(BITS):
            yes, no = share[CODE[:, b] > 0].mean(0), share[CODE[:, b] < 0].mean(0)
            weights[:, b] = np.clip(np.log((yes + 2e-6) / (no + 2e-6)), -4, 4)
        return weights

    model = Model(solve(counted(rows)), np.ones(BITS, np.float32))
    guessed, sure = model.decode([words_of(_ASIDE.sub(" ", t)) for t, _ in rows])
    kept = [r for r, g, s in zip(rows, guessed, sure) if g == r[1] and s > 0.8]
    if len({lang for _, lang in kept}) < 2:
        kept = rows
    weights = solve(counted(kept))
    grams = [(np.concatenate([_grams(w) for w in words]), lang) for t, lang in kept if (words := words_of(_ASIDE.sub(" ", t)))]
    model = Model(corrected(weights, grams), np.ones(BITS, np.float32))
    if kept:
        votes, _ = model.margins([words_of(_ASIDE.sub(" ", t)) for t, _ in kept])
        right = (np.sign(votes) == CODE[[lang for _, lang in kept]]).mean(0)
        model.bit_weight = np.clip(2 * right - 1, 0.05, 1).astype(np.float32)
    return model


def fit_on(documents: DataFrame, sample: int = SAMPLE) -> Model:
    """A model fitted on about ``sample`` labelled documents, spread by a hash of their id."""
    labelled = documents.withColumn("label", label_column(F.col("lang"))).where(F.col("label").isin(*LANGUAGES))
    rows = bounded_sample(labelled.select("doc_id", "label", F.col("text").cast("string").alias("text")).where(F.length("text") >= 60), sample, labelled.count())
    return fit([(r.text, LANGUAGES.index(r.label)) for r in rows])


#: A sentence counts for a language of its own with at least so many letters and this confidence.
LETTERS, SURE = 16, 0.90


def segments(model: Model, texts: list[str]) -> list[list[tuple[int, float, int]]]:
    """For each text its runs of sentences of one language: (language index, confidence, letters), in reading order; empty without a whole sentence."""
    all_words, counts, whole = [], [], []
    for text in texts:
        own = sentences(text) if text else []
        counts.append(len(own))
        for s, complete in own:
            words = words_of(s)
            all_words.append(words)
            # A Chinese character says as much as some letters.
            size = len("".join(words))
            if words and "㐀" <= words[0][0] <= "鿿":
                size *= 3
            whole.append((size, complete, len(words)))
    langs, sure = model.decode(all_words)
    out, at = [], 0
    for n in counts:
        runs: list[list] = []
        ended = False
        for k in range(at, at + n):
            size, complete, count = whole[k]
            if not (complete and count >= 3 and size >= LETTERS and sure[k] >= SURE):
                continue
            ended = True
            lang = int(langs[k])
            if runs and runs[-1][0] == lang:
                runs[-1][1] += sure[k] * size
                runs[-1][2] += size
            else:
                runs.append([lang, sure[k] * size, size])
        out.append([(lang, total / size, size) for lang, total, size in runs] if ended else [])
        at += n
    return out


ASSIGNED = "tab string, rec_id string, seg_no int, lang string, confidence double, ambiguous boolean, label string"
UNKNOWN = "und"


def verdicts(model: Model, texts: list[str | None], single: list[bool]) -> list[list[tuple[int, str, float, bool]]]:
    """For each text its (seg_no, language, confidence, ambiguous); ``single`` texts have one row, of the language with most letters."""
    found = segments(model, texts)
    unclear = [k for k, runs in enumerate(found) if not runs]
    words = [words_of(_ASIDE.sub(" ", texts[k])) if texts[k] else [] for k in unclear]
    whole = dict(zip(unclear, zip(*model.decode(words)))) if unclear else {}
    out = []
    for k, runs in enumerate(found):
        if not runs:
            lang, sure = whole[k]
            out.append([(0, LANGUAGES[lang] if lang >= 0 else UNKNOWN, float(sure), True)])
        elif single[k] and len(runs) > 1:
            letters: dict[int, list[float]] = {}
            for lang, sure, size in runs:
                own = letters.setdefault(lang, [0.0, 0.0])
                own[0] += size
                own[1] += sure * size
            lang, (size, sure) = max(letters.items(), key=lambda x: (x[1][0], -x[0]))
            out.append([(0, LANGUAGES[lang], sure / sum(s for s, _ in letters.values()), False)])
        else:
            out.append([(j + 1 if len(runs) > 1 else 0, LANGUAGES[lang], float(sure), False) for j, (lang, sure, _) in enumerate(runs)])
    return out


def assign(rows: DataFrame, model: Model) -> DataFrame:
    """Rows for each of ``rows(tab, rec_id, label, text)``: seg_no 0 and the language of a text in one language, seg_no from 1 for several; translations have seg_no 0 only."""
    shared = rows.sparkSession.sparkContext.broadcast(model)  # a fixed size: buckets times bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = shared.value
        for batch in batches:
            out: list[tuple] = []
            for start in range(0, batch.num_rows, AT_ONCE):
                tabs, recs, labels, texts = (c.to_pylist() for c in batch.slice(start, AT_ONCE).columns)
                for tab, rec, label, own in zip(tabs, recs, labels, verdicts(found, texts, [t == "translations" for t in tabs])):
                    out += [(tab, rec, *v, label) for v in own]
            if out:
                yield pa.record_batch([pa.array(c) for c in zip(*out)], schema=_ARROW)

    return rows.select("tab", "rec_id", "label", "text").mapInArrow(run, ASSIGNED)


_ARROW = pa.schema([("tab", pa.string()), ("rec_id", pa.string()), ("seg_no", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64()), ("ambiguous", pa.bool_()), ("label", pa.string())])


def labelled_rows(documents: DataFrame, translations: DataFrame) -> DataFrame:
    """documents and translations as rows (tab, rec_id, label, text)."""
    docs = documents.select(F.lit("documents").alias("tab"), F.col("doc_id").cast("string").alias("rec_id"), label_column(F.col("lang")).alias("label"), F.col("text").cast("string").alias("text"))
    jobs = translations.select(F.lit("translations").alias("tab"), F.col("id").cast("string").alias("rec_id"), label_column(F.col("target_lang")).alias("label"), F.col("text").cast("string").alias("text"))
    return docs.unionByName(jobs)


def contradictions(assigned: DataFrame) -> DataFrame:
    """tab, rec_id, seg_no, lang where the label is missing or wrong, or the document is in several languages."""
    several = F.col("seg_no") > 0
    single = (F.col("seg_no") == 0) & ~F.col("ambiguous") & (F.col("lang") != F.col("label")) & (F.col("label") != MULTIPLE)
    return assigned.where(several | single).select("tab", "rec_id", "seg_no", "lang").distinct()
