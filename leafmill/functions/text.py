"""Column functions on text that stay in the JVM, and Arrow functions for what it can't express."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes and the names of masks.
RESIDUAL_CJK = "[぀-ヿ㐀-䶿一-鿿가-힣豈-﫿]"
# Signs of boxes, circles and ticks.
BOXES = "☐-☒○●◯✓✔✗✘"
MASKS = {"☑": "[[CBX_ON]]", "☐": "[[CBX_OFF]]"}


def worth_translating(text: Column) -> Column:
    """True for a text with a letter."""
    return F.coalesce(text, F.lit("")).rlike(r"\p{L}")


def has_cjk(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(RESIDUAL_CJK)


def script_language(text: Column) -> Column:
    """ja for kana, else ko for hangul, else zh for Chinese characters, else null."""
    return F.when(text.rlike("[぀-ヿ]"), "ja").when(text.rlike("[가-힣]"), "ko").when(text.rlike("[㐀-䶿一-鿿]"), "zh")


def masked(text: Column) -> Column:
    """Boxes as words that a model leaves alone."""
    for glyph, word in MASKS.items():
        text = F.replace(text, F.lit(glyph), F.lit(word))
    return text


def unmasked(text: Column) -> Column:
    for glyph, word in MASKS.items():
        text = F.replace(text, F.lit(word), F.lit(glyph))
    return text


def boxes(text: Column) -> Column:
    """How many boxes a text has, glyphs and form fields."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(rf"(?i)[{BOXES}]|<input\b"))


# Pairs of options that stand beside boxes on forms; what parts two words.
_GAP = r"[^\p{L}\p{N}_]"
OPTION_PAIRS = tuple(
    f"{first}(?:{_GAP}|{_GAP}.*{_GAP}){second}"
    for first, second in (("[:：]\\s*是", "否"), ("[:：]\\s*有", "无"), ("正常", "(?:异常|非正常)"), ("合格", "不合格"), ("[:：]\\s*(?i:yes|pass|normal)", f"(?i:no|fail|abnormal)(?:{_GAP}|$)"))
)


def box_hint(text: Column) -> Column:
    """True for a text that names a pair of options and shows no box."""
    text = F.coalesce(text, F.lit(""))
    return (boxes(text) == 0) & text.rlike("|".join(OPTION_PAIRS))


def signature(text: Column) -> Column:
    """Letters a to z, digits and Chinese characters, lower case."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^0-9a-z㐀-䶿一-鿿]", "")


def parts(text: Column) -> Column:
    """A text cut into tags and what stands between them, a lone angle bracket included; joined they give the text again."""
    return F.regexp_extract_all(text, F.lit(r"<[^>]+>|(?:[^<]|<(?![^>]+>))+"), F.lit(0))


def formula_words(text: Column) -> Column:
    r"""A formula cut into its \\text{} groups and what stands between them; joined they give the formula again."""
    return F.regexp_extract_all(text, F.lit(r"\\text\{[^{}]*\}|(?s:(?:(?!\\text\{[^{}]*\}).)+)"), F.lit(0))


def without_boxes_of_tags(html: Column) -> Column:
    """Table markup without the boxes that a model gave its tags, inline math in dollars."""
    bare = F.regexp_replace(html, r"(?i)(<[a-z][^<>]*?)\s+data-bbox\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s<>]+)", "$1")
    return F.regexp_replace(bare, r"(?is)<math\b[^>]*>\s*(.*?)\s*</math>", r"\$$1\$")


def bare_formula(html: Column) -> Column:
    """The LaTeX of a formula block: what stands in its math tags, or all of it without tags; no dollar signs."""
    inner = F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<math\b[^>]*>(.*?)</math>"), F.lit(1)), lambda x: F.trim(x))
    joined = F.array_join(F.filter(inner, lambda x: x != ""), " ")
    plain = F.when(F.size(inner) > 0, joined).otherwise(F.regexp_replace(html, r"<[^<>]*>", " "))
    return F.trim(F.regexp_replace(F.replace(plain, F.lit("$"), F.lit("")), r"\s+", " "))


def utf8_size(text: Column) -> Column:
    return F.octet_length(F.coalesce(text, F.lit("")))


def answer_only(text: Column) -> Column:
    """A model's answer without its reasoning and the fence around it."""
    bare = F.trim(F.regexp_replace(text, r"(?is)<think>.*?</think>", ""))
    return F.regexp_replace(F.regexp_replace(bare, r"^```[a-zA-Z]*\s*\n?", ""), r"\n?```\s*$", "")


def answer_list(text: Column, wanted: Column) -> Column:
    """The strings of a JSON answer, a list or an object with translations, items or output; null if there aren't ``wanted`` of them. A null among them is an empty string."""
    body = answer_only(text)
    listed = F.from_json(body, "array<string>")
    held = F.from_json(body, "translations array<string>, items array<string>, output array<string>")
    found = F.coalesce(F.when(body.startswith("["), listed), held["translations"], held["items"], held["output"])
    return F.when(F.size(found) == wanted, F.transform(found, lambda x: F.coalesce(x, F.lit(""))))


def display_width(text: Column) -> Column:
    """Columns of a terminal; East Asian characters take two."""
    return F.length(text) + F.regexp_count(text, F.lit("[ᄀ-ᅟ⺀-꓏가-힣豈-﫿︰-﹏＀-｠￠-￦]"))


def balanced_dollars(text: Column) -> Column:
    """Lines with an odd number of dollar signs get one more."""
    return F.array_join(F.transform(F.split(text, "\n"), lambda x: F.when(F.regexp_count(x, F.lit(r"\$")) % 2 == 1, F.concat(x, F.lit("$"))).otherwise(x)), "\n")


def inline_math(text: Column) -> Column:
    """Inline math tags as dollar signs."""
    return F.regexp_replace(text, r"(?is)<math(?![^>]*block)[^>]*>(.*?)</math>", r"\$$1\$")


def hex_colour(red: Column, green: Column, blue: Column) -> Column:
    """RRGGBB; near-white, which would not be seen, is black."""
    white = (red >= 240) & (green >= 240) & (blue >= 240)
    return F.when(white, "000000").otherwise(F.format_string("%02X%02X%02X", red, green, blue))


def xml_escaped(text: Column) -> Column:
    """Text for XML: control signs dropped, the three signs of markup escaped."""
    text = F.regexp_replace(text, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]", "")
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text


def artifact_name(name: Column, language: Column, suffix: str) -> Column:
    """A file's stem with a language tag and another suffix."""
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    tag = F.regexp_replace(F.coalesce(language, F.lit("")), "[^A-Za-z0-9_-]", "")
    return F.concat(stem, F.when(tag != "", F.concat(F.lit("_"), tag)).otherwise(""), F.lit(suffix))


def _header_value(name: str | None, disposition: str = "attachment") -> str | None:
    if name is None:
        return None
    stem, dot, ext = name.rpartition(".")
    ascii_of = lambda s: re.sub(r"[^A-Za-z0-9._() -]+", "_", unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode()).strip(" ._")
    plain = (ascii_of(stem if dot else name) or "file") + (f".{ascii_of(ext)}" if dot and ascii_of(ext) else "")
    return f"{disposition}; filename=\"{plain}\"; filename*=UTF-8''{quote(name, safe='')}"


def _vectorised(function: Callable[[str | None], object], kind: str, column: Column | str) -> Column:
    """A function of one text applied to a column in Arrow batches."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(function)

    return F.pandas_udf(run, kind)(column)


def content_disposition(name: Column | str) -> Column:
    """The header that names a download: an ASCII form, and the name itself percent-encoded."""
    return _vectorised(_header_value, "string", name)


def tail_period(text: str | None, window: int = 500) -> int:
    """The period of a repeated tail, 0 if there is none: p characters that end a text more than 4 (1 + 3/p) times in a row."""
    tail = (text or "")[-window:]
    n = len(tail)
    for p in range(1, n // 4 + 1):
        k = p
        while k < n and tail[n - 1 - k] == tail[n - 1 - k + p]:
            k += 1
        if k // p > 4 * (1 + 3 / p):
            return p
    return 0


def repeated_tail(text: Column | str) -> Column:
    """tail_period of each text."""
    return _vectorised(tail_period, "int", text)


# Commands of inline formulas and their signs.
LATEX_SIGNS = {
    "pm": "±", "mp": "∓", "times": "×", "div": "÷", "cdot": "·", "ast": "*", "star": "⋆", "leq": "≤", "le": "≤", "geq": "≥", "ge": "≥", "neq": "≠", "ne": "≠",
    "approx": "≈", "equiv": "≡", "sim": "∼", "propto": "∝", "ll": "≪", "gg": "≫", "rightarrow": "→", "to": "→", "leftarrow": "←", "Rightarrow": "⇒", "Leftarrow": "⇐",
    "leftrightarrow": "↔", "Leftrightarrow": "⇔", "infty": "∞", "partial": "∂", "nabla": "∇", "degree": "°", "circ": "°", "prime": "′", "sum": "∑", "prod": "∏", "int": "∫",
    "angle": "∠", "perp": "⊥", "parallel": "∥", "cdots": "⋯", "ldots": "…", "dots": "…", "vdots": "⋮", "percent": "%",
    "alpha": "α", "beta": "β", "gamma": "γ", "delta": "δ", "epsilon": "ε", "varepsilon": "ε", "zeta": "ζ", "eta": "η", "theta": "θ", "iota": "ι", "kappa": "κ", "lambda": "λ",
    "mu": "μ", "nu": "ν", "xi": "ξ", "pi": "π", "rho": "ρ", "sigma": "σ", "tau": "τ", "upsilon": "υ", "phi": "φ", "varphi": "φ", "chi": "χ", "psi": "ψ", "omega": "ω",
    "Gamma": "Γ", "Delta": "Δ", "Theta": "Θ", "Lambda": "Λ", "Xi": "Ξ", "Pi": "Π", "Sigma": "Σ", "Phi": "Φ", "Psi": "Ψ", "Omega": "Ω",
    ",": " ", ";": " ", " ": " ", "%": "%", "&": "&", "#": "#", "_": "_", "{": "{", "}": "}", "$": "$",
}
_SUPER, _SUB = str.maketrans("0123456789+-=()n", "⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻⁼⁽⁾ⁿ"), str.maketrans("0123456789+-=()", "₀₁₂₃₄₅₆₇₈₉₊₋₌₍₎")
_LATEX = re.compile(r"\\([A-Za-z]+|.)|[{}^_]|[^\\{}^_]+", re.S)


def latex_to_unicode(source: str) -> str:
    """An inline formula as plain signs: commands by LATEX_SIGNS, fractions as a/b, roots, raised and lowered digits; braces match."""
    tokens = [m.group() for m in _LATEX.finditer(source)]
    at = 0

    def group() -> str:
        nonlocal at
        if at < len(tokens) and tokens[at] == "{":
            at += 1
            inner = run(True)
            at += 1
            return inner
        if at < len(tokens) and tokens[at][0] not in "\\{}^_" and len(tokens[at]) > 1:
            first, tokens[at] = tokens[at][0], tokens[at][1:]
            return first
        return one() if at < len(tokens) else ""

    def one() -> str:
        nonlocal at
        token = tokens[at]
        at += 1
        if token in "^_" and len(token) == 1:
            inner, table = group(), _SUPER if token == "^" else _SUB
            moved = inner.translate(table)
            return moved if all(a != b or a == " " for a, b in zip(inner, moved)) else f"{token}({inner})" if len(inner) > 1 else token + inner
        if token == "{":
            inner = run(True)
            at += 1
            return inner
        if token.startswith("\\"):
            name = token[1:]
            if name == "frac":
                top, low = group(), group()
                return "/".join(f"({x})" if len(x) > 1 and not x.isalnum() else x for x in (top, low))
            if name == "sqrt":
                inner = group()
                return f"√({inner})" if len(inner) > 1 else f"√{inner}"
            if name in ("text", "mathrm", "mathbf", "mathit", "textbf", "textit", "operatorname", "overline", "underline", "bar", "hat", "vec"):
                return group()
            return LATEX_SIGNS.get(name, "" if name in ("left", "right", "displaystyle", "quad") else name)
        return "" if token == "}" else token

    def run(inside: bool) -> str:
        out = []
        while at < len(tokens) and not (inside and tokens[at] == "}"):
            out.append(one())
        return "".join(out)

    return run(False)


_INLINE_MATH = re.compile(r"(?<![\\$])\$(?=[^\s$])([^$\n]+?)(?<=\S)\$(?!\d)")


def _formulas(text: str | None) -> str | None:
    return None if text is None else _INLINE_MATH.sub(lambda m: latex_to_unicode(m.group(1)), text)


def formulas_as_text(text: Column | str) -> Column:
    """Texts with their inline formulas between dollar signs as plain signs."""
    return _vectorised(_formulas, "string", text)
