"""Text column expressions with Python's ``str``/``re`` semantics on the JVM.

Python's ``\\w`` is Unicode; Java's plain ``\\w`` is ASCII and ``(?U)\\w`` also
accepts combining marks, so neither is used. Word characters are the explicit
class ``[\\p{L}\\p{N}_]``. Whitespace is the exact set ``str.isspace()`` accepts,
derived once from the running Python, so ``strip``/``split`` agree with Python.
Everything here is a built-in column expression (codegen, no Python UDF).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters Python treats as whitespace (str.isspace), derived by rule.
WS_CHARS = "".join(c for c in map(chr, range(0x110000)) if c.isspace())
# Regex class body for the same set, written as \x{..} escapes (Java and RE2 accept them).
WS_CLASS = "".join(f"\\x{{{ord(c):x}}}" for c in WS_CHARS)
# Regex class body for Python's Unicode \w.
WORD_CLASS = r"\p{L}\p{N}_"

# Token marker used for whole-word containment (see mark_tokens).
MARK = "\u0001"

_REGEX_SPECIAL = set("\\^$.|?*+()[]{}")


def regex_literal(text: str) -> str:
    """Java-regex pattern matching ``text`` literally."""
    return "".join("\\" + c if c in _REGEX_SPECIAL else c for c in text)


def strip_ws(col: Column) -> Column:
    """Python ``str.strip()``: drop whitespace at both ends."""
    return F.btrim(col, F.lit(WS_CHARS))


def split_ws(col: Column) -> Column:
    """Python ``str.split()``: words between whitespace runs, no empty words."""
    stripped = strip_ws(col)
    return F.when(stripped == "", F.array().cast("array<string>")).otherwise(
        F.split(stripped, f"[{WS_CLASS}]+")
    )


def word_runs(col: Column) -> Column:
    """Maximal runs of word characters (``re.findall(r'\\w+', s)``)."""
    return F.regexp_extract_all(col, F.lit(f"[{WORD_CLASS}]+"), 0)


def vectorizer_tokens(col: Column) -> Column:
    """Default vectoriser tokens: lower-cased maximal runs of >= 2 word characters."""
    return F.regexp_extract_all(F.lower(col), F.lit(f"[{WORD_CLASS}]{{2,}}"), 0)


def mark_tokens(col: Column) -> Column:
    """Wrap every word-character run in MARK characters.

    ``contains(mark_tokens(s), mark_tokens(k))`` equals ``re.search(rf'\\b{k}\\b', s)``
    for keywords that begin and end with a word character, without building a
    regex per keyword.
    """
    return F.regexp_replace(col, f"([{WORD_CLASS}]+)", f"{MARK}$1{MARK}")


def ngrams(tokens: Column, lo: int = 1, hi: int = 1) -> Column:
    """Word n-grams of orders lo..hi joined by one space, in vectoriser order
    (all 1-grams, then all 2-grams, ...)."""
    parts = []
    for n in range(lo, hi + 1):
        if n == 1:
            parts.append(tokens)
            continue
        parts.append(
            F.when(
                F.size(tokens) >= n,
                F.transform(F.sequence(F.lit(1), F.size(tokens) - (n - 1)), _ngram_at(tokens, n)),
            ).otherwise(F.array().cast("array<string>"))
        )
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def sequential_split(col: Column, delimiters: Sequence[str]) -> Column:
    """Split by each delimiter in turn (every part of the previous round is split
    by the next delimiter); delimiters are literal strings."""
    parts = F.array(col)
    for d in delimiters:
        parts = F.flatten(F.transform(parts, _splitter(d)))
    return parts


def _splitter(delimiter: str):
    pattern = regex_literal(delimiter)
    return lambda p: F.split(p, pattern)


def _ngram_at(tokens: Column, n: int):
    return lambda i: F.array_join(F.slice(tokens, i, n), " ")


def contains_any(col: Column, needles: Sequence[str]) -> Column:
    cond = F.lit(False)
    for n in needles:
        cond = cond | F.contains(col, F.lit(n))
    return cond
