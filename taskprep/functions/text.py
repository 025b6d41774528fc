"""Text column functions (all JVM-side built-ins, no UDFs).

Java regex classes are ASCII by default while the semantics we match are
Unicode-aware, so every pattern that uses a class carries ``(?U)``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the original behaviour.
MAX_CLEAN_CHARS = 1280
ASCII_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
ARTICLES_PATTERN = r"(?U)\b(a|an|the)\b"
NUMBER_PATTERN = r"[-+]?\d*\.\d+|\d+"
URL_PATTERN = r"(?U)https?://\S+\b|www\.(\w+\.)+\S*"
# Strings a CSV reader treats as missing (pandas default NA tokens).
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
             "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
             "nan", "null")


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_text(c) -> Column:
    """lower; literal ``\\n`` runs -> space; ``\\\\`` runs removed; 2+ whitespace -> one
    space; runs of ``.?!`` -> the last mark; ``$`` -> ``$ ``; ``x.y`` -> ``x``; URLs
    removed; first 1280 code points."""
    c = F.lower(_c(c))
    c = F.regexp_replace(c, r"(\\n)+", " ")
    c = F.regexp_replace(c, r"(\\\\)+", "")
    c = F.regexp_replace(c, r"(?U)(\s){2,}", " ")
    c = F.regexp_replace(c, r"([.?!]){2,}", "$1")
    c = F.replace(c, F.lit("$"), F.lit("$ "))
    c = F.regexp_replace(c, r"(?U)(\d+)\.(\d+)", "$1")
    c = F.regexp_replace(c, URL_PATTERN, "")
    return F.substring(c, 1, MAX_CLEAN_CHARS)


def sep_concat(cleaned_first, raw_second) -> Column:
    """``first[SEP]second`` (the first field is expected cleaned, the second raw)."""
    return F.concat(_c(cleaned_first), F.lit("[SEP]"), _c(raw_second))


def strip_unicode(c) -> Column:
    """Python ``str.strip()``: remove leading/trailing Unicode whitespace."""
    return F.regexp_replace(_c(c), r"(?U)^\s+|\s+$", "")


def normalize_answer(c) -> Column:
    """lower -> drop ASCII punctuation -> articles to space -> collapse whitespace."""
    c = F.translate(F.lower(_c(c)), ASCII_PUNCTUATION, "")
    c = F.regexp_replace(c, ARTICLES_PATTERN, " ")
    c = F.regexp_replace(c, r"(?U)\s+", " ")
    return F.regexp_replace(c, r"^ | $", "")


def answer_tokens(c) -> Column:
    """Whitespace tokens of the normalised answer (empty text -> empty array)."""
    n = normalize_answer(c)
    return F.filter(F.split(n, " "), lambda t: t != "")


def is_missing(c) -> Column:
    """Null, or one of the NA tokens a CSV reader maps to null."""
    c = _c(c)
    return c.isNull() | c.cast("string").isin(*NA_TOKENS)


def coerce_number(c) -> Column:
    """Number text -> double: ``1,234.5`` style first, else the first numeric
    substring, else null (the caller keeps the text). Texts without a digit,
    such as ``nan`` or ``infinity``, are no numbers."""
    s = _c(c).cast("string")
    first = F.regexp_extract(s, NUMBER_PATTERN, 0)
    return F.coalesce(
        F.when(s.rlike(r"^\s*[+-]?[\d.,]+([eE][+-]?\d+)?\s*$"), F.replace(s, F.lit(","), F.lit(""))).try_cast("double"),
        F.when(first != "", first).try_cast("double"),
    )


def shift_label(c, by: int = -1) -> Column:
    return _c(c) + F.lit(by)
