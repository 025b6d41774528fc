"""DuckDB renderings of the column functions, used by the oracle SQL strings.

They restate the same rules in DuckDB's dialect (RE2 regexes, ``\\1``
back-references) so that every registered query has an independent check.
"""

from __future__ import annotations

PUNCT_SQL = "'!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~'"


def clean_text(e: str) -> str:
    s = f"lower({e})"
    s = f"regexp_replace({s}, '(\\\\n)+', ' ', 'g')"
    s = f"regexp_replace({s}, '(\\\\\\\\)+', '', 'g')"
    s = f"regexp_replace({s}, '(\\s){{2,}}', ' ', 'g')"
    s = f"regexp_replace({s}, '([.?!]){{2,}}', '\\1', 'g')"
    s = f"replace({s}, '$', '$ ')"
    s = f"regexp_replace({s}, '(\\d+)\\.(\\d+)', '\\1', 'g')"
    s = f"regexp_replace({s}, 'https?://\\S+\\b|www\\.(\\w+\\.)+\\S*', '', 'g')"
    return f"substr({s}, 1, 1280)"


def answer_tokens(e: str) -> str:
    """Normalised answer tokens as a list (articles dropped as tokens)."""
    return (f"list_filter(regexp_split_to_array(translate(lower({e}), {PUNCT_SQL}, ''), '\\s+'), "
            f"lambda x: x NOT IN ('', 'a', 'an', 'the'))")


def normalize_answer(e: str) -> str:
    return f"array_to_string({answer_tokens(e)}, ' ')"


def seeded_md5(seed, *cols: str) -> str:
    parts = [f"'{seed}'"]
    for c in cols:
        parts.append(f"':' || CAST({c} AS VARCHAR)")
    return "md5(" + " || ".join(parts) + ")"


def uniform_hash(seed, *cols: str) -> str:
    return f"CAST(CAST('0x' || substr({seeded_md5(seed, *cols)}, 1, 13) AS BIGINT) AS DOUBLE) / {float(16 ** 13)}"
