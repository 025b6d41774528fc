"""A small corpus with every odd row, and an empty one, both with clashing extra columns."""

from __future__ import annotations

import random
import re

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
          "id string, ID2 int, quality string, size string, row string, dk string, n string, `key` string, `score` string, kept string, component_id string")


def words(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choice(["an", "er", "on", "te", "li", "mo", "su", "ka", "re"]) for _ in range(rng.randint(1, 4))) for _ in range(n)]


def prose(rng: random.Random, n: int) -> str:
    w = words(rng, n)
    return "".join(x + ("." if i % 9 == 8 else "") + ("\n" if i % 23 == 22 else " ") for i, x in enumerate(w)).strip()


def corpus_rows(seed: int = 1) -> list[tuple]:
    rng = random.Random(seed)
    base = [prose(rng, rng.randint(30, 120)) for _ in range(24)]
    passage = " ".join(words(rng, 60))
    texts: list[str | None] = list(base)
    texts += [base[0], base[0], base[1]]  # exact copies
    for k in range(4):  # near copies of one text
        w = base[2].split(" ")
        w[5 + 7 * k] = "changed"
        texts.append(" ".join(w))
    texts += [prose(rng, 20) + " " + passage + " " + prose(rng, 15) for _ in range(5)]
    texts += [None, "", "   \n\t ", "one", "One", "two words", "\n\n\n", "ünïcödé ÉÀ ñ wörds " * 12, "a" * 400, "ab " * 200]
    texts += ["x1 x2 x3 x4 x5 x6 x7 x8 " * 6, "\n".join(["same line of some words here"] * 7), prose(rng, 6000)]
    texts += ["ALL CAPS!! AND!! MARKS!! " * 20, "%%% *** &&& ### word " * 30]
    rows = []
    for i, t in enumerate(texts):
        lang = ["en", "fr", None][i % 3]
        rows.append((i + 10, t, lang, ["b", "a", None, "c", "é"][i % 5], len(t) if t else 0))
    rows += [rows[3], rows[3], (None, base[4], "en", "a", 1), (None, None, None, None, None), (None, "", None, "b", None)]
    rows.append((rows[5][0], base[6] + " tail", "fr", None, 3))  # an id that has another text too
    return [(*r, *(str(i) if k != 1 else i for k in range(11))) for i, r in enumerate(rows)]


def corpus(spark, rows=None):
    return spark.createDataFrame(corpus_rows() if rows is None else rows, SCHEMA).repartition(3)


def ascii_lower(t: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def white_words(t: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")
