import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from taskprep.llm import runs
from tests.llm.fixtures import SCHEMA, corpus, corpus_rows, white_words


def lyndon_brute(w):
    return [next((j - i for j in range(i + 1, len(w)) if w[j:] < w[i:]), len(w) - i) for i in range(len(w))]


def runs_brute(w, least, exponent):
    out, n = [], len(w)
    for s in range(n):
        for q in range(1, n - s):
            if s and w[s - 1] == w[s + q - 1]:
                continue
            j = s
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if (size := j + q - s) >= max(least, exponent * q) and all(any(w[x] != w[x + r] for x in range(s, s + size - r)) for r in range(1, q)):
                out.append((s, size, q))
    return sorted(out, key=lambda x: (x[0], x[2]))


def collapse(w, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40))
def test_lyndon_arrays(w):
    assert runs.lyndon_lengths(w) == lyndon_brute(w)
    assert runs.lyndon_lengths([3 - x for x in w]) == lyndon_brute([3 - x for x in w])


@pytest.mark.parametrize("least, exponent", [(6, 4), (3, 3), (8, 5)])
def test_runs_of_random_sequences(least, exponent):
    rng = random.Random(least)
    for _ in range(800):
        w = [rng.randint(1, rng.randint(1, 3)) for _ in range(rng.randint(0, 50))]
        if len(w) > 10 and rng.random() < 0.7:
            p, a = rng.randint(1, 6), rng.randint(0, len(w) // 2)
            for i in range(a, rng.randint(a, len(w))):
                w[i] = w[a + (i - a) % p]
        h = np.array(w, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        parts = runs.stretches(h, np.array([0, len(w)]), least, exponent)
        assert runs.find_runs(h, parts, least, exponent) == runs_brute(w, least, exponent), w


def test_operator_on_odd_rows(spark):
    got = sorted((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in runs.periodic_runs(corpus(spark)).filter("doc_id IS NOT NULL").collect())
    want = []
    for r in corpus_rows():
        if r[0] is not None:
            w = white_words(r[1])
            found = runs_brute(w, 6, 4) if len(w) < 1000 else None
            want.append((r[0], len(w), found, collapse(w, found or [])))
    want = sorted(want, key=lambda x: (x[0], x[1]))
    got = sorted(got, key=lambda x: (x[0], x[1]))
    assert [x if w[2] is not None else (*x[:2], None, w[3]) for x, w in zip(got, want)] == want
    assert sum(bool(x[2]) for x in got) >= 4


def test_a_very_long_text_is_one_run(spark):
    text = "head " + " ".join(f"w{i % 700}" for i in range(70_000)) + " tail"
    (r,) = runs.periodic_runs(spark.createDataFrame([(1, text), ], "doc_id long, text string")).collect()
    assert [tuple(x) for x in r.runs] == [(1, 70_000, 700)]
    assert r.collapsed == collapse(text.split(), [(1, 70_000, 700)])


def test_planted_words(spark):
    rows = [(i, " ".join(f"a{(i * k) % 17}" for k in range(i % 50))) for i in range(400)] + [(401, None), (None, "a b c")]
    out = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", "text", runs.planted(F.col("text"), F.col("doc_id")).alias("t"))
    changed = 0
    for r in out.collect():
        w = white_words(r.text)
        h = zlib.crc32(str(r.doc_id).encode()) if r.doc_id is not None else 1
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[a + (i - a) % p] if i >= a else x for i, x in enumerate(w)]
            changed += 1
            assert r.t == " ".join(w)
        else:
            assert r.t == r.text
    assert changed > 20


def test_empty_table(spark):
    assert runs.periodic_runs(spark.createDataFrame([], SCHEMA)).count() == 0
