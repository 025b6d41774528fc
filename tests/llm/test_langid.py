import zlib

import numpy as np

from taskprep.llm import langid
from tests.llm.fixtures import corpus, corpus_rows


def test_odd_rows_and_fold(spark):
    rows = corpus_rows()
    got = langid.identify_languages(corpus(spark, rows)).collect()
    assert len(got) == len(rows)
    texts = {}
    for r in rows:
        texts.setdefault(r[0], []).append(r[1])
    for r in got:
        assert r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 0)
        assert 0 <= r.score <= 1
        if all(not any(c.isalpha() for c in t or "") for t in texts[r.doc_id]):
            assert r.lang_pred == "und" and r.score == 0
        elif r.doc_id is not None and all(any(c.isalpha() for c in t or "") for t in texts[r.doc_id]):
            assert r.lang_pred in ("en", "fr")


def test_without_labels_and_empty(spark):
    rows = [(*r[:2], None, *r[3:]) for r in corpus_rows()]
    assert {r.lang_pred for r in langid.identify_languages(corpus(spark, rows)).collect()} == {"und"}
    assert langid.identify_languages(corpus(spark, [])).count() == 0


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    got = langid.op10_language_id(spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id")
    right, n = got.filter("held_out AND lang_pred = lang").count(), got.filter("held_out").count()
    assert n > 100 and right / n > 0.97


def test_gradient_and_sparsity():
    rng = np.random.default_rng(2)
    rows = []
    for i in range(200):
        y = i % 2
        idx = np.unique(np.concatenate(([y], rng.integers(10, 200, 8))))
        rows.append((idx, np.ones(len(idx)) / len(idx) ** 0.5, y, i % 5 == 4))
    w, t = langid.train(rows, 2)
    assert w[0, 0] > 0 > w[0, 1] and w[1, 1] > 0 > w[1, 0]
    assert (w[300:] == 0).all() and 0 < t < 20


def test_features_ignore_what_is_no_letter():
    a, b = langid.features("Ab  c1!d"), langid.features("ab c d")
    assert (a[0] == b[0]).all() and (a[1] == b[1]).all()
    assert langid.features("12 !?") is None and langid.features("") is None and langid.features(None) is None
