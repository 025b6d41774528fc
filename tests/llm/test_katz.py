import math
import zlib
from collections import Counter, defaultdict

import pytest

from taskprep.llm import katz
from tests.llm.fixtures import ascii_lower, corpus, corpus_rows, white_words

END, START, UNK = "\0end", "\0start", "\0unk"


def fold(doc_id, n=7):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % n


def brute(rows, share=katz.VOCAB_SHARE):
    """The model of the module's docstring by plain dictionaries, probabilities not split into terms."""
    toks = [[ascii_lower(w) for w in white_words(r[1])] for r in rows]
    train = [t for t, r in zip(toks, rows) if fold(r[0]) != 2]
    uni = Counter(w for t in train for w in t)
    n = sum(uni.values()) + len(train)
    vocab = {w for w, c in uni.items() if c >= max(1, math.ceil(n * share))}
    cls = lambda w: w if w in vocab or w == END else UNK
    cc = Counter(uni.values())
    d1 = katz.good_turing([cc[r] for r in range(1, katz.CUT + 2)])
    dis = lambda d, c: d[c] if c <= katz.CUT else 1.0
    p1 = {w: dis(d1, uni[w]) * uni[w] / (n + 1) for w in vocab}
    p1[END] = dis(d1, len(train)) * len(train) / (n + 1) if train else 0.5
    p1[UNK] = 1 - sum(p1.values())
    hist = Counter(cls(w) for t in train for w in t)
    hist[START] = len(train)
    big = Counter()
    for t in train:
        seq = [START, *map(cls, t), END]
        big.update(zip(seq, seq[1:]))
    cc = Counter(big.values())
    d2 = katz.good_turing([cc[r] for r in range(1, katz.CUT + 2)])
    seen = defaultdict(dict)
    for (h, w), c in big.items():
        seen[h][w] = dis(d2, c) * c / (hist[h] + 1)
    alpha = {h: (1 - sum(seen[h].values())) / (1 - sum(p1[w] for w in seen[h])) if sum(p1[w] for w in seen[h]) < 1 - 1e-12 else 1.0 for h in [*vocab, UNK, START]}
    rare = {w: c for w, c in uni.items() if w not in vocab}

    def p(h, w):
        return seen[h][w] if w in seen[h] else alpha[h] * p1[w]

    for h in list(alpha)[:40]:  # the model sums to 1 for every history
        assert abs(sum(p(h, w) for w in p1) - 1) < 1e-9
    out = []
    v = len(uni) + bool(train)
    for r, t in zip(rows, toks):
        seq = [START, *map(cls, t), END]
        score = sum(math.log10(p(h, w)) for h, w in zip(seq, seq[1:]))
        score += sum(math.log10((uni[w] + 1) / (sum(rare.values()) + len(rare) + 1)) for w in t if cls(w) == UNK)
        counts = [uni[w] for w in t] + [len(train)]
        out.append((r[0], fold(r[0]) == 2, len(t) + 1, sum(c > 0 for c in counts), n, sum(math.log10((c + 1) / (n + v + 1)) for c in counts), score))
    return out


def compare(spark, rows, **kw):
    got = sorted(map(tuple, katz.score_texts(corpus(spark, rows)).collect()), key=lambda r: (str(r[0]), *r[1:]))
    want = sorted(brute(rows, **kw), key=lambda r: (str(r[0]), *r[1:]))
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:5] == w[:5]
        assert g[5] == pytest.approx(w[5], rel=1e-9) and g[6] == pytest.approx(w[6], rel=1e-9)


def test_against_brute_force(spark):
    compare(spark, corpus_rows())


def test_small_matrix_and_rare_words(spark, monkeypatch):
    """Most bigrams travel, and words under the vocabulary's share are of one class."""
    monkeypatch.setattr(katz, "DENSE", 12)
    monkeypatch.setattr(katz, "VOCAB_SHARE", 5e-4)
    monkeypatch.setattr(katz, "FLUSH", 800)
    compare(spark, corpus_rows(), share=5e-4)


def test_no_training_rows_and_empty_table(spark):
    rows = [r for r in corpus_rows() if fold(r[0]) == 2]
    compare(spark, rows)
    assert katz.score_texts(corpus(spark, [])).count() == 0


def test_discounts():
    d = katz.good_turing([1000, 400, 220, 140, 100, 75])
    assert d[0] == d[katz.CUT + 1] == 1 and all(0 < x < 1 for x in d[1 : katz.CUT + 1])
    assert katz.good_turing([0] * 6)[1] == 0.5


@pytest.mark.parametrize("held", [0, 6, 40])
def test_words_that_tasks_do_not_hold_keep_their_bigrams(spark, monkeypatch, held):
    """No word of the training texts is of the class of unseen words, however few of them a task holds."""
    monkeypatch.setattr(katz, "HELD", held)
    monkeypatch.setattr(katz, "DENSE", 8)
    compare(spark, corpus_rows(), share=0.0)


def test_no_share_of_the_tokens_is_asked_of_a_word():
    assert katz.VOCAB_SHARE == 0
