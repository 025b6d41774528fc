import re

import pytest
from pyspark.sql import functions as F

from taskprep.llm import quality
from tests.llm.fixtures import corpus, corpus_rows, white_words


def brute(t):
    w = white_words(t)
    t = t or ""
    hits = set()
    seen = {}
    for i in range(len(w) - 7):
        seen.setdefault(tuple(w[i : i + 8]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            for i in at:
                hits.update(range(i, i + 8))
    lines = [x for x in t.split("\n") if white_words(x)]
    n_rep = len(hits)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), n_rep, len(w) < 20 or 100 * n_rep > 30 * len(w))


def test_counts_against_brute_force(spark):
    out = quality.judge_quality(corpus(spark))
    q = F.col(out.columns[-1])
    got = out.select("doc_id", "text", q["n_words"], q["word_chars"], q["n_symbols"], q["lines"]["n_dup"], q["n_repeat_words"], q["base_failed"], q["kept"]).collect()
    assert len(got) == len(corpus_rows())
    for r in got:
        assert tuple(r[2:8]) == brute(r[1]), r
        assert not (r[7] and r[8])


def test_input_columns_stay_and_cannot_clash(spark):
    out = quality.judge_quality(corpus(spark))
    assert out.columns[:-1] == corpus(spark).columns and out.columns[-1] == "quality_1"


def test_empty_table(spark):
    assert quality.judge_quality(corpus(spark, [])).count() == 0


def brute_em(table, rules):
    prior, good, bad = quality.PRIOR, [quality.DOWN["good"]] * rules, [quality.DOWN["bad"]] * rules

    def side(votes, down):
        p = 1.0
        for v, d in zip(votes, down):
            p *= {1: 1 - d, 0: d, -1: 1.0}[v]
        return p

    for _ in range(quality.ITERATIONS):
        q = {v: prior * side(v, good) / (prior * side(v, good) + (1 - prior) * side(v, bad)) for v in table}

        def rate(j, cls, of):
            cast = sum(of(v) for v in table if v[j] >= 0)
            down = sum(of(v) for v in table if v[j] == 0)
            return (down + quality.DOWN[cls] * quality.BELIEF) / (cast + quality.BELIEF)

        new_good = [rate(j, "good", lambda v: table[v] * q[v]) for j in range(rules)]
        new_bad = [rate(j, "bad", lambda v: table[v] * (1 - q[v])) for j in range(rules)]
        prior = (sum(table[v] * q[v] for v in table) + quality.PRIOR * quality.BELIEF) / (sum(table.values()) + quality.BELIEF)
        good, bad = new_good, [max(x, y) for x, y in zip(new_good, new_bad)]
    return prior, good, bad


def test_fit_against_plain_em(spark):
    table = {(1, 1, 1): 900.0, (0, 1, 0): 60.0, (0, 0, -1): 30.0, (1, -1, 1): 40.0, (-1, 0, 0): 25.0}
    rows = [(list(v),) for v, n in table.items() for _ in range(int(n))]
    fit = quality.fit_rules(spark.createDataFrame(rows, "votes array<int>")).first().fit
    prior, good, bad = brute_em(table, 3)
    assert fit.prior == pytest.approx(prior, rel=1e-9)
    assert list(fit.good) == pytest.approx(good, rel=1e-9) and list(fit.bad) == pytest.approx(bad, rel=1e-9)


def test_labelled_documents(spark):
    """Junk labelled in the given table goes, labelled good text stays."""
    d = "/root/testdata/sf0.01"
    got = quality.op9_quality_rules(spark, d).join(spark.read.parquet(f"{d}/labels.parquet").select("doc_id", F.col("quality").alias("label")), "doc_id")
    r = got.filter("NOT base_failed").groupBy("label").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()
    rate = {x.label: x.k for x in r}
    assert rate[1] > 0.97 and rate[0] < 0.1
