import random

from pyspark.sql import functions as F

from taskprep.llm import mixing
from tests.llm.fixtures import corpus, corpus_rows, white_words


def brute_targets(sizes: dict, weights=(1, 2, 3), cap=3.0) -> dict:
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        rest, share = total - sum(fixed.values()), sum(w[s] for s in free)
        over = [s for s in free if w[s] * rest / share > cap * sizes[s] + 1e-9]
        if not over:
            return {s: fixed.get(s, w[s] * rest / share if share else 0.0) for s in names}
        fixed.update({s: cap * sizes[s] for s in over})


def test_targets_and_budgets(spark):
    rows = mixing.mix_sources(corpus(spark)).collect()
    assert len(rows) == len(corpus_rows())
    sizes = {}
    for r in corpus_rows():
        sizes[r[3]] = sizes.get(r[3], 0) + len(white_words(r[1]))
    want = brute_targets(sizes)
    taken = {}
    for r in rows:
        assert abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        assert r.source_size == sizes[r.source] and 0 <= r.taken <= 3 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s, t in taken.items():
        assert abs(t - want[s]) <= 1
    assert sum(want.values()) == __import__("pytest").approx(sum(sizes.values()))


def test_reruns_agree_whatever_the_partitions(spark):
    cols = ["doc_id", "source", "size", "target", "taken"]
    a = sorted(map(str, mixing.mix_sources(corpus(spark)).select(cols).collect()))
    b = sorted(map(str, mixing.mix_sources(corpus(spark).repartition(7)).select(cols).collect()))
    assert a == b


def test_empty_table_and_empty_source(spark):
    assert mixing.mix_sources(corpus(spark, [])).count() == 0
    rows = [r for r in corpus_rows() if not white_words(r[1])]
    got = mixing.mix_sources(corpus(spark, rows)).collect()
    assert len(got) == len(rows) and all(r.taken == 0 and r.target == 0 for r in got)


def test_epochs_repeat_up_to_the_cap(spark):
    rng = random.Random(3)
    rows = [(i, " ".join("w" for _ in range(rng.randint(1, 9))), None, "big" if i < 90 else "zz", 0) + (None,) * 11 for i in range(100)]
    got = mixing.mix_sources(corpus(spark, rows))
    small = got.filter("source = 'zz'").agg(F.sum("taken").alias("t"), F.first("source_size").alias("s"), F.max(F.col("taken") - 3 * F.col("size")).alias("over")).first()
    assert small.t == 3 * small.s and small.over == 0
