import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from taskprep.llm import simhash
from tests.llm.fixtures import SCHEMA, ascii_lower, corpus, corpus_rows, white_words


def fingerprint(text, words=4):
    w = white_words(ascii_lower(text or ""))
    grams = [" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] if len(w) >= words else [" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(points, distance):
    """Index of each point's group by all pairs."""
    parent = list(range(len(points)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    a = np.array(points, np.uint64)
    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a[:i] ^ a[i]) <= distance).tolist():
            x, y = find(i), find(j)
            parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(a))]


@pytest.mark.parametrize("words, distance", [(4, 4), (2, 6)])
def test_against_brute_force(spark, words, distance):
    rows = corpus_rows()
    fps = [fingerprint(r[1], words) for r in rows]
    home = groups(fps, distance)
    least = {g: min((r[0] for r, h in zip(rows, home) if h == g and r[0] is not None), default=None) for g in set(home)}
    want = sorted(str((r[0], f, least[g])) for r, f, g in zip(rows, fps, home))
    got = simhash.simhash_groups(corpus(spark), words=words, distance=distance).collect()
    assert sorted(str((r.doc_id, r.fp % 2**64, r.component_id)) for r in got) == want


def scattered(seed):
    """Fingerprints round centres: chains, tight balls, and members that are just not near enough."""
    rng = random.Random(seed)
    flip = lambda x, n: x ^ sum(1 << b for b in rng.sample(range(64), n))
    out = [rng.getrandbits(64) for _ in range(150)] + [0, 2**64 - 1]
    for _ in range(4):
        c = rng.getrandbits(64)
        out += [flip(c, rng.randint(0, 7)) for _ in range(120)]
        for _ in range(30):
            c = flip(c, rng.choice([3, 4, 5]))
            out.append(c)
    return list(dict.fromkeys(out))


@pytest.mark.parametrize("distance, alike", [(4, 3), (2, 2), (6, 4)])
def test_every_link_is_found(spark, distance, alike):
    points = scattered(distance)
    frame = spark.createDataFrame([(x - 2**64 if x >> 63 else x,) for x in points], "fp long")
    comp = {r.node % 2**64: r.comp for r in simhash.linked(frame, distance, alike).collect()}
    ours: dict = {}
    for i, x in enumerate(points):
        ours.setdefault(comp.get(x, ("alone", x)), set()).add(i)
    want: dict = {}
    for i, g in enumerate(groups(points, distance)):
        want.setdefault(g, set()).add(i)
    assert sorted(map(sorted, ours.values())) == sorted(map(sorted, want.values()))


def test_embedding_is_a_lower_bound(spark):
    rng = random.Random(3)
    pairs = [(rng.getrandbits(64) - 2**63, rng.getrandbits(64) - 2**63) for _ in range(500)]
    e = simhash.embedding
    got = spark.createDataFrame(pairs, "a long, b long").select("a", "b", F.bit_count(e(F.col("a")).bitwiseXOR(e(F.col("b")))).alias("d")).collect()
    for r in got:
        counts = lambda x: [(x >> 2 * s & 1) + (x >> 2 * s + 1 & 1) for s in range(32)]
        assert r.d == sum(abs(x - y) for x, y in zip(counts(r.a % 2**64), counts(r.b % 2**64))) <= ((r.a ^ r.b) % 2**64).bit_count()


def test_blocks_of_a_long_text_add_up(monkeypatch):
    rng = np.random.default_rng(1)
    h, doc = rng.integers(0, 2**64, 500, np.uint64), np.sort(rng.integers(0, 9, 500))
    whole = simhash.bit_majorities(h, doc, 10)
    monkeypatch.setattr(simhash, "BLOCK", 7)
    assert (simhash.bit_majorities(h, doc, 10) == whole).all() and whole[9] == 0


def test_empty_table(spark):
    assert simhash.simhash_groups(spark.createDataFrame([], SCHEMA)).count() == 0


def test_cells_are_not_broadcast(spark, monkeypatch):
    """The planner takes the 70 cells of each point for the size of the point."""
    points = spark.range(3000).select(F.xxhash64("id").alias("fp")).union(spark.range(500).select((F.col("id") * 64).alias("fp")))
    plans, cut = [], simhash.cut_lineage
    monkeypatch.setattr(simhash, "cut_lineage", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    assert simhash.cells(points, simhash.DISTANCE, simhash.ALIKE).count() > 0
    assert len(plans) == 1 and "SortMergeJoin" in plans[0] and "Broadcast" not in plans[0]
