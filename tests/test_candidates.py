import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from taskprep.functions import arrays as A
from taskprep.operators import rank
from taskprep.operators import specs as SP


def value(spark, col, schema, row):
    return spark.createDataFrame([row], schema).select(col.alias("r")).collect()[0].r


def probs(rng, n):
    x = [rng.random() for _ in range(n)]
    return [v / sum(x) for v in x]


@pytest.mark.parametrize("k", [1, 3, 8, 1000])
def test_joint_topk_is_the_head_of_the_whole_product(spark, k):
    rng = random.Random(k)
    rows = []
    for i in range(30):
        na, nb = rng.randint(0, 5), rng.randint(0, 4)
        first = probs(rng, na) if i % 3 else [0.5] * na  # ties
        second = [probs(rng, nb) if i % 3 else [0.25] * nb for _ in range(na)]
        third = [[probs(rng, rng.randint(0, 5)) if i % 3 else [0.5, 0.5] for _ in range(nb)] for _ in range(na)]
        rows.append((i, first, second, third))
    df = spark.createDataFrame(rows, "i int, f array<double>, s array<array<double>>, t array<array<array<double>>>")
    got = {r.i: [tuple(x) for x in r.x] for r in df.select("i", A.joint_topk("f", "s", "t", k).alias("x")).collect()}
    for i, f, s, t in rows:
        every = [(f[a] * s[a][b] * p, a, b, c) for a in range(len(f)) for b in range(len(s[a])) for c, p in enumerate(t[a][b])]
        assert got[i] == sorted(every, key=lambda x: (-x[0], x[1:]))[:k]


@pytest.mark.parametrize("shape", [(7,), (3, 4), (2, 3, 4), (2, 1, 3, 2)])
def test_topk_multi(spark, shape):
    rng = random.Random(len(shape))
    scores = [float(rng.randint(0, 5)) for _ in range(math.prod(shape))]
    ids = [rng.sample(range(100), n) if d % 2 == 0 else None for d, n in enumerate(shape)]
    cells = sorted(enumerate(itertools.product(*map(range, shape))), key=lambda x: (-scores[x[0]], x[0]))[:5]
    want = [([ids[d][c] if ids[d] else c for d, c in enumerate(at)], scores[i]) for i, at in cells]
    col = A.topk_multi("v", shape, 5, [F.array(*map(F.lit, x)) if x else None for x in ids])
    assert [(list(x.at), x.score) for x in value(spark, col, "v array<double>", (scores,))] == want


def cross_entropy(row, gold):
    return math.log(sum(math.exp(x) for x in row)) - row[gold]


def test_losses(spark):
    rng = random.Random(2)
    scores = [[rng.uniform(-3, 3) for _ in range(6)] for _ in range(5)]
    run = lambda col, gold: value(spark, col, "s array<array<double>>, g array<int>", (scores, gold))
    gold = [3, 0, 2]
    assert run(A.mean_loss("s", "g"), gold) == pytest.approx(sum(cross_entropy(scores[i], g) for i, g in enumerate(gold)) / 3)
    assert run(A.mean_loss("s", "g", 4), gold) == pytest.approx(sum(cross_entropy(scores[i][:4], g) for i, g in enumerate(gold)) / 3)
    assert run(A.mean_loss("s", "g"), []) == 0.0
    assert run(A.pointer_loss("s", "g"), gold) == pytest.approx((cross_entropy(scores[0], 0) + cross_entropy(scores[1], 2)) / 2)
    assert run(A.pointer_loss("s", "g"), [3]) == 0.0
    spans = F.array(F.struct(F.lit(1).alias("st"), F.lit(2).alias("ed")))
    both = cross_entropy(scores[0], 1) + cross_entropy(scores[0], 2)
    assert run(A.span_loss("s", "s", spans), gold) == pytest.approx(both)
    assert run(A.span_loss("s", "s", spans, average=True), gold) == pytest.approx(both / 2)


def test_best_legal_select(spark):
    rng = random.Random(3)
    for types in (["text", "real", "text"], ["text"] * 3):
        pc, pa = probs(rng, 3), [0.1, 0.4, 0.2, 0.1, 0.1, 0.1]
        ranked = sorted((-(p * q), c, a) for c, p in enumerate(pc) for a, q in enumerate(pa))
        legal = [x for x in ranked if types[x[1]] != "text" or x[2] in (0, 3)]
        r = value(spark, rank.best_legal_select("pc", "pa", "t"), "pc array<double>, pa array<double>, t array<string>", (pc, pa, types))
        assert (-r.prob, r.sel, r.agg) == legal[0]
    none = value(spark, rank.best_legal_select("pc", "pa", "t"), "pc array<double>, pa array<double>, t array<string>", ([0.5], [0.0, 1.0, 0.5, 0.0][1:2], ["text"]))
    assert (none.sel, none.agg, none.legal) == (0, 0, True)


@pytest.fixture(scope="module")
def table(spark):
    rows = [("1", "a b"), ("5", "zz"), ("x", None), (None, "m")]
    tables = spark.createDataFrame([("t", ["n", "s"], ["real", "text"], [list(r) for r in rows])], "id string, header array<string>, types array<string>, rows array<array<string>>")
    cells, meta = SP.to_cells(tables)
    name = meta.first().table_id
    return cells, meta, name


CANDS = "qid int, spec_id string, score double, table_id string, sel int, agg int, conds array<struct<col:int,op:int,val:string>>"


def test_lone_ranges_against_rows(spark, table):
    cells, meta, name = table
    conds = [(c, o, v) for c in (0, 1) for o in (1, 2) for v in ("0", "1", "4", "5", "6", "a", "a b", "zz", "zzz", "y")]
    one = [(i, f"one{i}", 0.0, name, 1, 0, [c]) for i, c in enumerate(conds)]
    two = [(i, f"two{i}", 0.0, name, 1, 0, [c, c]) for i, c in enumerate(conds)]  # the same, by rows
    kept = {r.spec_id for r in SP.keep_executable(spark.createDataFrame(one + two, CANDS), cells, meta).collect()}
    assert {x for x in kept if x.startswith("one")} == {x.replace("two", "one") for x in kept if x.startswith("two")}
    assert 5 < len(kept) < len(one) + len(two)


def test_unfinished_candidates_stay(spark, table):
    cells, meta, name = table
    rows = [(1, "nothing", 9.0, name, None, None, []), (1, "no column", 8.0, name, None, 2, []), (1, "no aggregate", 7.0, name, 0, None, [(0, 0, "99")]),
            (1, "no row", 6.0, name, 0, 0, [(0, 0, "99")]), (1, "good", 5.0, name, 0, 0, [(0, 0, "5")]), (1, "again", 4.0, name, 0, 0, [(0, 0, "5")]), (1, "cut", 1.0, name, 1, 0, []),
            (2, "bad operator", 5.0, name, 0, 0, [(0, 3, "5")])]
    got = rank.prune_candidates(spark.createDataFrame(rows, CANDS), cells, meta, beam=4).orderBy("qid", "beam_rank").collect()
    assert [r.spec_id for r in got] == ["nothing", "no column", "no aggregate", "good", None, None, None, None]
    assert got[-1].score == rank.JUNK_SCORE


def test_condition_candidates(spark):
    rows = [(1, [0.9, 0.1], [[0.5, 0.5], [0.9, 0.1]], [[5.0, 0.0, 0.0], [0.0, 0.0, 9.0]], [[0.0, 9.0, 0.0], [9.0, 0.0, 0.0]], ["u", "v", "w"])]
    df = spark.createDataFrame(rows, "qid int, c array<double>, o array<array<double>>, s array<array<double>>, e array<array<double>>, w array<string>")
    got = rank.condition_candidates(df, "c", "o", "s", "e", "w", 4).orderBy("cand_no").collect()
    assert [tuple(r.cond) for r in got[:2]] == [(0, 1, ""), (0, 0, "u v")] and [r.cand_no for r in got] == [0, 1, 2, 3]
    assert [r.prob for r in got] == sorted((r.prob for r in got), reverse=True)


def test_lone_equalities_meet_values_not_rows(spark, monkeypatch):
    """Specs that ask for a frequent value are kept without a row a match."""
    from taskprep.operators import specs as SP
    rows = [[str(i % 4), "a" if i % 2 else None] for i in range(120)]
    cells, meta = SP.to_cells(spark.createDataFrame([("t", ["n", "s"], ["real", "text"], rows)], "id string, header array<string>, types array<string>, rows array<array<string>>"))
    specs = [(0, f"s{i}", 0.0, "table_t", i % 2, 0, [c]) for i, c in enumerate([(0, 0, "3"), (0, 0, "9"), (1, 0, "A"), (1, 0, "b"), (0, 0, "x")] * 40)]
    written, cut = [], SP.cut_lineage

    def seen(x):
        out = cut(x)
        written.append(out.count())
        return out

    monkeypatch.setattr(SP, "cut_lineage", seen)
    kept = {r.spec_id for r in SP.keep_executable(spark.createDataFrame(specs, CANDS), cells, meta).collect()}
    assert kept == {s[1] for i, s in enumerate(specs) if i % 5 in (0, 2)}
    assert max(written, default=0) <= len(specs)


def test_a_shared_candidate_is_dealt_over_salts(spark, table):
    """Every question asks for the same spec: all keep it, and their rows don't meet it under one key."""
    cells, meta, name = table
    rows = [(i, f"s{i}", 1.0, name, 0, 0, [(0, 0, "5")]) for i in range(300)] + [(i, f"t{i}", 2.0, name, 0, 0, [(0, 0, "99")]) for i in range(300)] + [(None, "u", 1.0, name, 0, 0, [(0, 0, "5")])]
    pruned = rank.prune_candidates(spark.createDataFrame(rows, CANDS), cells, meta, beam=1, pad=False)
    assert {r.spec_id for r in pruned.collect()} == {f"s{i}" for i in range(300)} | {"u"}
    assert "__salt" in pruned._jdf.queryExecution().optimizedPlan().toString()
