import random
import time

import pytest
from pyspark.sql import functions as F

from taskprep.operators import packed as PK
from taskprep.operators import tokens as TK


def one(spark, col, **cols):
    names = list(cols)
    schema = ", ".join(f"{n} {t}" for n, (t, _) in cols.items())
    return spark.createDataFrame([tuple(cols[n][1] for n in names)], schema).select(col.alias("r")).collect()[0].r


LISTS = "array<array<string>>"


def packed(spark, q, h, v=None, aligned=False):
    return one(spark, PK.pack_input("q", "h", "v" if v is not None else None, aligned), q=("array<string>", q), h=(LISTS, h), v=(LISTS, v or []))


def test_layout_without_vocabulary(spark):
    r = packed(spark, ["how", "many"], [["a"], ["b", "c"]])
    assert r.tokens == ["[CLS]", "how", "many", "[SEP]", "a", "[SEP]", "b", "c", "[SEP]"]
    assert r.segment_ids == [0, 0, 0, 0, 1, 0, 1, 1, 1]
    assert [tuple(b) for b in r.borders] == [(1, 0, 1, 3), (2, 0, 4, 5), (2, 1, 6, 8)]


def test_layout_with_vocabulary(spark):
    r = packed(spark, ["q"], [["h"]], [["x", "y"], ["z"]])
    assert r.tokens == ["[CLS]", "x", "y", "[SEP]", "z", "[SEP]", "q", "[SEP]", "h", "[SEP]"]
    assert r.segment_ids == [1, 1, 0, 1, 1, 0, 0, 0, 1, 1]
    assert packed(spark, ["q"], [["h"]], [["x", "y"], ["z"]], aligned=True).segment_ids == [0, 1, 1, 0, 1, 1, 0, 0, 1, 1]


def test_nothing_to_pack(spark):
    r = packed(spark, None, None)
    assert r.tokens == ["[CLS]", "[SEP]"] and len(r.segment_ids) == 2 and [tuple(b) for b in r.borders] == [(1, 0, 1, 1)]


def test_every_position_is_located(spark):
    rng = random.Random(1)
    for _ in range(8):
        lists = lambda n: [["t"] * rng.randint(0, 4) for _ in range(rng.randint(0, n))]
        r = packed(spark, ["t"] * rng.randint(0, 9), lists(6), lists(9))
        borders = [tuple(b) for b in r.borders]
        points = list(range(-2, len(r.tokens) + 3)) + [None]
        got = spark.createDataFrame([(p, borders) for p in points], "p int, b array<struct<`group`:int,member:int,st:int,ed:int>>").select("p", PK.locate("p", "b").alias("x")).collect()
        for row in got:
            want = [(g, m) for g, m, st, ed in borders if row.p is not None and st <= row.p < ed]
            assert tuple(row.x) == (want[0] if want else (-1, -1))


@pytest.mark.parametrize("sep", [0, 1, 3])
def test_running_starts(spark, sep):
    lens = [3, 0, 0, 5, 1, 0]
    want = [sum(lens[:i]) + sep * i for i in range(len(lens))]
    assert one(spark, TK.running_starts("n", sep), n=("array<int>", lens)) == want
    assert one(spark, TK.running_starts("n", sep), n=("array<int>", [])) == []


def test_many_segments_in_linear_time(spark):
    frame = spark.range(1).select(F.array_repeat(F.array(F.lit("a"), F.lit("b")), 20_000).alias("s"))
    frame.select(TK.pack_segments("s")).collect()
    began = time.time()
    got = frame.select(TK.pack_segments("s").alias("r"), TK.subtoken_index("s").alias("i")).collect()[0]
    assert time.time() - began < 5  # a re-summed prefix an element takes minutes
    assert tuple(got.r[-1]) == (59_997, 59_999) and got.i.word_start[-1] == 39_998


HEADER = ["name", "home town", "age"]
WORDS = ["who", "lives", "in", "new", "york", "(", "ny", ")", "at", "40"]
QUESTION = "who lives in new york (ny) at 40"
SPEC = {"sel": 0, "agg": 3, "conds": [(1, 0, 3, 7), (2, 1, 9, 9)]}


def read(spark, change=lambda p, at: p, pool="start"):
    frame = spark.createDataFrame([(SPEC["sel"], SPEC["agg"], SPEC["conds"])], "sel int, agg int, conds array<struct<col:int,op:int,st:int,ed:int>>")
    frame = frame.select(F.struct("sel", "agg", "conds").alias("s"), F.array(*map(F.lit, WORDS)).alias("words"), F.array(*map(F.lit, HEADER)).alias("header"), F.lit(QUESTION).alias("question"))
    frame = frame.withColumn("p", PK.pack_input("words", F.transform("header", lambda h: F.split(h, " ")), PK.vocabulary_tokens())).select("*", "p.*")
    r = frame.select("tokens", "borders", PK.spec_positions("s", "borders", pool).alias("points")).collect()[0]
    if pool != "start":
        return r
    at = {(b.group, b.member): b.st for b in r.borders}
    frame = frame.withColumn("points", F.lit(change(list(r.points), at)).cast("array<int>")).withColumn("of", F.sequence(F.lit(0), F.size("words") - 1))
    return frame.select(PK.specs_from_positions("points", "tokens", "borders", "header", "words", "of", "question").alias("b")).collect()[0].b


def test_round_trip(spark):
    b = read(spark)
    assert (b.sel, b.agg, [tuple(c) for c in b.conds]) == (0, 3, [(1, 0, "new york (ny)"), (2, 1, "40")])
    assert b.query == "select (name) where home town = new york (ny) and age > 40"


def test_ends_are_one_past_the_last_token(spark):
    end, avg = (read(spark, pool=p).points for p in ("end", "avg"))
    values = {7, 8, 12, 13}
    assert [e if i in values else e - 1 for i, e in enumerate(end)] == [p[-1] for p in avg]


def test_pools_name_members(spark):
    r = read(spark, pool="avg")
    named = [" ".join(r.tokens[i] for i in p) for p in r.points]
    assert named == ["start", "select", "count", "name", "where", "home town", "equal", "new", ")", "and", "age", "greater than", "40", "40", "end"]


@pytest.mark.parametrize("change, sel, agg, conds", [
    (lambda p, at: [], None, None, []),
    (lambda p, at: [None, -5, 10_000, 0] + p, 0, 3, 2),
    (lambda p, at: p[:8], 0, 3, []),  # no value end
    (lambda p, at: p[:6] + p[7:], 0, 3, [(2, 1, "40")]),  # no operator
    (lambda p, at: p[:5] + p[6:], 0, 3, [(2, 1, "40")]),  # no column
    (lambda p, at: p[:2] + p[3:], None, None, 2),  # no aggregate: its header opens a condition that is never completed
    (lambda p, at: p[:7] + [at[(0, 10)]] + p[7:], 0, 3, 2),  # a second operator
    (lambda p, at: p[:9] + [at[(0, 9)]] + p[7:9] + p[9:], 0, 3, 2),  # a value without a column
    (lambda p, at: p[:8] + [p[7] - 1] + p[9:], 0, 3, [(1, 0, ""), (2, 1, "40")]),  # the end before the start
    (lambda p, at: p[:4] + [at[(0, 1)], at[(2, 2)]] + p[4:], 2, 1, 2),  # the last aggregate and its header count
])
def test_damaged_lists(spark, change, sel, agg, conds):
    b = read(spark, change)
    full = [(1, 0, "new york (ny)"), (2, 1, "40")]
    assert (b.sel, b.agg, [tuple(c) for c in b.conds]) == (sel, agg, full if conds == 2 else conds)


def test_all_positions_at_once(spark):
    """``locate_all`` is ``locate`` position by position, on empty members, gaps and no borders too."""
    rng = random.Random(2)
    kind = "array<struct<`group`:int,member:int,st:int,ed:int>>"
    rows = [([], [0, None, -1]), (None, [3]), ([(1, 0, 2, 4), (2, 0, 4, 4), (2, 1, 9, 12)], None)]
    for _ in range(6):
        st, b = rng.randint(0, 2), []
        for i in range(rng.randint(1, 6)):
            ed = st + rng.randint(0, 4)
            b.append((rng.randint(0, 2), i, st, ed))
            st = ed + rng.randint(0, 3)
        rows.append((b, [*range(-2, st + 3), None]))
    got = spark.createDataFrame(rows, f"b {kind}, p array<int>").select(PK.locate_all("p", "b").alias("x"), F.transform("p", lambda p: PK.locate(p, "b")).alias("y")).collect()
    assert all(r.x == r.y for r in got) and any(r.x for r in got)


@pytest.mark.parametrize("aligned", [False, True])
def test_fixed_vocabulary_packs_like_a_column(spark, aligned):
    v = [["x", "y"], ["z"], []]
    frame = spark.createDataFrame([(["q", "r"], [["h"], [], ["i", "j"]], v), (None, None, v), ([], [["h"]], v)], f"q array<string>, h {LISTS}, v {LISTS}")
    got = frame.select(PK.pack_input("q", "h", v, aligned).alias("x"), PK.pack_input("q", "h", "v", aligned).alias("y")).collect()
    assert all(r.x == r.y for r in got) and got[0].x.segment_ids[-1] == 1


def test_a_long_input_is_located_in_linear_work(spark):
    frame = spark.range(1).select(PK.pack_input(F.array_repeat(F.lit("t"), 200_000), F.array_repeat(F.array(F.lit("h")), 2_000)).alias("p"))
    where = PK.locate_all(F.sequence(F.lit(0), F.size("p.tokens") - 1), "p.borders")
    began = time.time()
    got = frame.select(F.size(F.filter(where, lambda x: x["group"] == PK.QUESTION_GROUP)).alias("n")).collect()[0].n
    assert got == 200_000 and time.time() - began < 20
