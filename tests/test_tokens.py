from pyspark.sql import functions as F

from taskprep.functions import arrays as A
from taskprep.operators import tokens as TK
from taskprep.operators import vocab as V


def test_find_sublist(spark):
    df = spark.createDataFrame([(["a", "a"], ["a", "a", "a"]), (["x", "y", "z"], ["x", "y"])],
                               "n array<string>, h array<string>")
    assert [r[0] for r in df.select(A.find_sublist("n", "h")).collect()] == [[0, 1], []]


def test_tokenize_offsets(spark):
    df = spark.createDataFrame([(1, "Hi  there\nyou")], "id int, t string")
    toks = TK.tokenize(df, "t").collect()[0].tokens
    assert [(x.tok, x.st, x.ed) for x in toks] == [("Hi", 0, 2), ("there", 4, 9), ("you", 10, 13)]


def test_windows_and_labels(spark):
    # 10 context tokens, question of 2, max_len 9 -> room 4, stride 2 -> starts 0, 2, 4, 6
    offs = [(i * 2, i * 2 + 1) for i in range(10)]
    df = spark.createDataFrame([(1, 2, 10, offs, 8, 11)],
                               "id int, q int, n int, offs array<struct<st:int,ed:int>>, sc int, ec int")
    w = TK.window_context(df, "q", "n", max_len=9, stride=2, offsets="offs")
    w = TK.label_spans(w, "offs", "q", "sc", "ec")
    got = [(r.ctx_start, r.ctx_len, r.start_position, r.end_position) for r in w.orderBy("window_no").collect()]
    # answer = tokens 4..5 (chars 8..11): wholly inside windows starting at 2 and 4
    assert got == [(0, 4, 0, 0), (2, 4, 6, 7), (4, 4, 4, 5), (6, 4, 0, 0)]
    # answer at the last context token of a window: start stays inside the context
    df2 = spark.createDataFrame([(1, 2, 4, offs[:4], 6, 7)],
                                "id int, q int, n int, offs array<struct<st:int,ed:int>>, sc int, ec int")
    r = TK.label_spans(TK.window_context(df2, "q", "n", max_len=9, stride=2, offsets="offs"), "offs", "q", "sc", "ec").collect()[0]
    assert (r.start_position, r.end_position) == (7, 7)
    m = TK.mask_offsets(w, "offs", "q").orderBy("window_no").collect()[0].window_offsets
    assert m[0] is None and m[4] is not None and len(m) == 2 + 4 + 3


def test_long_question_is_flagged_and_windows_hold_their_slice(spark):
    offs = [(i * 2, i * 2 + 1) for i in range(10)]
    df = spark.createDataFrame([(1, 2, 10, offs), (2, 5, 10, offs)], "id int, q int, n int, offs array<struct<st:int,ed:int>>")
    rows = TK.window_context(df, "q", "n", max_len=9, stride=2, offsets="offs").collect()
    assert [(r.window_no, r.offs) for r in rows if r.id == 2] == [(None, None)] and all(r.window_error == (r.id == 2) for r in rows)
    assert all([o.st for o in r.offs] == [2 * i for i in range(r.ctx_start, r.ctx_start + r.ctx_len)] for r in rows if r.id == 1)


def test_lower_keeps_offsets_of_the_text(spark):
    df = spark.createDataFrame([("\u0130\u0130 ab",)], "t string")
    toks = TK.tokenize(df, "t", lower=True).collect()[0].tokens
    assert [(x.tok, x.st, x.ed) for x in toks][1] == ("ab", 3, 5)


def test_ids_and_text_of_repeated_tokens(spark):
    vocab = spark.createDataFrame([("a", 3), ("b", 4)], "token string, id int")
    df = spark.createDataFrame([(1, ["b", "zz", "a", "b"]), (2, [])], "k int, w array<string>")
    ids = TK.token_ids(df, "w", vocab, "k")
    assert {r.k: r.ids for r in ids.collect()} == {1: [4, 0, 3, 4], 2: []}
    text = TK.ids_to_text(ids.select("k", TK.encode("ids", None).alias("x")), "x", vocab, "k")
    assert {r.k: r.text for r in text.collect()} == {1: "[CLS] b [UNK] a b [SEP]", 2: "[CLS] [SEP]"}


def test_greedy_longest_prefix(spark):
    vocab = spark.createDataFrame([(t,) for t in ["un", "una", "##ff", "##able", "##a", "##b", "a", "##f"]], "token string")
    df = TK.tokenize(spark.createDataFrame([(1, "unaffable  ab zz"), (2, None)], "k int, t string"), "t")
    got = {r.k: r.pieces for r in TK.subword_tokens(df, "tokens", "k", vocab).collect()}
    assert [(p.tok, p.st, p.ed, p.word) for p in got[1]] == [
        ("una", 0, 3, 0), ("##ff", 3, 5, 0), ("##able", 5, 9, 0), ("a", 11, 12, 1), ("##b", 12, 13, 1), ("[UNK]", 14, 16, 2)]
    assert got[2] is None


def test_words_are_cut_where_they_are(spark, monkeypatch):
    """A vocabulary that a task can hold needs no shuffle of tokens; a larger one gives the same by joins."""
    vocab = spark.createDataFrame([(t,) for t in ["ab", "a", "##b", "##cd", "##c", "x" * 30, "é", "##é", None]], "token string")
    rows = [(1, "abcd ab  ba a éé xé"), (1, "ac abcd"), (None, "ab"), (None, " "), (2, ""), (3, None)]
    df = TK.tokenize(spark.createDataFrame(rows, "k int, t string"), "t")
    out = TK.subword_tokens(df, "tokens", "k", vocab, 4)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    got = sorted(map(str, out.select("k", "t", "pieces").collect()))
    monkeypatch.setattr(TK, "HELD_PIECES", 3)
    monkeypatch.setattr(TK, "KEPT_WORDS", 2)
    assert sorted(map(str, TK.subword_tokens(df, "tokens", "k", vocab, 4).select("k", "t", "pieces").collect())) == got
    monkeypatch.setattr(TK, "HELD_PIECES", 100)
    assert sorted(map(str, TK.subword_tokens(df, "tokens", "k", vocab, 4).select("k", "t", "pieces").collect())) == got


def test_malformed_pointers_are_flagged(spark):
    df = spark.createDataFrame([([("start", 0), ("op", 1), ("vst", 2), ("end", 0)],)], "p array<struct<kind:string,value:int>>")
    back = df.select(TK.pointers_to_spec("p").alias("b")).collect()[0].b
    assert back.malformed and back.conds == []


def test_vocab_first_occurrence(spark):
    toks = spark.createDataFrame(
        [(0, 0, 0, "hdr"), (1, 0, 0, "word"), (1, 0, 1, "hdr"), (1, 1, 0, "noemb"), (0, 0, 1, "word")],
        "source_no int, row_id long, pos int, token string")
    emb = spark.createDataFrame([("hdr",), ("word",)], "token string")
    v = {r.token: r.id for r in V.build_vocab(toks, emb).collect()}
    assert v == {"hdr": 3, "word": 4}


def test_encode_pad_mask(spark):
    df = spark.createDataFrame([([5, 6, 7, 8],)], "ids array<int>")
    r = df.select(A.pad(TK.encode("ids", 5), 7).alias("x")).collect()[0].x
    assert r == [1, 5, 6, 7, 2, 0, 0]
    assert df.select(A.attention_mask(F.array(F.lit(3), F.lit(0)))).collect()[0][0] == [1, 0]


def test_pointer_roundtrip(spark):
    spec = {"sel": 2, "agg": 3, "conds": [{"col": 1, "op": 0, "st": 4, "ed": 6}, {"col": 0, "op": 2, "st": 1, "ed": 2}]}
    df = spark.createDataFrame([(spec,)], "s struct<sel:int,agg:int,conds:array<struct<col:int,op:int,st:int,ed:int>>>")
    p = df.select(TK.spec_to_pointers("s").alias("p"))
    back = p.select(TK.pointers_to_spec("p").alias("b")).collect()[0].b
    assert back.sel == 2 and back.agg == 3
    assert [(c.col, c.op, c.st, c.ed) for c in back.conds] == [(1, 0, 4, 6), (0, 2, 1, 2)]


def test_detokenize(spark):
    rows = [(["New", "York"], "Who lives in New York?"), (["3", "%"], "rate of 3% or more"),
            (["``", "hi", "''"], 'he said "hi" twice'), (["a", "b"], "zzz"), (["$", "5"], "zzz"),
            (["-LRB-", "x"], "zzz")]
    df = spark.createDataFrame(rows, "t array<string>, q string")
    assert [r[0] for r in df.select(TK.detokenize("t", "q")).collect()] == [
        "new york", "3%", '"hi"', "a b", "$5", "-lrb- x"]


def test_condition_values(spark):
    q = ["SELECT", "col", "WHERE", "a", "EQL", "new", "york", "AND", "b", "GT", "5"]
    df = spark.createDataFrame([(q, ["who", "new", "york", "is", "5"])], "q array<string>, n array<string>")
    r = df.select(TK.condition_values("q", "n")).collect()[0][0]
    assert [(c.op, c.value, c.pos) for c in r] == [("EQL", ["new", "york"], 1), ("GT", ["5"], 4)]
    odd = spark.createDataFrame([(["WHERE", "a", "EQL", "GT", "x", "AND", "b", "c"], ["x"])], "q array<string>, n array<string>")
    r = odd.select(TK.condition_values("q", "n")).collect()[0][0]
    assert [(c.op, c.value, c.pos) for c in r] == [("EQL", ["GT", "x"], -1), (None, [], -1)]


def test_long_rows_are_mapped_once_a_token(spark):
    """A row of many distinct tokens is looked up in sorted entries; rows without key, tokens or known words keep their cases."""
    import time
    n = 30_000
    vocab = spark.createDataFrame([(f"t{i}", i + 3) for i in range(0, n, 2)], "token string, id int")
    rows = [(1, [f"t{i}" for i in range(n)]), (2, None), (3, []), (4, ["none", None, "t0"]), (5, ["t2", "t2"]), (5, ["t4"])]
    df = spark.createDataFrame(rows, "k int, w array<string>")
    took = time.time()
    ids = sorted(TK.token_ids(df, "w", vocab, "k").select("k", "ids").collect())
    took = time.time() - took
    assert ids[0].ids == [i + 3 if i % 2 == 0 else 0 for i in range(n)]
    assert [tuple(r) for r in ids[1:]] == [(2, []), (3, []), (4, [0, 0, 3]), (5, [5, 5]), (5, [7])]
    text = TK.ids_to_text(spark.createDataFrame([(1, [1, 3, 98, 2]), (2, None)], "k int, x array<int>"), "x", vocab, "k")
    assert {r.k: r.text for r in text.collect()} == {1: "[CLS] t0 [UNK] [SEP]", 2: None}
    assert took < 60


def test_tokenize_in_portions(spark, monkeypatch):
    """Batches are cut by their text, so a task holds the lists of a bounded portion."""
    import numpy as np
    import pyarrow as pa
    batch = pa.RecordBatch.from_pydict({"a": [3, 4, 5, 6]})
    assert [p.num_rows for p in TK._portions(batch, np.array([5, 6, 20, 1]), 10)] == [2, 1, 1]
    rows = [(i, None if i % 5 == 4 else " ".join(["Ab"] * (i % 7))) for i in range(40)]
    monkeypatch.setattr(TK, "BATCH_ITEMS", 8)
    df = TK.tokenize(spark.createDataFrame(rows, "k int, t string").coalesce(1), "t", "x", lower=True)
    got = {r.k: r.x for r in df.collect()}
    assert all(got[k] is None if t is None else [(x.tok, x.st, x.ed) for x in got[k]] == [("ab", 3 * j, 3 * j + 2) for j in range(k % 7)] for k, t in rows)


def test_a_large_vocabulary_is_not_repeated_for_few_rows(spark):
    """Rows of few tokens move each vocabulary word at most once, not once a salt."""
    vocab = spark.range(50_000).selectExpr("concat('w', id) AS token", "cast(id + 3 AS int) AS id")
    df = spark.createDataFrame([(i, ["w1", f"w{i}", "none", "w1"]) for i in range(40)] + [(40, []), (41, None)], "k int, t array<string>")
    got = {r.k: r.ids for r in TK.token_ids(df, "t", vocab, "k").collect()}
    assert got == {**{i: [4, i + 3, 0, 4] for i in range(40)}, 40: [], 41: []}
    plan = TK.token_ids(df, "t", vocab, "k")._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(sequence" not in plan and "explode([0" not in plan
