import pytest

from taskprep.operators import spans


@pytest.fixture(scope="module")
def qa(spark):
    ex = spark.createDataFrame([("e1", "abcdefghij"), ("e2", "zzz")], "example_id string, context string")
    off = "array<struct<st:int,ed:int>>"
    ft = spark.createDataFrame(
        [(0, "e1", [0.5, 1.0, 3.0, 2.0], [0.1, 2.5, 1.0, 4.0], [None, (0, 2), (2, 5), (5, 9)]),
         (1, "e2", [1.0, 2.0], [1.0, 2.0], [None, None])],
        f"feature_id long, example_id string, start_logits array<double>, end_logits array<double>, offsets {off}")
    return ex, ft


def test_nbest_order_and_placeholder(spark, qa):
    ex, ft = qa
    nb, best = spans.nbest_spans(ex, ft, n=20, max_len=2)
    rows = nb.filter("example_id = 'e1'").orderBy("rank").collect()
    assert [r.text for r in rows] == ["cdefghi", "fghi", "cde", "ab", "abcde"]
    assert [r.score for r in rows] == [7.0, 6.0, 4.0, 3.5, 2.0]
    assert sum(r.probability for r in rows) == pytest.approx(1.0)
    e2 = nb.filter("example_id = 'e2'").collect()
    assert [(r.text, r.probability) for r in e2] == [("empty", 1.0)]
    b = {r.example_id: r.prediction_text for r in best.collect()}
    assert b == {"e1": "cdefghi", "e2": "empty"}


def test_null_mode_threshold(spark, qa):
    ex, ft = qa
    _, best = spans.nbest_spans(ex, ft, n=20, max_len=2, allow_null=True, threshold=0.0)
    b = {r.example_id: (r.prediction_text, r.score_diff) for r in best.collect()}
    assert b["e1"][0] == "cdefghi" and b["e1"][1] == pytest.approx(0.6 - 7.0)
    assert b["e2"][0] == ""
    _, best = spans.nbest_spans(ex, ft, n=20, max_len=2, allow_null=True, threshold=-7.0)
    assert {r.example_id: r.prediction_text for r in best.collect()}["e1"] == ""


def test_min_null_score_first_window_wins(spark):
    ft = spark.createDataFrame([(0, "e", [1.0], [1.0]), (1, "e", [0.5], [1.5]), (2, "e", [3.0], [0.0])],
                               "feature_id long, example_id string, start_logits array<double>, end_logits array<double>")
    r = spans.min_null_scores(ft).collect()[0]
    assert r.null_score == 2.0 and r.null_start_logit == 1.0


def test_max_context_flags(spark):
    import random
    rng = random.Random(3)
    rows = []
    for e in range(12):
        start = 0
        for w in range(rng.randint(1, 5)):
            n = rng.choice([0, 3, 7, 8, 8])
            rows.append((e, w, start, n))
            start += rng.randint(1, 6)
    df = spark.createDataFrame(rows, "example_id int, window_no int, ctx_start int, ctx_len int")
    got = {(r.example_id, r.window_no): r.max_context for r in spans.mark_max_context(df, first_position=2).collect()}
    for e, w, s, n in rows:
        flags = [False, False]
        for t in range(s, s + n):
            score = {w2: min(t - s2, s2 + n2 - 1 - t) + 0.01 * n2 for e2, w2, s2, n2 in rows if e2 == e and s2 <= t < s2 + n2}
            flags.append(min(score, key=lambda x: (-score[x], x)) == w)
        assert got[e, w] == flags
    assert len(got) == len(rows)
