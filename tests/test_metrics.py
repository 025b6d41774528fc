import pytest

from taskprep.operators import metrics


def _refs_preds(spark, refs, preds):
    r = spark.createDataFrame(refs, "id string, ref_no int, answer_text string")
    p = spark.createDataFrame(preds, "id string, pos int, prediction_text string")
    return r, p


def test_em_f1_edges(spark):
    refs = [("both_empty", 0, "the"), ("rep", 0, "y y y w"), ("none", 0, "alpha"),
            ("multi", 0, "red car"), ("multi", 1, "a red car today"), ("unanswered", 0, "x")]
    preds = [("both_empty", 0, "a an"), ("rep", 0, "x y y z"), ("none", 0, "beta"),
             ("multi", 0, "wrong"), ("multi", 1, "Red car!")]  # last prediction of 'multi' wins
    r, p = _refs_preds(spark, refs, preds)
    ex = {row.id: (row.exact_match, row.f1) for row in metrics.qa_example_scores(r, p, "id").collect()}
    assert ex["both_empty"] == (1.0, 0.0)
    assert ex["rep"][0] == 0.0 and ex["rep"][1] == pytest.approx(0.5)
    assert ex["none"] == (0.0, 0.0)
    assert ex["multi"][0] == 1.0 and ex["multi"][1] == pytest.approx(1.0)
    assert ex["unanswered"] == (0.0, 0.0)
    tot = metrics.qa_scores(r, p, "id").collect()[0]
    assert tot.total == 5
    assert tot.exact_match == pytest.approx(100.0 * 2 / 5)
    assert tot.f1 == pytest.approx(100.0 * 1.5 / 5)


def test_batch_mean_accuracy_short_last_batch(spark):
    # batches of 2: [1, 1], [0, 1], [1]  -> per-batch 1, 0.5, 1 -> 0.8333; per-row 4/5
    rows = [(0, 0, 1, 1), (1, 0, 1, 1), (2, 1, 0, 1), (3, 1, 1, 1), (4, 2, 1, 1)]
    df = spark.createDataFrame(rows, "pos int, batch int, pred int, label int")
    b = metrics.batch_mean_accuracy(df, "batch", "pred", "label").collect()[0]
    assert b.accuracy == pytest.approx(2.5 / 3)
    assert metrics.accuracy(df, "pred", "label").collect()[0].accuracy == pytest.approx(0.8)


def test_recorded_log_stage_averages(spark):
    """Task accuracies at the end of each stage of a recorded run, and the recorded averages."""
    import os
    from pyspark.sql import functions as F
    path = os.path.join(os.path.dirname(os.path.abspath(__file__)), "data", "stage_log.csv")
    log = spark.read.schema("stage int, task int, test_acc double, stage_average double").csv(path, header=True)
    recorded = {r.stage: r.a for r in log.groupBy("stage").agg(F.first("stage_average").alias("a")).collect()}
    got = {r.stage: r.avg_acc for r in metrics.stage_average(log.select("stage", "task", "test_acc")).collect()}
    assert len(recorded) == 16 and recorded[15] == pytest.approx(91.890625) and recorded[0] == pytest.approx(94.0)
    for k, v in recorded.items():
        assert got[k] == pytest.approx(v, abs=1e-4)
