import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from taskprep.operators import clean
from taskprep.sources import readers, sinks


@pytest.fixture()
def tmp():
    return tempfile.mkdtemp(prefix="taskprep-io-", dir="/tmp")


def test_reviews_and_lines(spark, tmp):
    p = os.path.join(tmp, "yahoo.csv")
    with open(p, "w") as f:
        f.write('1,"t","multi\nline ""q""","ans"\n2,"t2",,"a2"\n')
    df = readers.read_reviews(spark, p, "yahoo")
    rows = df.orderBy("labels").collect()
    assert rows[0].content == 'multi\nline "q"' and rows[1].content is None
    assert clean.drop_missing(df, ["content", "answer"]).count() == 1
    p2 = os.path.join(tmp, "a.train")
    with open(p2, "w") as f:
        f.write("1\tgood one\n0\tbad\tthing\n")
    lines = readers.read_labelled_lines(spark, p2).orderBy("label").collect()
    assert [(r.label, r.text) for r in lines] == [(0, "bad"), (1, "good one\n")]


def test_csv_splits_and_dispatch(spark, tmp):
    tr, va = os.path.join(tmp, "train.csv"), os.path.join(tmp, "val.json")
    with open(tr, "w") as f:
        f.write("sentence,label\nhello,1\nNA,0\n")
    with open(va, "w") as f:
        f.write(json.dumps({"sentence": "x", "label": 1}) + "\n")
    df = readers.read_csv_splits(spark, {"train": tr}, na_values=["NA"], schema="sentence string, label int")
    assert df.filter(F.col("sentence").isNull()).count() == 1 and set(df.columns) == {"sentence", "label", "split"}
    both = readers.load_splits(spark, {"train": tr, "validation": va})
    assert both.groupBy("split").count().count() == 2
    with pytest.raises(ValueError):
        readers.load_splits(spark, {"train": os.path.join(tmp, "x.txt")})
    assert clean.resolve_columns(["label", "sentence"]) == ("sentence", None)
    assert clean.resolve_columns(["a", "b", "label"]) == ("a", "b")
    assert clean.resolve_columns(["sentence", "extra", "label"]) == ("sentence", "extra")
    assert clean.resolve_columns(["x", "sentence2", "sentence1", "label"]) == ("sentence1", "sentence2")
    assert clean.resolve_columns(["x", "question"], task="qnli") == ("question", "sentence")
    assert clean.select_model_columns(df, ["sentence"]).columns == ["sentence", "label"]


def test_qa_json_and_predictions(spark, tmp):
    doc = {"version": "1.1", "data": [{"title": None, "paragraphs": [{"context": "  ctx here ", "qas": [
        {"id": "q1", "question": " what? ", "answers": [{"text": " ctx ", "answer_start": 2}]}]}]}]}
    p = os.path.join(tmp, "qa.json")
    with open(p, "w") as f:
        json.dump(doc, f)
    flat = readers.read_qa_json(spark, p).collect()[0]
    assert (flat.id, flat.title, flat.context, flat.question) == ("q1", "", "ctx here", "what?")
    assert flat.answers.text == ["ctx"] and flat.answers.answer_start == [2]
    pp = os.path.join(tmp, "pred.json")
    with open(pp, "w") as f:
        json.dump({"q1": "ctx", "q2": "x"}, f)
    ex, preds, ok = readers.read_predictions(spark, p, pp)
    assert ok and preds.count() == 2


def test_questions_tables(spark, tmp):
    q = os.path.join(tmp, "q.jsonl")
    with open(q, "w") as f:
        f.write(json.dumps({"table_id": "1-2", "question": "how many?",
                            "sql": {"sel": 1, "agg": 3, "conds": [[0, 0, "x"], [1, 1, 5.5]]}}) + "\n")
    t = os.path.join(tmp, "t.jsonl")
    with open(t, "w") as f:
        f.write(json.dumps({"id": "1-2", "header": ["a", "b"], "types": ["text", "real"],
                            "rows": [["x", "1"], ["y", "7"]]}) + "\n")
    qs = readers.read_questions(spark, q).collect()[0]
    assert [(c.col, c.op, c.val) for c in qs.sql.conds] == [(0, 0, "x"), (1, 1, "5.5")]
    assert readers.read_tables(spark, t).collect()[0].rows == [["x", "1"], ["y", "7"]]


def test_sinks(spark, tmp):
    df = spark.createDataFrame([("q1", "t1", False, "SELECT 1"), ("q2", "t2", True, "SELECT 2")],
                               "nlu string, table_id string, unmappable boolean, query string")
    out = os.path.join(tmp, "res")
    sinks.write_results(df, out)
    recs = sorted((json.loads(l) for fn in os.listdir(out) if fn.endswith(".json")
                   for l in open(os.path.join(out, fn))), key=lambda r: r["nlu"])
    assert recs[0] == {"nlu": "q1", "table_id": "t1", "query": "SELECT 1"}
    assert recs[1] == {"nlu": "q2", "table_id": "t2", "error": "Skip happened"}
    log = os.path.join(tmp, "log")
    a = spark.createDataFrame([(3.0, 1.0, 0.9, 0.2)], "epoch double, task_num double, test_acc double, test_loss double")
    sinks.append_metrics(sinks.union_log([a]), log)
    b = spark.createDataFrame([(0.0, 90.0)], "task double, avg_acc double")
    merged = sinks.append_metrics(b, log, resume=True)
    assert merged.count() == 2 and set(merged.columns) == set(sinks.LOG_COLUMNS)
    preds = spark.createDataFrame([(0, 1.23456), (1, 2.0)], "i int, p double")
    assert [r.value for r in sinks.prediction_lines(preds, "i", "p", regression=True).orderBy("i").collect()] == [
        "0\t1.235", "1\t2.000"]
    rep = spark.createDataFrame([("b", 2.0), ("a", 1.0)], "key string, value double")
    assert [r.value for r in sinks.report_lines(rep).collect()] == ["a = 1.0", "b = 2.0"]


def test_qa_outputs_with_prefix(spark, tmp):
    best = spark.createDataFrame([("e1", "abc")], "example_id string, prediction_text string")
    nb = spark.createDataFrame([("e1", 1, "x", 0.2, 0.1, 0.1), ("e1", 0, "abc", 0.8, 1.0, 2.0)],
                               "example_id string, rank int, text string, probability double, start_logit double, "
                               "end_logit double")
    odds = spark.createDataFrame([("e1", -1.5)], "example_id string, score_diff double")
    sinks.write_qa_outputs(best, nb, tmp, null_odds=odds, prefix="eval")
    names = sorted(os.listdir(tmp))
    assert names == ["nbest_predictions_eval", "null_odds_eval", "predictions_eval"]
    rec = [json.loads(l) for fn in os.listdir(os.path.join(tmp, "nbest_predictions_eval")) if fn.endswith(".json")
           for l in open(os.path.join(tmp, "nbest_predictions_eval", fn))][0]
    assert [e["text"] for e in rec["nbest"]] == ["abc", "x"]


def test_nested_export_keeps_tables_without_questions(spark):
    tables = spark.createDataFrame([("t1", ["a", "b"]), ("t2", ["c"])], "id string, header array<string>")
    qs = spark.createDataFrame([("t1", 5, "second?", []), ("t1", 2, "first?", [])],
                               "table_id string, pos long, question string, "
                               "answers array<struct<text:string,answer_start:int>>")
    out = {r.title: r for r in sinks.to_nested_qa(qs, tables).collect()}
    t1 = out["t1"].paragraphs[0]
    assert t1.context == "a b" and [(q.id, q.question) for q in t1.qas] == [("t1-0", "first?"), ("t1-1", "second?")]
    assert out["t2"].paragraphs[0].qas == [] and out["t2"].version == "1.1"


def log_rows(spark, epochs):
    return spark.createDataFrame([(float(e), 1.0, 0.5, 0.2) for e in epochs], "epoch double, task_num double, test_acc double, test_loss double")


@pytest.mark.parametrize("step", ["write", "manifest", "after"])
def test_a_failed_append_leaves_a_whole_log(spark, tmp, monkeypatch, step):
    log = os.path.join(tmp, "log")
    sinks.append_metrics(log_rows(spark, [1, 2]), log)
    swap = sinks._swap_manifest

    def broken(*a):
        if step == "after":
            swap(*a)
        raise RuntimeError("lost")

    monkeypatch.setattr(sinks, "_swap_manifest", broken)
    bad = log_rows(spark, [3])
    if step == "write":
        bad = bad.withColumn("epoch", F.raise_error(F.lit("lost")).cast("double"))
    with pytest.raises(Exception, match="lost"):
        sinks.append_metrics(bad, log, resume=True)
    monkeypatch.undo()
    assert sorted(r.epoch for r in sinks.read_log(spark, log).collect()) == ([1.0, 2.0, 3.0] if step == "after" else [1.0, 2.0])
    sinks.append_metrics(log_rows(spark, [4]), log, resume=True)
    assert [r.epoch for r in sinks.read_log(spark, log).orderBy("epoch").collect()][-1] == 4.0


def test_published_outputs_change_together(spark, tmp):
    with pytest.raises(FileNotFoundError):
        sinks.read_log(spark, tmp)
    nb = spark.createDataFrame([("e1", 0, "a", 1.0, 0.0, 0.0)], "example_id string, rank int, text string, probability double, start_logit double, end_logit double")
    at = None
    for text in ("one", "two", "three"):
        best = spark.createDataFrame([("e1", text)], "example_id string, prediction_text string")
        sinks.write_qa_outputs(best, nb, tmp, versioned=True)
        before, at = at, sinks.current_version(spark, tmp)
        assert spark.read.json(f"{at}/predictions").first().prediction_text == text and os.path.isdir(f"{at}/nbest_predictions")
    assert os.path.isdir(before)  # the last one stays for readers that have begun
    assert len([n for n in os.listdir(tmp) if n.startswith("version-")]) == 2


def test_csv_options(spark, tmp):
    path = os.path.join(tmp, "eu.csv")
    with open(path, "w") as f:
        f.write('made by a tool\n"over\ntwo lines"\nname;x\na;1,5\nb;2\nc;x;y;z\n')
    read = lambda **o: readers.read_csv_splits(spark, {"train": path}, sep=";", schema="name string, x double", decimal=",", skip=2, **o)
    assert [(r.name, r.x) for r in read(bad_rows="skip").orderBy("name").collect()] == [("a", 1.5), ("b", 2.0)]
    assert read(names=["n", "v"], bad_rows="skip").columns == ["n", "v", "split"]
    with pytest.raises(Exception):
        read(bad_rows="error").collect()
    with pytest.raises(ValueError):
        readers.read_csv_splits(spark, {"train": path}, skip=1)
    plain = os.path.join(tmp, "p.csv")
    with open(plain, "w") as f:
        f.write("a,1\nb,2,3\n")
    rows = readers.read_csv_splits(spark, {"t": plain}, header=False, schema="n string, i int", names=["s", "i"], bad_rows="skip").collect()
    assert [tuple(r) for r in rows] == [("a", 1, "t")]


def test_question_folder(spark, tmp):
    for name, n in (("train_tok", 3), ("aug.train_tok", 5), ("dev_tok", 2)):
        with open(os.path.join(tmp, f"{name}.jsonl"), "w") as f:
            f.writelines(json.dumps({"table_id": f"t{i}", "question": name, "sql": {"sel": 0, "agg": 0, "conds": []}}) + "\n" for i in range(n))
        with open(os.path.join(tmp, f"{name}.tables.jsonl"), "w") as f:
            f.writelines(json.dumps({"id": f"t{i}", "header": ["a b"], "header_tok": [["a", "b"]], "types": ["text"], "rows": []}) + "\n" for i in range(n))
    with open(os.path.join(tmp, "train.tables.jsonl"), "w") as f:
        f.write(json.dumps({"id": "t0", "header": ["a b"], "types": ["text"], "rows": []}) + "\n")
    q, t, dq, dt = readers.read_train_dev(spark, tmp)
    assert (q.count(), t.count(), dq.count(), dt.count()) == (3, 3, 2, 2) and t.first().header_tok == [["a", "b"]]
    assert [r.table_id for r in readers.read_question_set(spark, tmp, augmented=True, toy=4)[0].orderBy("pos").collect()] == ["t0", "t1", "t2", "t3"]
    assert readers.read_question_set(spark, tmp, header_tokens=False)[1].first().header_tok is None


def test_published_vocabulary(spark, tmp):
    import numpy as np
    words = {f'w"{i},é': i for i in range(50)}
    with open(os.path.join(tmp, "w2i.json"), "w") as f:
        json.dump(words, f, ensure_ascii=False)
    m = np.arange(1500, dtype=np.float64).reshape(50, 30)
    np.save(os.path.join(tmp, "wemb.npy"), m)
    vocab, emb = readers.read_vocab(spark, os.path.join(tmp, "w2i.json"), os.path.join(tmp, "wemb.npy"))
    assert {r.token: r.id for r in vocab.collect()} == words
    assert all((np.array(r.vec) == m[r.id]).all() for r in emb.collect()) and emb.count() == 50
