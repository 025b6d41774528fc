from pyspark.sql import functions as F

from taskprep.functions.text import clean_text, normalize_answer, coerce_number
from taskprep.operators.clean import drop_missing, min_length, prepare_text


def _one(spark, fn, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.o for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


def test_clean_text_edge_rows(spark):
    rows = ["What???!! ok", "1.25", "2.50.1", "$5", "HTTPS://a.b/c?d=1. And", "www.x.y.com/z é",
            "a\\n\\nb", "a\\\\b", "a  b\n\nc\nd"]
    assert _one(spark, clean_text, rows) == [
        "what! ok", "1", "2.1", "$ 5", ". and", " é", "a b", "ab", "a b c\nd"]


def test_clean_text_cut_after_cleaning(spark):
    out = _one(spark, clean_text, ["x" * 1300, "A" * 5 + "  " + "b" * 1290])
    assert len(out[0]) == 1280
    assert out[1].startswith("aaaaa b") and len(out[1]) == 1280


def test_min_length_and_missing(spark):
    df = spark.createDataFrame([(1, "a" * 19), (2, "b" * 20), (3, None), (4, ""), (5, "NA"), (6, "null"),
                                (7, "None"), (8, "nan")], "id int, content string")
    kept = prepare_text(df, "content")
    assert [r.id for r in kept.collect()] == [2]
    assert drop_missing(df, ["content"]).count() == 2
    assert min_length(df.na.drop(), "content", 20).count() == 1


def test_normalize_answer(spark):
    assert _one(spark, normalize_answer, ["The an-a", "À théâtre a the", "?!.", "  Hello,   World  "]) == [
        "ana", "à théâtre", "", "hello world"]


def test_coerce_number(spark):
    assert _one(spark, coerce_number, ["1,000.5", "abc 12.5 x", "-3", "none", ".5", "nan", "Infinity", "1e3"]) == [
        1000.5, 12.5, -3.0, None, 0.5, None, None, 1000.0]
