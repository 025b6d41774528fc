"""Large files in many splits give the rows of the file read whole."""

import json
import os
import random
import tempfile

import pytest

from taskprep.sources import readers
from taskprep.sources.splittable import JsonElements, JsonMembers, QuotedLines, read_records


@pytest.fixture()
def tmp():
    return tempfile.mkdtemp(prefix="taskprep-io-", dir="/tmp")


@pytest.fixture(params=[300, 1 << 27])
def split_bytes(spark, request):
    """Splits of 300 bytes, and one a file."""
    keys = {"spark.sql.files.maxPartitionBytes": str(request.param), "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    old = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield request.param
    for k, v in old.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def write(tmp, name, text, newline=""):
    path = os.path.join(tmp, name)
    with open(path, "w", newline=newline) as f:
        f.write(text)
    return path


def odd_text(rng):
    parts = ["a", "é", "\n", '"', ",", " ", "{", "}", "[", "]", "\\", "word", ":", "\r\n", "x" * 40]
    return "".join(rng.choice(parts) for _ in range(rng.randint(0, 30))).strip()


def test_csv_records(spark, tmp, split_bytes):
    rng = random.Random(1)
    rows = [(i, odd_text(rng) or None, odd_text(rng) or "z") for i in range(40)]
    quoted = lambda x: "" if x is None else '"' + x.replace('"', '""') + '"'
    path = write(tmp, "r.csv", "".join(f"{i},{quoted(t)},{quoted(c)}\n" for i, t, c in rows).removesuffix("\n"))
    df = readers.read_reviews(spark, path, "amazon")
    assert sorted(tuple(r) for r in df.collect()) == sorted(rows, key=lambda r: r[0])
    assert read_records(spark, path, QuotedLines()).count() == 40
    old = spark.read.schema(df.schema).csv(path, quote='"', escape='"', multiLine=True)
    # Spark's own reader of whole files writes every line end as \\n
    assert sorted(map(str, old.collect())) == sorted(str(r).replace("\\r\\n", "\\n") for r in df.collect())


def dataset(rng, n):
    q = lambda i, j, k: {"id": f"q{i}-{j}-{k}", "question": odd_text(rng), "answers": [{"text": odd_text(rng), "answer_start": k}]}
    return [{"title": odd_text(rng), "paragraphs": [{"context": odd_text(rng) + "c", "qas": [q(i, j, k) for k in range(rng.randint(0, 3))]} for j in range(rng.randint(0, 3))]} for i in range(n)]


@pytest.mark.parametrize("indent", [None, 1])
@pytest.mark.parametrize("version_first", [True, False])
def test_qa_document(spark, tmp, split_bytes, indent, version_first):
    rng = random.Random(2)
    data = dataset(rng, 6)
    doc = {"version": "1.1", "data": data} if version_first else {"data": data, "version": "1.1"}
    path = write(tmp, "qa.json", json.dumps(doc, indent=indent, ensure_ascii=False))
    whole = readers.flatten_qa(spark.read.schema(readers.QA_SCHEMA).json(path, multiLine=True))
    got = readers.read_qa_json(spark, path)
    assert sorted(map(str, got.collect())) == sorted(map(str, whole.collect())) and got.count() >= 3
    preds = {f"q{i}": odd_text(rng) for i in range(25)}
    pp = write(tmp, "pred.json", json.dumps(preds, indent=indent, ensure_ascii=False))
    _, m, ok = readers.read_predictions(spark, path, pp)
    assert ok and {r.id: r.prediction_text for r in m.collect()} == preds
    assert not readers.read_predictions(spark, path, pp, expected_version="2.0")[2]


def test_small_documents(spark, tmp):
    empty = write(tmp, "e.json", '{"version": "1.0", "data": []}')
    none = write(tmp, "n.json", "{}\n")
    examples, m, ok = readers.read_predictions(spark, empty, none)
    assert (examples.count(), m.count(), ok) == (0, 0, False)
    assert read_records(spark, write(tmp, "one.json", ' {"a" : "b"} \n'), JsonMembers()).first().record.strip() == '"a" : "b"'
    assert readers.read_reviews(spark, write(tmp, "blank.csv", "\n\n"), "yelp").count() == 0


def test_records_over_several_splits_keep_their_order(spark, tmp, split_bytes):
    long = {"data": [{"n": i, "t": "y" * (500 * (i % 3))} for i in range(9)]}
    path = write(tmp, "long.json", json.dumps(long))
    rows = read_records(spark, path, JsonElements()).orderBy("file", "block", "n").collect()
    assert [json.loads(r.record)["n"] for r in rows if r.record.startswith("{")] == list(range(9))
    pieces = spark.read.option("lineSep", "}").text(path)
    assert (pieces.rdd.getNumPartitions() > 8) == (split_bytes == 300)
