from pyspark.sql import functions as F

import pandas as pd
import pytest

from taskprep.operators import components, rank, score
from taskprep.operators import specs as SP


def test_scorer_and_stages(spark):
    df = spark.createDataFrame([(i, i % 3, i % 2) for i in range(40)], "id long, task int, x int")

    def scorer(p: pd.DataFrame) -> pd.DataFrame:
        logits = [[1.0, 0.0] if x == 0 else [0.0, 1.0] for x in p["x"]]
        return pd.DataFrame({"id": p["id"], "task": p["task"], "logits": logits, "label": p["x"]})

    out = score.score(df, scorer, "id long, task int, logits array<double>, label int", batch=7)
    assert out.count() == 40


def test_evaluate_stages(spark):
    rows = [(s, t, [0.0, 1.0], 1 if t != 1 else 0) for s in range(3) for t in range(3)]
    df = spark.createDataFrame(rows, "stage int, task int, logits array<double>, label int")
    tm, avg = score.evaluate_stages(df)
    a = {r.stage: r.avg_acc for r in avg.collect()}
    assert a[0] == pytest.approx(100.0) and a[1] == pytest.approx(50.0) and a[2] == pytest.approx(200 / 3)


def test_align_and_components(spark):
    df = spark.createDataFrame(
        [({"sel": 1, "agg": 0, "conds": [{"col": 2, "op": 0, "val": "X"}, {"col": 0, "op": 1, "val": "y"}]},
          {"sel": 1, "agg": 0, "conds": [{"col": 0, "op": 1, "val": "Y"}, {"col": 2, "op": 0, "val": "x"}]})],
        "g struct<sel:int,agg:int,conds:array<struct<col:int,op:int,val:string>>>, "
        "p struct<sel:int,agg:int,conds:array<struct<col:int,op:int,val:string>>>")
    f = components.component_flags(df).collect()[0]
    assert (f.sc, f.sa, f.wn, f.wc, f.wo, f.wv, f.lx) == (1, 1, 1, 1, 1, 1, 1)
    span = "array<struct<st:int,ed:int>>"
    spans = df.select("g", "p", F.expr(f"from_json('[{{\"st\":4,\"ed\":5}},{{\"st\":0,\"ed\":1}}]', '{span}')").alias("g_spans"),
                      F.expr(f"from_json('[{{\"st\":0,\"ed\":1}},{{\"st\":4,\"ed\":5}}]', '{span}')").alias("p_spans"))
    assert components.value_span_flags(spans).collect()[0].wvi == 1
    assert components.value_span_flags(spans, mode="train").collect()[0].wvi == 0
    a = components.align_conditions(df).collect()[0].p_aligned
    assert [c.col for c in a] == [2, 0]


def test_map_batches_and_evaluate(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(10)], "id long, x double")
    doubled = score.map_batches(df, lambda p: p.assign(y=p["x"] * 2)[["id", "y"]], "id long, y double")
    assert sorted(r.y for r in doubled.collect()) == [2.0 * i for i in range(10)]
    from pyspark.sql import functions as F
    m = score.evaluate(doubled, lambda d: d.withColumn("ok", F.col("y") >= 10),
                       lambda d: d.agg(F.avg(F.col("ok").cast("double")).alias("accuracy")))
    r = m.collect()[0]
    assert m.columns == ["eval_accuracy"] and r.eval_accuracy == 0.5
