import math

from pyspark.sql import functions as F

from taskprep.operators import tasks


def _docs(spark, n=500, groups=5):
    return spark.createDataFrame([(i, f"g{i % groups}") for i in range(n)], "doc_id long, grp string")


def test_sample_exact_size_and_partition_independence(spark):
    df = _docs(spark)
    a = {r.doc_id for r in tasks.sample_exact(df, 17, 42, "doc_id", by="grp").collect()}
    b = {r.doc_id for r in tasks.sample_exact(df.repartition(7), 17, 42, "doc_id", by="grp").collect()}
    assert a == b and len(a) == 17 * 5
    # the n smallest seeded hashes of each group
    h = df.withColumn("h", F.md5(F.concat(F.lit("42:"), F.col("doc_id").cast("string")))).collect()
    want = set()
    for g in {r.grp for r in h}:
        want |= {r.doc_id for r in sorted((r for r in h if r.grp == g), key=lambda r: (r.h, r.doc_id))[:17]}
    assert a == want


def test_sample_exact_too_few_rows(spark):
    import pytest
    with pytest.raises(ValueError):
        tasks.sample_exact(_docs(spark, 20), 50, 1, "doc_id", by="grp")
    assert tasks.sample_exact(_docs(spark, 20), 50, 1, "doc_id", by="grp", strict=False).count() == 20


def test_split_sizes_disjoint_covering(spark):
    df = _docs(spark, 103, 3)
    s = tasks.train_test_split(df, 0.125, 2020, "doc_id", by="grp")
    assert s.count() == 103 and s.select("doc_id").distinct().count() == 103
    sizes = {r.grp: r.n for r in df.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).collect()}
    val = {r.grp: r.c for r in s.filter("split = 'validation'").groupBy("grp").agg(
        F.count(F.lit(1)).alias("c")).collect()}
    assert all(val[g] == math.ceil(0.125 * n) for g, n in sizes.items())


def test_batches(spark):
    df = _docs(spark, 70, 1)
    b = tasks.assign_batches(df, 32, order="doc_id").orderBy("doc_id").collect()
    assert [r.batch for r in b][:33] == [0] * 32 + [1]
    assert b[-1].batch == 2 and [r.position for r in b] == list(range(1, 71))


def test_label_index_and_offsets(spark):
    df = spark.createDataFrame([("b", 1), ("a", 0), ("a", 1), ("c", 0)], "task string, label int")
    li = {r.label: r.label_id for r in tasks.label_index(df, "label").collect()}
    assert li == {0: 0, 1: 1}
    off = {r.task: r.offset for r in tasks.offset_labels(df, "task", "label").collect()}
    assert off == {"a": 0, "b": 2, "c": 3}


def test_mix_tasks_weights(spark):
    w = tasks.task_weights(spark.createDataFrame([("a", 100), ("b", 1)], "task string, size long")).collect()
    p = {r.task: r.p for r in w}
    assert abs(p["a"] - 100 ** 0.4 / (100 ** 0.4 + 1)) < 1e-12
    mixed = tasks.mix_tasks(_docs(spark, 100, 4), "grp", "doc_id", steps=50, batch=3, seed=1)
    assert mixed.count() == 150


def test_head_rows_and_shuffle_head(spark):
    df = spark.createDataFrame([(i, i * 7 % 101) for i in range(300)], "pos long, v long").repartition(5)
    head = sorted(r.pos for r in tasks.head_rows(df, 40, "pos").collect())
    assert head == list(range(40))
    a = {r.pos for r in tasks.shuffle_head(df, 25, 3, "pos").collect()}
    b = {r.pos for r in tasks.shuffle_head(df.coalesce(1), 25, 3, "pos").collect()}
    assert a == b and len(a) == 25
