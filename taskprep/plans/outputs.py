"""Registered queries of evaluation and output steps.

``embeddings`` stand for model scores: ten values a stage, ``label`` the gold
class, ``vec_id % 5`` the task. Gold and predicted specs are those of ``spec_eval``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taskprep.functions import arrays as A
from taskprep.operators import clean, metrics, score
from taskprep.operators import components as C
from taskprep.operators import tokens as TK
from taskprep.plans.packed_specs import PER_COND, questions
from taskprep.plans.scores import _emb, _r
from taskprep.plans.spec_eval import _SQL_PAIRS, HEADERS, pairs
from taskprep.sources import sinks

STAGES, TASKS, CLASSES = 6, 5, 10
OP_TOKENS = ["EQL", "GT", "LT"]


def stage_scores(spark: SparkSession, sf: str) -> DataFrame:
    """B4 (+ A15, A23): every task seen so far scored after each stage, and the stage's average in percent."""
    p = _emb(spark, sf).withColumn("task", (F.col("vec_id") % TASKS).cast("int")).withColumn("stage", F.explode(F.sequence(F.lit(0), F.lit(STAGES - 1))))
    p = p.withColumn("logits", F.slice("v", F.col("stage") * CLASSES + 1, CLASSES))
    per_task, average = score.evaluate_stages(p)
    return per_task.join(average, "stage").select("stage", "task", "n", _r(F.col("test_acc"), "test_acc"), _r(F.col("avg_acc"), "avg_acc"), "n_tasks")


SQL_STAGE_SCORES = f"""
WITH p AS (SELECT s AS stage, CAST(vec_id % {TASKS} AS INTEGER) AS task, label, embedding[s * {CLASSES} + 1:s * {CLASSES} + {CLASSES}] AS l FROM embeddings, range({STAGES}) t(s)),
m AS (SELECT stage, task, avg(CASE WHEN list_position(l, list_max(l)) - 1 = label THEN 1.0 ELSE 0.0 END) AS acc, count(*) AS n FROM p WHERE task <= stage GROUP BY stage, task)
SELECT CAST(stage AS INTEGER) AS stage, task, n, round(acc, 6) AS test_acc, round(100 * avg(acc) OVER (PARTITION BY stage), 6) AS avg_acc, count(*) OVER (PARTITION BY stage) AS n_tasks FROM m
"""


def eval_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """B2 (+ R3, A15, A16): scores turned into classes by a post-processing step, accuracy and loss by a metric step, names prefixed."""
    post = lambda d: d.withColumn("pred", A.argmax("l")).withColumn("loss", A.log_loss("l", "label"))

    def metric(d: DataFrame) -> DataFrame:
        return d.agg(F.round(F.avg((F.col("pred") == F.col("label")).cast("double")), 6).alias("accuracy"), F.round(F.avg("loss"), 6).alias("loss"), F.count(F.lit(1)).alias("eval_rows"))

    return score.evaluate(_emb(spark, sf).withColumn("l", F.slice("v", 1, CLASSES)), post, metric)


SQL_EVAL_METRICS = f"""
WITH p AS (SELECT label, list_transform(embedding[1:{CLASSES}], lambda x: CAST(x AS DOUBLE)) AS l FROM embeddings)
SELECT round(avg(CASE WHEN list_position(l, list_max(l)) - 1 = label THEN 1.0 ELSE 0.0 END), 6) AS eval_accuracy,
       round(avg(ln(list_sum(list_transform(l, lambda x: exp(x)))) - l[label + 1]), 6) AS eval_loss, count(*) AS eval_rows FROM p
"""


def prediction_report(spark: SparkSession, sf: str) -> DataFrame:
    """K4: the lines of a class prediction file with label names, of a regression file, and of a sorted report."""
    e = _emb(spark, sf).withColumn("pred", A.argmax(F.slice("v", 1, CLASSES))).withColumn("x", F.element_at("v", 1))
    names = [f"class_{i}" for i in range(CLASSES)]
    classes = sinks.prediction_lines(e, "vec_id", "pred", labels=names).select(F.lit("class").alias("kind"), "value")
    numbers = sinks.prediction_lines(e, "vec_id", "x", regression=True).select(F.lit("number").alias("kind"), "value")
    per = metrics.accuracy(e, "pred", "label", ["label"]).select(F.concat(F.lit("acc_"), F.col("label")).alias("key"), F.format_string("%.4f", "accuracy").alias("value"))
    return classes.unionByName(numbers).unionByName(sinks.report_lines(per).select(F.lit("report").alias("kind"), "value"))


SQL_PREDICTION_REPORT = f"""
WITH p AS (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS x, list_position(embedding[1:{CLASSES}], list_max(embedding[1:{CLASSES}])) - 1 AS pred FROM embeddings)
SELECT 'class' AS kind, vec_id || chr(9) || 'class_' || pred AS value FROM p
UNION ALL SELECT 'number', vec_id || chr(9) || printf('%.3f', x) FROM p
UNION ALL SELECT 'report', 'acc_' || label || ' = ' || printf('%.4f', avg(CASE WHEN pred = label THEN 1.0 ELSE 0.0 END)) FROM p GROUP BY label
"""


def aligned_conditions(spark: SparkSession, sf: str) -> DataFrame:
    """J10 + U5: gold and predicted specs of two tables paired by id, the predicted conditions in gold order where the columns agree as sets."""
    both = pairs(spark, sf)
    gold, pred = both.select("qid", F.col("g").alias("sql")), both.filter(F.col("qid") % 9 != 0).select("qid", F.col("p").alias("sql"))
    a = C.align_conditions(C.pair_gold(gold, pred))
    text = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["col"], x["op"], x["val"])), ",")
    return a.select("qid", text(F.col("p.conds")).alias("predicted"), text(F.col("p_aligned")).alias("aligned"))


SQL_ALIGNED_CONDITIONS = "WITH " + _SQL_PAIRS.rsplit("gs AS", 1)[0].rstrip().rstrip(",") + """,
s AS (SELECT qid, g_conds, p_conds, list_sort(list_distinct(list_transform(g_conds, lambda c: c.col))) = list_sort(list_distinct(list_transform(p_conds, lambda c: c.col))) AS same FROM pr WHERE qid % 9 <> 0)
SELECT qid, array_to_string(list_transform(p_conds, lambda c: c.col || ':' || c.op || ':' || c.val), ',') AS predicted,
       array_to_string(list_transform(CASE WHEN same THEN g_conds ELSE p_conds END, lambda c: c.col || ':' || c.op || ':' || c.val), ',') AS aligned
FROM s
"""


def query_values(spark: SparkSession, sf: str) -> DataFrame:
    """T12 + P15: the conditions of the gold spec's tokenised query: operator, where its value stands in the question, and the value as written there."""
    header = lambda i: F.get(F.col("header"), i)
    ops = F.array(*map(F.lit, OP_TOKENS))
    q = questions(spark, sf).select("qid", "g", "header", "words", "question")
    cond = lambda c, i: F.concat(F.array(F.when(i == 0, "WHERE").otherwise("AND"), header(c["col"]), F.get(ops, c["op"]), c["val"]), F.array(F.lit("("), c["col"].cast("string"), F.lit(")")))
    q = q.withColumn("query", F.explode(F.array(F.concat(F.array(F.lit("SELECT"), header(F.col("g.sel"))), F.flatten(F.transform("g.conds", cond))))))
    q = q.withColumn("found", F.explode(F.array(F.coalesce(TK.condition_values("query", "words"), F.array().cast("array<struct<op:string,value:array<string>,pos:int>>")))))
    said = F.transform("found", lambda x: F.concat_ws("|", x["op"], x["pos"], TK.detokenize(x["value"], "question")))
    return q.select("qid", F.size("found").alias("n"), F.array_join(said, ";").alias("conds"))


SQL_QUERY_VALUES = "WITH " + _SQL_PAIRS.rsplit("gs AS", 1)[0].rstrip().rstrip(",") + f"""
SELECT qid, CAST(len(g_conds) AS INTEGER) AS n,
       array_to_string(list_transform(g_conds, lambda c, i: ['EQL', 'GT', 'LT'][c.op + 1] || '|' || (5 + {PER_COND} * (i - 1)) || '|' || c.val || ' (' || c.col || ')'), ';') AS conds
FROM pr
"""


def model_columns(spark: SparkSession, sf: str) -> DataFrame:
    """P5 + P7: the two text columns that a task without a name takes, and the columns a scorer accepts, from labelled documents."""
    from taskprep.session import read_table
    d = read_table(spark, sf, "documents").join(read_table(spark, sf, "labels"), "doc_id").select("text", "lang", "source", F.col("quality").alias("label"), "doc_id")
    first, second = clean.resolve_columns([c for c in d.columns if c != "doc_id"])
    kept = clean.select_model_columns(d, [first, second])
    return kept.groupBy(second, "label").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length(first)).alias("letters"))


SQL_MODEL_COLUMNS = """
SELECT lang, quality AS label, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS letters FROM documents JOIN labels USING (doc_id) GROUP BY lang, quality
"""

QUERIES = {"stage_scores": stage_scores, "eval_metrics": eval_metrics, "prediction_report": prediction_report,
           "aligned_conditions": aligned_conditions, "query_values": query_values, "model_columns": model_columns}
ORACLE = {"stage_scores": SQL_STAGE_SCORES, "eval_metrics": SQL_EVAL_METRICS, "prediction_report": SQL_PREDICTION_REPORT,
          "aligned_conditions": SQL_ALIGNED_CONDITIONS, "query_values": SQL_QUERY_VALUES, "model_columns": SQL_MODEL_COLUMNS}
