"""Registered sequential-task log queries on ``events``.

``event_type`` = task (all types that occur, numbered in name order), day of
``ts`` = stage (days since the first event), mean ``value`` of a (stage, task)
= its accuracy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from taskprep.functions.text import coerce_number
from taskprep.operators import metrics
from taskprep.session import read_table
from taskprep.sources import sinks

def _task_metrics(spark: SparkSession, sf: str) -> DataFrame:
    ev = read_table(spark, sf, "events").select("ts", "event_type", "value")
    first = ev.agg(F.min(F.to_date("ts"))).scalar()
    stage = F.datediff(F.to_date("ts"), first).cast("int")
    per = ev.groupBy(stage.alias("stage"), "event_type").agg(F.avg("value").alias("test_acc"),
                                                          F.count(F.lit(1)).alias("n"))
    # one row a (stage, type)
    return per.withColumn("task", (F.dense_rank().over(Window.orderBy("event_type")) - 1).cast("int"))


def stage_averages(spark: SparkSession, sf: str) -> DataFrame:
    """Average accuracy (percent) over the tasks seen so far, per stage."""
    tm = _task_metrics(spark, sf)
    return metrics.stage_average(tm).select("stage", F.round("avg_acc", 6).alias("avg_acc"), "n_tasks")


def best_epochs(spark: SparkSession, sf: str) -> DataFrame:
    """Per task, stages strictly better than every earlier stage."""
    tm = _task_metrics(spark, sf)
    b = metrics.best_so_far(tm, "stage", "test_acc", ["task"])
    return b.select("task", "stage", "is_best", F.round("best", 6).alias("best"))


def accuracy_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """Stage x task matrix of accuracies."""
    tm = _task_metrics(spark, sf)
    tasks = [r[0] for r in tm.select("event_type").distinct().orderBy("event_type").collect()]  # the columns
    m = metrics.accuracy_matrix(tm, tasks, task="event_type")
    return m.select("stage", *[F.round(t, 6).alias(t) for t in tasks])


def metric_log(spark: SparkSession, sf: str) -> DataFrame:
    """K3: per-task rows and per-stage average rows in one log with holes."""
    tm = _task_metrics(spark, sf)
    per_task = tm.select((F.col("stage") * 3 + 3).cast("double").alias("epoch"),
                         (F.col("task") + 1).cast("double").alias("task_num"),
                         F.round(F.col("n") / 100.0, 6).alias("test_loss"), F.round("test_acc", 6).alias("test_acc"))
    avg = metrics.stage_average(tm).select(F.col("stage").cast("double").alias("task"),
                                           F.round("avg_acc", 6).alias("avg_acc"))
    return sinks.union_log([per_task, avg])


def run_summaries(spark: SparkSession, sf: str) -> DataFrame:
    """A22 + P17: per task total loss / rows and matches / rows; a match is a
    ``props`` number above 50."""
    ev = read_table(spark, sf, "events").select("event_type", "value", "props")
    ev = ev.withColumn("hit", coerce_number("props") > 50)
    s = metrics.run_summary(ev, "value", "hit", ["event_type"])
    return s.select("event_type", F.round("avg_loss", 6).alias("avg_loss"), F.round("acc", 6).alias("acc"), "n")


# The matrix has a column a task; SQL must name those of the given table.
TASKS = ["click", "error", "purchase", "signup", "view"]
_SQL_TM = """
tm0 AS (SELECT CAST(date_diff('day', (SELECT min(CAST(ts AS DATE)) FROM events), CAST(ts AS DATE)) AS INTEGER) AS stage, event_type,
               avg(value) AS test_acc, count(*) AS n FROM events GROUP BY 1, 2),
tm AS (SELECT *, CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS INTEGER) AS task FROM tm0)"""

SQL_STAGE_AVERAGES = f"""WITH {_SQL_TM}
SELECT stage, round(100.0 * avg(test_acc), 6) AS avg_acc, count(*) AS n_tasks FROM tm WHERE task <= stage GROUP BY stage
"""

SQL_BEST_EPOCHS = f"""WITH {_SQL_TM},
b AS (SELECT task, stage, test_acc,
             max(test_acc) OVER (PARTITION BY task ORDER BY stage ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev
      FROM tm)
SELECT task, stage, prev IS NULL OR test_acc > prev AS is_best, round(greatest(test_acc, coalesce(prev, test_acc)), 6) AS best
FROM b
"""

SQL_ACCURACY_MATRIX = f"""WITH {_SQL_TM}
SELECT stage, {", ".join(f"round(max(CASE WHEN event_type = '{t}' THEN test_acc END), 6) AS {t}" for t in TASKS)}
FROM tm GROUP BY stage
"""

SQL_METRIC_LOG = f"""WITH {_SQL_TM}
SELECT NULL::DOUBLE AS avg_acc, CAST(stage * 3 + 3 AS DOUBLE) AS epoch, NULL::DOUBLE AS task,
       CAST(task + 1 AS DOUBLE) AS task_num, round(test_acc, 6) AS test_acc, round(n / 100.0, 6) AS test_loss FROM tm
UNION ALL
SELECT round(100.0 * avg(test_acc), 6), NULL, CAST(stage AS DOUBLE), NULL, NULL, NULL FROM tm WHERE task <= stage GROUP BY stage
"""

SQL_RUN_SUMMARIES = """
SELECT event_type, round(sum(value) / count(*), 6) AS avg_loss,
       round(sum(CASE WHEN coalesce(TRY_CAST(replace(props, ',', '') AS DOUBLE),
                                    TRY_CAST(nullif(regexp_extract(props, '[-+]?\\d*\\.\\d+|\\d+', 0), '') AS DOUBLE)) > 50
                 THEN 1.0 ELSE 0.0 END) / count(*), 6) AS acc,
       count(*) AS n
FROM events GROUP BY event_type
"""

QUERIES = {"stage_averages": stage_averages, "best_epochs": best_epochs, "accuracy_matrix": accuracy_matrix,
           "metric_log": metric_log, "run_summaries": run_summaries}
ORACLE = {"stage_averages": SQL_STAGE_AVERAGES, "best_epochs": SQL_BEST_EPOCHS,
          "accuracy_matrix": SQL_ACCURACY_MATRIX, "metric_log": SQL_METRIC_LOG, "run_summaries": SQL_RUN_SUMMARIES}
