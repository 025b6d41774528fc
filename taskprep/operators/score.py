"""Batch scoring surface (B1-B4): a user-supplied scorer applied with
``mapInPandas`` (Arrow batches), post-processing and metric callbacks as
plain DataFrame -> DataFrame functions, and sequential-task evaluation."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taskprep.operators import metrics


def score(df: DataFrame, scorer: Callable[[pd.DataFrame], pd.DataFrame], out_schema: str,
          batch: int = 1024) -> DataFrame:
    """B1: run ``scorer`` over Arrow batches of ``batch`` rows; the scorer gets
    a pandas frame and returns one with ``out_schema`` (e.g. logits, loss).
    The scorer object is shipped once per task with the closure."""
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for i in range(0, len(pdf), batch):
                yield scorer(pdf.iloc[i:i + batch])

    return df.mapInPandas(run, out_schema)


def map_batches(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], out_schema: str) -> DataFrame:
    """Batched map over columns; the output replaces the raw columns."""
    return df.mapInPandas(lambda it: (fn(p) for p in it), out_schema)


def evaluate(predictions: DataFrame, post: Callable[[DataFrame], DataFrame] | None,
             metric: Callable[[DataFrame], DataFrame], prefix: str = "eval_") -> DataFrame:
    """B2: post-process then compute metrics; metric columns get ``prefix``."""
    p = post(predictions) if post else predictions
    m = metric(p)
    return m.select(*[F.col(c).alias(c if c.startswith(prefix) else prefix + c) for c in m.columns])


def evaluate_stages(predictions: DataFrame, stage: str = "stage", task: str = "task", logits: str = "logits",
                    label: str = "label", batch: str | None = None) -> tuple[DataFrame, DataFrame]:
    """After each stage, every seen task is scored: returns (task_metrics
    with ``test_acc`` per stage and task, stage averages in percent)."""
    p = predictions.filter(F.col(task) <= F.col(stage)).withColumn(
        "pred", (F.array_position(F.col(logits), F.array_max(F.col(logits))) - 1).cast("int"))
    if batch:
        tm = metrics.batch_mean_accuracy(p, batch, "pred", label, [stage, task]).withColumnRenamed(
            "accuracy", "test_acc")
    else:
        tm = metrics.accuracy(p, "pred", label, [stage, task]).withColumnRenamed("accuracy", "test_acc")
    return tm, metrics.stage_average(tm, stage, task, "test_acc")
