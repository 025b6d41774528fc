"""Scoring: QA exact match / token F1, classification accuracy and loss,
sequential-task averages, structured-query component accuracies.

A2-A6, A8-A19, A22, A23, A25, U4, W5, W6, J3.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from taskprep.functions.text import answer_tokens, normalize_answer


# ---------------------------------------------------------------- QA metrics

def dedupe_predictions(preds: DataFrame, id_col: str = "id", pos: str = "pos",
                       text: str = "prediction_text") -> DataFrame:
    """Duplicate prediction ids: the one with the largest position wins."""
    return preds.groupBy(id_col).agg(F.max_by(text, pos).alias(text))


def join_predictions(refs: DataFrame, preds: DataFrame, id_col: str = "id",
                     text: str = "prediction_text", pos: str | None = "pos") -> DataFrame:
    """References left-joined to (deduplicated) predictions; unanswered -> null."""
    p = dedupe_predictions(preds, id_col, pos, text) if pos else preds.select(id_col, text)
    return refs.join(p, id_col, "left")


def token_overlap(refs: DataFrame, preds: DataFrame, id_col: str, ref_no: str, ref_text: str,
                  text: str) -> DataFrame:
    """Multiset intersection size of normalised tokens per (id, ref_no).

    Tokens are counted per (id, token) and (id, ref_no, token) with map-side
    partial aggregation; keys include the token so one huge id is spread
    over many tasks.
    """
    pt = (preds.select(id_col, F.explode(answer_tokens(text)).alias("tok"))
          .groupBy(id_col, "tok").agg(F.count(F.lit(1)).alias("cp")))
    rt = (refs.select(id_col, ref_no, F.explode(answer_tokens(ref_text)).alias("tok"))
          .groupBy(id_col, ref_no, "tok").agg(F.count(F.lit(1)).alias("cr")))
    return (rt.join(pt, [id_col, "tok"])
            .groupBy(id_col, ref_no).agg(F.sum(F.least("cp", "cr")).alias("common")))


def f1_from_counts(common, n_pred, n_ref):
    common = F.coalesce(common, F.lit(0))
    prec = common / n_pred
    rec = common / n_ref
    return F.when(common == 0, F.lit(0.0)).otherwise(2 * prec * rec / (prec + rec))


def qa_pair_scores(refs: DataFrame, preds: DataFrame, id_col: str = "id", ref_no: str = "ref_no",
                   ref_text: str = "answer_text", text: str = "prediction_text", pos: str | None = "pos") -> DataFrame:
    """EM and F1 of each (id, reference); unanswered ids score 0."""
    p = dedupe_predictions(preds, id_col, pos, text) if pos else preds.select(id_col, text)
    pairs = refs.select(id_col, ref_no, ref_text).join(p, id_col, "left")
    common = token_overlap(refs, p, id_col, ref_no, ref_text, text)
    scored = pairs.join(common, [id_col, ref_no], "left")
    answered = F.col(text).isNotNull()
    em = F.when(answered & (normalize_answer(text) == normalize_answer(ref_text)), 1.0).otherwise(0.0)
    f1 = F.when(answered, f1_from_counts(F.col("common"), F.size(answer_tokens(text)),
                                         F.size(answer_tokens(ref_text)))).otherwise(0.0)
    return scored.select(id_col, ref_no, em.alias("exact_match"), f1.alias("f1"), answered.alias("answered"))


def qa_example_scores(refs: DataFrame, preds: DataFrame, id_col: str = "id", **kw) -> DataFrame:
    """Best EM and best F1 over each id's references (they may come from different references)."""
    pair = qa_pair_scores(refs, preds, id_col, **kw)
    return pair.groupBy(id_col).agg(F.max("exact_match").alias("exact_match"), F.max("f1").alias("f1"))


def qa_scores(refs: DataFrame, preds: DataFrame, id_col: str = "id", **kw) -> DataFrame:
    """Corpus EM and F1 in percent over all reference ids (unanswered count as 0)."""
    ex = qa_example_scores(refs, preds, id_col, **kw)
    return ex.agg((100.0 * F.sum("exact_match") / F.count(F.lit(1))).alias("exact_match"),
                  (100.0 * F.sum("f1") / F.count(F.lit(1))).alias("f1"),
                  F.count(F.lit(1)).alias("total"))


# ---------------------------------------------------- classification metrics

def argmax_col(arr) -> F.Column:
    a = F.col(arr) if isinstance(arr, str) else arr
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def accuracy(df: DataFrame, pred: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Per-row accuracy (mean of pred == label), optionally grouped."""
    return df.groupBy(*by).agg(F.avg((F.col(pred) == F.col(label)).cast("double")).alias("accuracy"),
                              F.count(F.lit(1)).alias("n"))


def mse(df: DataFrame, pred: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(F.pow(F.col(pred) - F.col(label), 2)).alias("mse"))


def combined_score(metrics: DataFrame, key: Sequence[str], metric_cols: Sequence[str]) -> DataFrame:
    """Mean of several metric columns per key (unpivot + avg)."""
    stacked = metrics.unpivot(list(key), list(metric_cols), "metric", "value")
    return stacked.groupBy(*key).agg(F.avg("value").alias("combined_score"))


def batch_mean_accuracy(df: DataFrame, batch: str, pred: str, label: str, by: Sequence[str] = (),
                        loss: str | None = None) -> DataFrame:
    """Accuracy computed per batch, then averaged over batches (a short last
    batch weighs as much as a full one); same for the loss when given."""
    aggs = [F.avg((F.col(pred) == F.col(label)).cast("double")).alias("batch_acc")]
    if loss:
        aggs.append(F.avg(loss).alias("batch_loss"))
    per_batch = df.groupBy(*by, batch).agg(*aggs)
    out = [F.avg("batch_acc").alias("accuracy"), F.count(F.lit(1)).alias("n_batches")]
    if loss:
        out.append(F.avg("batch_loss").alias("loss"))
    return per_batch.groupBy(*by).agg(*out)


def eval_loss(df: DataFrame, loss: str, n: str, by: Sequence[str] = ()) -> DataFrame:
    """Loss over all rows: each batch's mean loss repeated for its rows."""
    return df.groupBy(*by).agg((F.sum(F.col(loss) * F.col(n)) / F.sum(n)).alias("eval_loss"))


def log_softmax_loss(logits, label) -> F.Column:
    """Cross-entropy of one row: logsumexp(x) - x[label] (max-shifted)."""
    x = F.col(logits) if isinstance(logits, str) else logits
    y = F.col(label) if isinstance(label, str) else label
    m = F.array_max(x)
    lse = F.log(F.aggregate(x, F.lit(0.0), lambda acc, v: acc + F.exp(v - m))) + m
    return lse - F.element_at(x, y + 1)


def binary_log_loss(logit, target) -> F.Column:
    """Binary cross-entropy with logits, numerically stable."""
    x = F.col(logit) if isinstance(logit, str) else logit
    t = F.col(target) if isinstance(target, str) else target
    return F.greatest(x, F.lit(0.0)) - x * t + F.log1p(F.exp(-F.abs(x)))


# ----------------------------------------------------- sequential task log

def stage_average(task_metrics: DataFrame, stage: str = "stage", task: str = "task",
                  acc: str = "test_acc") -> DataFrame:
    """Average accuracy (percent) over the tasks seen so far, per stage."""
    seen = task_metrics.filter(F.col(task) <= F.col(stage))
    return seen.groupBy(stage).agg((100.0 * F.avg(acc)).alias("avg_acc"), F.count(F.lit(1)).alias("n_tasks"))


def accuracy_matrix(task_metrics: DataFrame, tasks: Sequence, stage: str = "stage", task: str = "task",
                    acc: str = "test_acc") -> DataFrame:
    """Stage x task accuracy matrix (pivot over a known task list)."""
    return task_metrics.groupBy(stage).pivot(task, list(tasks)).agg(F.first(acc))


def best_so_far(df: DataFrame, order: str, metric: str, by: Sequence[str] = ()) -> DataFrame:
    """Flag rows strictly better than every earlier row (running best)."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    prev = F.max(metric).over(w)
    return (df.withColumn("prev_best", prev)
            .withColumn("is_best", prev.isNull() | (F.col(metric) > prev))
            .withColumn("best", F.greatest(F.col(metric), F.coalesce(prev, F.col(metric)))))


def run_summary(df: DataFrame, loss: str, match: str, by: Sequence[str] = ()) -> DataFrame:
    """Epoch summary: total loss / rows and matches / rows."""
    return df.groupBy(*by).agg((F.sum(loss) / F.count(F.lit(1))).alias("avg_loss"),
                              (F.sum(F.col(match).cast("double")) / F.count(F.lit(1))).alias("acc"),
                              F.count(F.lit(1)).alias("n"))
