"""Registered score/ranking queries on ``embeddings``.

The values of a vector are class scores and ``label`` the gold class; the 64
values reshape to 8 steps x 8 positions for pointer decoding;
slices of the vector stand in for the select/aggregate/where heads of a
structured-query model. All values are cast to double first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taskprep.functions import arrays as A
from taskprep.operators import metrics, rank, tasks
from taskprep.session import read_table


def _emb(spark: SparkSession, sf: str) -> DataFrame:
    e = read_table(spark, sf, "embeddings")
    return e.select("vec_id", "label", A.as_double("embedding").alias("v"))


def _r(c, name):
    return F.round(c, 6).alias(name)


def class_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Argmax class, probability at gold and at prediction,
    cross-entropy, sigmoid of the gold score, binary log-loss over all classes."""
    e = _emb(spark, sf).withColumn("s", F.col("v"))
    onehot = F.transform("s", lambda x, i: (i == F.col("label")).cast("double"))
    return e.select("vec_id", "label", A.argmax("s").alias("pred"), _r(A.prob_at("s", F.col("label")), "p_gold"),
                    _r(F.array_max(A.softmax("s")), "p_pred"), _r(A.log_loss("s", "label"), "loss"),
                    _r(F.element_at(A.sigmoid("s"), F.col("label") + 1), "sig_gold"),
                    _r(A.binary_log_loss("s", onehot), "bce"))




def _softmax_sql(l: str) -> str:
    ex = f"list_transform({l}, lambda x: exp(x - list_max({l})))"
    return f"list_transform({ex}, lambda x: x / list_sum({ex}))"


SQL_CLASS_PREDICTIONS = f"""
WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS s FROM embeddings)
SELECT vec_id, label, CAST(list_position(s, list_max(s)) - 1 AS INTEGER) AS pred,
       round({_softmax_sql('s')}[label + 1], 6) AS p_gold,
       round(list_max({_softmax_sql('s')}), 6) AS p_pred,
       round(ln(list_sum(list_transform(s, lambda x: exp(x - list_max(s))))) + list_max(s) - s[label + 1], 6) AS loss,
       round(1.0 / (1.0 + exp(-s[label + 1])), 6) AS sig_gold,
       round(list_sum(list_transform(list_zip(s, list_transform(range(len(s)), lambda i: CASE WHEN i = label THEN 1.0 ELSE 0.0 END)),
             lambda p: greatest(p[1], 0.0) - p[1] * p[2] + ln(1 + exp(-abs(p[1]))))) / len(s), 6) AS bce
FROM e
"""


def topk_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Top-3 classes (by score, and re-sorted by index), top-3 cells of the 8x8 grid."""
    e = _emb(spark, sf)
    s = F.col("v")
    nd = A.topk_nd("v", 8, 8, 3)
    return e.select("vec_id", F.array_join(A.topk_indices(s, 3), ",").alias("top3"),
                    F.array_join(A.topk_indices(s, 3, by_index=True), ",").alias("top3_by_index"),
                    F.array_join(F.transform(nd, lambda p: F.concat_ws(":", p.r.cast("string"), p.c.cast("string"))),
                                 ",").alias("top3_grid"))


SQL_TOPK_SCORES = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
g AS (SELECT vec_id, list_transform(list_grade_up(list_transform(v, lambda x: -x))[1:3], lambda i: i - 1) AS t3,
             list_transform(list_grade_up(list_transform(v, lambda x: -x))[1:3], lambda i: i - 1) AS g3 FROM e)
SELECT vec_id, array_to_string(t3, ',') AS top3, array_to_string(list_sort(t3), ',') AS top3_by_index,
       array_to_string(list_transform(g3, lambda i: CAST(i // 8 AS VARCHAR) || ':' || CAST(i % 8 AS VARCHAR)), ',')
         AS top3_grid
FROM g
"""


def pointer_decoding(spark: SparkSession, sf: str) -> DataFrame:
    """Per-step argmax of the 8x8 grid, pointer list cut after
    position 7 (end), slot argmax cut to ``label`` slots, start/end beam of 4."""
    e = _emb(spark, sf)
    grid = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda r: F.slice("v", r * 8 + 1, 8))
    beam = A.pair_beam(F.slice("v", 1, 8), F.slice("v", 9, 8), 4)
    return e.select("vec_id", F.array_join(A.decode_pointers(grid, 7), ",").alias("pointers"),
                    F.array_join(A.slot_argmax(grid, F.col("label")), ",").alias("slots"),
                    F.array_join(F.transform(beam, lambda p: F.concat_ws(":", p.st.cast("string"), p.ed.cast("string"))),
                                 ",").alias("beam"),
                    _r(F.element_at(beam, 1).prob, "beam_p1"))


SQL_POINTER_DECODING = f"""
WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
g AS (SELECT vec_id, label, v, list_transform(range(8), lambda r: v[r * 8 + 1: r * 8 + 8]) AS grid FROM e),
p AS (SELECT vec_id, label, v, grid, list_transform(grid, lambda s: list_position(s, list_max(s)) - 1) AS picks FROM g),
b AS (SELECT vec_id, label, v, grid, picks, {_softmax_sql('v[1:8]')} AS ps, {_softmax_sql('v[9:16]')} AS pe,
             list_transform(list_grade_up(list_transform(v[1:8], lambda x: -x))[1:2], lambda i: i - 1) AS si,
             list_transform(list_grade_up(list_transform(v[9:16], lambda x: -x))[1:2], lambda i: i - 1) AS ei FROM p),
pairs AS (SELECT vec_id, list_sort(flatten(list_transform(range(2), lambda a: list_transform(range(2), lambda c:
            [-(ps[si[a + 1] + 1] * pe[ei[c + 1] + 1]), a, c, si[a + 1], ei[c + 1]])))) AS pr FROM b)
SELECT b.vec_id,
       array_to_string(CASE WHEN list_position(picks, 7) > 0 THEN picks[1:list_position(picks, 7)] ELSE picks END, ',')
         AS pointers,
       array_to_string(list_transform(grid, lambda s: list_position(s, list_max(s)) - 1)[1:label], ',') AS slots,
       array_to_string(list_transform(pr, lambda q: CAST(CAST(q[4] AS INTEGER) AS VARCHAR) || ':' ||
                       CAST(CAST(q[5] AS INTEGER) AS VARCHAR)), ',') AS beam,
       round(-pr[1][1], 6) AS beam_p1
FROM b JOIN pairs ON pairs.vec_id = b.vec_id
"""


def classification_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Per-row and batch-averaged accuracy and loss, MSE,
    combined score and the all-rows loss, for two tasks (label parity)."""
    e = _emb(spark, sf).withColumn("task", (F.col("label") % 2).cast("int"))
    e = e.withColumn("pred", A.argmax("v")).withColumn("loss", A.log_loss("v", "label"))
    b = tasks.assign_batches(e, 32, order="vec_id", by="task")
    per_batch = b.groupBy("task", "batch").agg(F.avg("loss").alias("batch_loss"), F.count(F.lit(1)).alias("n"))
    acc = metrics.accuracy(e, "pred", "label", ["task"])
    bacc = metrics.batch_mean_accuracy(b, "batch", "pred", "label", ["task"], loss="loss").select(
        "task", F.col("accuracy").alias("batch_accuracy"), "n_batches", F.col("loss").alias("batch_loss"))
    mse = metrics.mse(e.withColumn("target", F.col("label") / 10.0).withColumn("x", F.element_at("v", 1)),
                      "x", "target", ["task"])
    ev = metrics.eval_loss(per_batch, "batch_loss", "n", ["task"])
    out = acc.join(bacc, "task").join(mse, "task").join(ev, "task")
    out = out.join(metrics.combined_score(out, ["task"], ["accuracy", "mse"]), "task")
    return out.select("task", "n", "n_batches", _r(F.col("accuracy"), "accuracy"),
                      _r(F.col("batch_accuracy"), "batch_accuracy"), _r(F.col("batch_loss"), "batch_loss"),
                      _r(F.col("mse"), "mse"), _r(F.col("eval_loss"), "eval_loss"),
                      _r(F.col("combined_score"), "combined_score"))


SQL_CLASSIFICATION_METRICS = """
WITH e AS (SELECT vec_id, label, CAST(label % 2 AS INTEGER) AS task,
                  list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
p AS (SELECT *, list_position(v, list_max(v)) - 1 AS pred,
             ln(list_sum(list_transform(v, lambda x: exp(x - list_max(v))))) + list_max(v) - v[label + 1] AS loss,
             (row_number() OVER (PARTITION BY task ORDER BY vec_id) - 1) // 32 AS batch FROM e),
pb AS (SELECT task, batch, avg(CASE WHEN pred = label THEN 1.0 ELSE 0.0 END) AS bacc, avg(loss) AS bl,
              count(*) AS n FROM p GROUP BY task, batch),
b AS (SELECT task, avg(bacc) AS batch_accuracy, count(*) AS n_batches, avg(bl) AS batch_loss,
             sum(bl * n) / sum(n) AS eval_loss FROM pb GROUP BY task),
r AS (SELECT task, avg(CASE WHEN pred = label THEN 1.0 ELSE 0.0 END) AS accuracy, count(*) AS n,
             avg(pow(v[1] - label / 10.0, 2)) AS mse FROM p GROUP BY task)
SELECT r.task, r.n, b.n_batches, round(r.accuracy, 6) AS accuracy, round(b.batch_accuracy, 6) AS batch_accuracy,
       round(b.batch_loss, 6) AS batch_loss, round(r.mse, 6) AS mse, round(b.eval_loss, 6) AS eval_loss,
       round((r.accuracy + r.mse) / 2, 6) AS combined_score
FROM r JOIN b ON b.task = r.task
"""


SLOTS = 3


def spec_probability(spark: SparkSession, sf: str) -> DataFrame:
    """Joint probability of a decoded spec. The vector's values are
    the heads: 8 columns, 6 aggregates, 4 counts (0 to 3 conditions), 8
    condition columns, then for each of 3 slots 3 operators, 4 value starts and
    the rest as value ends (5 each). The n most probable condition columns are
    taken, each slot decides its own operator, start and end."""
    e = _emb(spark, sf)

    def head(at, n):
        return A.softmax(F.slice("v", at, n))

    def slot(at, n):
        return F.slice(F.array(*[F.array_max(head(at + k * n, n)) for k in range(SLOTS)]), F.lit(1), F.col("n"))

    cols = A.topk_indices(F.slice("v", 19, 8), SLOTS)
    e = e.withColumn("n", A.argmax(F.slice("v", 15, 4))).withColumns({
        "sc": F.array_max(head(1, 8)), "sa": F.array_max(head(9, 6)), "pn": F.array_max(head(15, 4)),
        "wc": F.transform(F.slice(cols, F.lit(1), F.col("n")), lambda i: F.get(head(19, 8), i)),
        "wo": slot(27, 3), "st": slot(36, 4), "ed": slot(48, 5)})
    out = rank.spec_probability(e, "sc", "sa", "pn", "wc", "wo", "st", "ed")
    return out.select("vec_id", F.col("n").alias("wn"), *(_r(F.col(c), c) for c in ("p_select", "p_where", "p_total")))


def _best_sql(l: str) -> str:
    return f"list_max({_softmax_sql(l)})"


def _slots_sql(at: int, n: int) -> str:
    return "[" + ", ".join(_best_sql(f"v[{at + k * n}:{at + k * n + n - 1}]") for k in range(SLOTS)) + "]"


SQL_SPEC_PROBABILITY = f"""
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
p AS (SELECT vec_id, CAST(list_position(v[15:18], list_max(v[15:18])) - 1 AS INTEGER) AS wn,
             {_best_sql('v[1:8]')} * {_best_sql('v[9:14]')} AS sel, {_best_sql('v[15:18]')} AS pn,
             list_reverse_sort({_softmax_sql('v[19:26]')}) AS wc,
             {_slots_sql(27, 3)} AS wo, {_slots_sql(36, 4)} AS st, {_slots_sql(48, 5)} AS ed FROM e),
c AS (SELECT vec_id, product(wc[i] * wo[i] * st[i] * ed[i]) AS pc FROM (SELECT *, unnest(range(1, wn + 1)) AS i FROM p) GROUP BY vec_id)
SELECT p.vec_id, wn, round(sel, 6) AS p_select, round(pn * coalesce(pc, 1.0), 6) AS p_where,
       round(sel * pn * coalesce(pc, 1.0), 6) AS p_total
FROM p LEFT JOIN c ON c.vec_id = p.vec_id
"""


def topk_cells(spark: SparkSession, sf: str) -> DataFrame:
    """The 5 best cells of the values as a 4 x 4 x 4 score; the first
    dimension stands for the 4 best of the first 10 values, the last one for
    the ids 10, 20, 30, 40."""
    top = A.topk_multi("v", (4, 4, 4), 5, [A.topk_indices(F.slice("v", 1, 10), 4), None, F.array(*map(F.lit, (10, 20, 30, 40)))])
    return _emb(spark, sf).select("vec_id", F.array_join(F.transform(top, lambda x: F.array_join(x["at"], ":")), ",").alias("cells"),
                                  _r(F.aggregate(top, F.lit(0.0), lambda s, x: s + x["score"]), "total"))


SQL_TOPK_CELLS = """
WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
ids AS (SELECT vec_id, i AS id, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, i) - 1 AS d FROM e WHERE i < 10),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, i) AS r FROM e)
SELECT r.vec_id, string_agg(ids.id || ':' || (r.i // 4) % 4 || ':' || (r.i % 4 + 1) * 10, ',' ORDER BY r.r) AS cells, round(sum(r.x ORDER BY r.r), 6) AS total
FROM r JOIN ids ON ids.vec_id = r.vec_id AND ids.d = r.i // 16 WHERE r.r <= 5 GROUP BY r.vec_id
"""


def structured_losses(spark: SparkSession, sf: str) -> DataFrame:
    """Operator loss of label % 5 slots of 3 scores, start and end loss of
    as many spans over 6 positions (summed and averaged), pointer loss of the
    8 x 8 grid against label + 1 pointers, over all positions and over the first 7."""
    n = F.col("label") % 5
    part = lambda at, size: F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.slice("v", i * size + at, size))
    slots = lambda f: F.transform(F.slice(F.sequence(F.lit(0), F.lit(3)), F.lit(1), n.cast("int")), f)
    spans = slots(lambda i: F.struct(((F.col("label") + i) % 6).cast("int").alias("st"), ((F.col("vec_id") + i) % 6).cast("int").alias("ed")))
    grid = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda r: F.slice("v", r * 8 + 1, 8))
    pointers = F.transform(F.sequence(F.lit(0), F.least(F.col("label"), F.lit(8)).cast("int")), lambda t: ((F.col("vec_id") + t * 3) % 7).cast("int"))
    e = _emb(spark, sf)
    return e.select("vec_id", _r(A.mean_loss(part(1, 3), slots(lambda i: ((F.col("vec_id") + i) % 3).cast("int"))), "op_loss"),
                    _r(A.span_loss(part(13, 6), part(37, 6), spans), "span_loss"), _r(A.span_loss(part(13, 6), part(37, 6), spans, average=True), "mean_span_loss"),
                    _r(A.pointer_loss(grid, pointers), "pointer_loss"), _r(A.pointer_loss(grid, pointers, 7), "masked_loss"))


#: every position of every scored row, its log-sum-exp, and the gold ones among them
SQL_STRUCTURED_LOSSES = """
WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
p AS (
  SELECT vec_id, label, 'op' AS part, i // 3 AS r, i % 3 AS c, x, label % 5 AS n, (vec_id + i // 3) % 3 AS gold FROM e WHERE i < 12
  UNION ALL SELECT vec_id, label, 'st', (i - 12) // 6, (i - 12) % 6, x, label % 5, (label + (i - 12) // 6) % 6 FROM e WHERE i BETWEEN 12 AND 35
  UNION ALL SELECT vec_id, label, 'ed', (i - 36) // 6, (i - 36) % 6, x, label % 5, (vec_id + (i - 36) // 6) % 6 FROM e WHERE i BETWEEN 36 AND 59
  UNION ALL SELECT vec_id, label, 'pt', i // 8, i % 8, x, least(label, 8), (vec_id + (i // 8 + 1) * 3) % 7 FROM e
  UNION ALL SELECT vec_id, label, 'pm', i // 8, i % 8, x, least(label, 8), (vec_id + (i // 8 + 1) * 3) % 7 FROM e WHERE i % 8 < 7),
l AS (SELECT vec_id, part, r, ln(sum(exp(x))) - max(x) FILTER (c = gold) AS loss FROM p WHERE r < n GROUP BY vec_id, part, r),
m AS (SELECT vec_id, part, avg(loss) AS loss FROM l GROUP BY vec_id, part),
w AS (SELECT v.vec_id, coalesce(max(loss) FILTER (part = 'op'), 0) AS op, coalesce(max(loss) FILTER (part = 'st'), 0) + coalesce(max(loss) FILTER (part = 'ed'), 0) AS span,
             coalesce(max(loss) FILTER (part = 'pt'), 0) AS pt, coalesce(max(loss) FILTER (part = 'pm'), 0) AS pm
      FROM embeddings v LEFT JOIN m ON m.vec_id = v.vec_id GROUP BY v.vec_id)
SELECT vec_id, round(op, 6) AS op_loss, round(span, 6) AS span_loss, round(span / 2, 6) AS mean_span_loss, round(pt, 6) AS pointer_loss, round(pm, 6) AS masked_loss FROM w
"""


QUERIES = {"class_predictions": class_predictions, "topk_scores": topk_scores, "topk_cells": topk_cells,
           "pointer_decoding": pointer_decoding, "classification_metrics": classification_metrics,
           "spec_probability": spec_probability, "structured_losses": structured_losses}
ORACLE = {"class_predictions": SQL_CLASS_PREDICTIONS, "topk_scores": SQL_TOPK_SCORES, "topk_cells": SQL_TOPK_CELLS,
          "pointer_decoding": SQL_POINTER_DECODING, "classification_metrics": SQL_CLASSIFICATION_METRICS,
          "spec_probability": SQL_SPEC_PROBABILITY, "structured_losses": SQL_STRUCTURED_LOSSES}
