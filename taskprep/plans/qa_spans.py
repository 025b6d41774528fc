"""Registered n-best span queries.

Windows come from ``embeddings``: start scores = a row's vector, end scores =
the next row's vector (its own for the last row), window = ``vec_id``, example = ``vec_id div 5``, the
context = the document with that id. The first 8 positions of a window are
question tokens (no offset); position i >= 8 covers 5 characters at
``(vec_id % 5) * 100 + (i - 8) * 6`` of the context.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taskprep.operators import spans
from taskprep.session import read_table

QUESTION_TOKENS = 8


def windows(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    e = read_table(spark, sf, "embeddings").select("vec_id", "embedding")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("end_logits"))
    base = (F.col("vec_id") % 5) * 100
    offsets = F.transform(F.sequence(F.lit(0), F.size("embedding") - 1), lambda i: F.when(
        i >= QUESTION_TOKENS, F.struct((base + (i - QUESTION_TOKENS) * 6).alias("st"),
                                       (base + (i - QUESTION_TOKENS) * 6 + 5).alias("ed"))))
    feats = e.join(nxt, "vec_id", "left").withColumn("end_logits", F.coalesce("end_logits", "embedding")).select(
        F.col("vec_id").alias("feature_id"), F.floor(F.col("vec_id") / 5).cast("long").alias("example_id"),
        F.col("vec_id").alias("window_no"),
        F.transform("embedding", lambda x: x.cast("double")).alias("start_logits"),
        F.transform("end_logits", lambda x: x.cast("double")).alias("end_logits"), offsets.alias("offsets"))
    docs = read_table(spark, sf, "documents").select(F.col("doc_id").alias("example_id"), F.col("text").alias("context"))
    examples = docs.join(feats.select("example_id").distinct(), "example_id", "left_semi")
    return examples, feats


def nbest(spark: SparkSession, sf: str) -> DataFrame:
    """R1 (+J2, J8, F5, W2, W3): the 20 best spans per example with probabilities."""
    ex, ft = windows(spark, sf)
    nb, _ = spans.nbest_spans(ex, ft)
    return nb.select("example_id", F.col("rank").cast("int").alias("rank"), "text",
                     F.round("score", 6).alias("score"), F.round("probability", 6).alias("probability"))


def best_answers(spark: SparkSession, sf: str) -> DataFrame:
    ex, ft = windows(spark, sf)
    _, best = spans.nbest_spans(ex, ft)
    return best


def best_answers_null(spark: SparkSession, sf: str) -> DataFrame:
    """R1 null-answer mode (+A20): best non-empty text vs the minimum null score."""
    ex, ft = windows(spark, sf)
    _, best = spans.nbest_spans(ex, ft, allow_null=True, threshold=0.0)
    return best.select("example_id", "prediction_text", F.round("score_diff", 6).alias("score_diff"))


def null_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Minimum start[0] + end[0] over each example's windows."""
    _, ft = windows(spark, sf)
    return spans.min_null_scores(ft).select("example_id", F.round("null_score", 6).alias("null_score"),
                                            F.round("null_start_logit", 6).alias("null_start_logit"))


_SQL_BASE = """
f AS (SELECT e.vec_id AS fid, e.vec_id // 5 AS example_id, e.vec_id AS window_no, e.embedding AS sl, coalesce(e2.embedding, e.embedding) AS el
      FROM embeddings e LEFT JOIN embeddings e2 ON e2.vec_id = e.vec_id + 1),
sx AS (SELECT fid, example_id, window_no, i - 1 AS idx, CAST(x AS DOUBLE) AS v
       FROM (SELECT fid, example_id, window_no, unnest(sl) AS x, generate_subscripts(sl, 1) AS i FROM f)),
ex AS (SELECT fid, example_id, window_no, i - 1 AS idx, CAST(x AS DOUBLE) AS v
       FROM (SELECT fid, example_id, window_no, unnest(el) AS x, generate_subscripts(el, 1) AS i FROM f)),
stop AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fid ORDER BY v DESC, idx DESC) - 1 AS r FROM sx)
         WHERE r < 20),
etop AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fid ORDER BY v DESC, idx DESC) - 1 AS r FROM ex)
         WHERE r < 20),
pairs AS (SELECT a.example_id, a.window_no, a.r AS start_rank, b.r AS end_rank, a.v AS start_logit, b.v AS end_logit,
                 a.v + b.v AS score, (a.window_no % 5) * 100 + (a.idx - 8) * 6 AS st,
                 (a.window_no % 5) * 100 + (b.idx - 8) * 6 + 5 AS ed, FALSE AS is_null
          FROM stop a JOIN etop b ON a.fid = b.fid
          WHERE a.idx >= 8 AND b.idx >= 8 AND b.idx >= a.idx AND b.idx - a.idx + 1 <= 30),
nul AS (SELECT example_id, arg_min(CAST(sl[1] AS DOUBLE) + CAST(el[1] AS DOUBLE), [CAST(sl[1] AS DOUBLE) + CAST(el[1] AS DOUBLE), window_no]) AS null_score,
               arg_min(CAST(sl[1] AS DOUBLE), [CAST(sl[1] AS DOUBLE) + CAST(el[1] AS DOUBLE), window_no]) AS null_start,
               arg_min(CAST(el[1] AS DOUBLE), [CAST(sl[1] AS DOUBLE) + CAST(el[1] AS DOUBLE), window_no]) AS null_end
        FROM f GROUP BY example_id)"""

_SQL_NBEST = _SQL_BASE + """,
kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY example_id ORDER BY score DESC, window_no,
                                                     start_rank, end_rank) AS rk FROM pairs) WHERE rk <= 20),
txt AS (SELECT k.example_id, k.rk, substr(d.text, k.st + 1, k.ed - k.st) AS text, k.score
        FROM kept k JOIN documents d ON d.doc_id = k.example_id),
st AS (SELECT e.example_id, count(t.rk) AS k, coalesce(bool_or(t.text <> ''), FALSE) AS any_text
       FROM (SELECT DISTINCT example_id FROM f) e LEFT JOIN txt t ON t.example_id = e.example_id GROUP BY e.example_id),
allr AS (SELECT example_id, rk, text, score FROM txt
         UNION ALL SELECT example_id, 0, 'empty', 0.0 FROM st WHERE k = 0 OR (k = 1 AND NOT any_text)),
prob AS (SELECT example_id, rk, text, score,
                exp(score - max(score) OVER (PARTITION BY example_id)) AS ex FROM allr),
nb AS (SELECT example_id, CAST(row_number() OVER (PARTITION BY example_id ORDER BY rk) - 1 AS INTEGER) AS rank, text,
              score, ex / sum(ex) OVER (PARTITION BY example_id) AS probability FROM prob)"""

SQL_NBEST = "WITH " + _SQL_NBEST + """
SELECT example_id, rank, text, round(score, 6) AS score, round(probability, 6) AS probability FROM nb"""

SQL_BEST = "WITH " + _SQL_NBEST + """
SELECT example_id, text AS prediction_text FROM nb WHERE rank = 0"""

SQL_NULL_SCORES = "WITH " + _SQL_BASE + """
SELECT example_id, round(null_score, 6) AS null_score, round(null_start, 6) AS null_start_logit FROM nul"""

SQL_BEST_NULL = "WITH " + _SQL_BASE + """,
cand AS (SELECT example_id, window_no, start_rank, end_rank, start_logit, end_logit, score, st, ed FROM pairs
         UNION ALL SELECT example_id, 4611686018427387904, 0, 0, null_start, null_end, null_score, 0, 0 FROM nul),
ranked AS (SELECT *, row_number() OVER (PARTITION BY example_id ORDER BY score DESC, window_no, start_rank,
                                        end_rank) AS rk FROM cand),
kept AS (SELECT * FROM ranked WHERE rk <= 20
         UNION ALL SELECT r.* REPLACE (21 AS rk) FROM ranked r
         WHERE r.window_no = 4611686018427387904 AND r.rk > 20
           AND NOT EXISTS (SELECT 1 FROM ranked q WHERE q.example_id = r.example_id AND q.rk <= 20
                           AND q.st = 0 AND q.ed = 0)),
txt AS (SELECT k.*, substr(d.text, k.st + 1, k.ed - k.st) AS text FROM kept k JOIN documents d ON d.doc_id = k.example_id),
b AS (SELECT example_id, arg_min(text, rk) AS text, arg_min(start_logit + end_logit, rk) AS se
      FROM txt WHERE text <> '' GROUP BY example_id),
e AS (SELECT DISTINCT example_id FROM f)
SELECT e.example_id, CASE WHEN b.text IS NULL OR n.null_score - b.se > 0.0 THEN '' ELSE b.text END AS prediction_text,
       round(n.null_score - b.se, 6) AS score_diff
FROM e LEFT JOIN b ON b.example_id = e.example_id LEFT JOIN nul n ON n.example_id = e.example_id"""


def nbest_ranked(spark: SparkSession, sf: str) -> DataFrame:
    """R2 + J9: candidates from the 5 best starts and, for each, ends of its own:
    the i-th best start takes the i-th to (i + 4)-th best ends (end j of start i
    at i * 5 + j); empty -> "" scored -2e-6."""
    ex, ft = windows(spark, sf)
    s_idx = spans.top_indices("start_logits", 5)
    e_top = spans.top_indices("end_logits", 9)
    e_idx = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.slice(e_top, i + 1, 5)))
    ft = ft.select(
        "feature_id", "example_id", "window_no", "offsets",
        s_idx.alias("start_index"), F.transform(s_idx, lambda i: F.element_at("start_logits", i + 1)).alias(
            "start_log_prob"),
        e_idx.alias("end_index"),
        F.transform(e_idx, lambda i: F.element_at("end_logits", i + 1)).alias("end_log_prob"),
        F.element_at("start_logits", 1).alias("cls_logit"))
    nb, _ = spans.nbest_spans_ranked(ex, ft, 5, 5)
    return nb.select("example_id", F.col("rank").cast("int").alias("rank"), "text",
                     F.round("score", 6).alias("score"), F.round("probability", 6).alias("probability"))


SQL_NBEST_RANKED = "WITH " + _SQL_BASE + """,
pr AS (SELECT *, end_rank - start_rank AS ej FROM pairs WHERE start_rank < 5 AND end_rank - start_rank BETWEEN 0 AND 4),
kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY example_id ORDER BY score DESC, window_no,
                                                     start_rank, ej) - 1 AS rk FROM pr) WHERE rk < 20),
txt AS (SELECT k.example_id, k.rk, substr(d.text, k.st + 1, k.ed - k.st) AS text, k.score
        FROM kept k JOIN documents d ON d.doc_id = k.example_id),
allr AS (SELECT example_id, rk, text, score FROM txt
         UNION ALL SELECT e.example_id, 0, '', -2e-6 FROM (SELECT DISTINCT example_id FROM f) e
         WHERE e.example_id NOT IN (SELECT example_id FROM txt)),
prob AS (SELECT *, exp(score - max(score) OVER (PARTITION BY example_id)) AS ex FROM allr)
SELECT example_id, CAST(rk AS INTEGER) AS rank, text, round(score, 6) AS score,
       round(ex / sum(ex) OVER (PARTITION BY example_id), 6) AS probability
FROM prob
"""


STRIDE = 20


def nbest_max_context(spark: SparkSession, sf: str) -> DataFrame:
    """R1 with F5's flag: the windows of an example start 20 tokens apart (a token
    is 5 characters and a space), and a start needs the most context."""
    ex, ft = windows(spark, sf)
    first = ((F.col("window_no") % 5) * STRIDE).cast("int")
    ft = ft.withColumn("ctx_start", first).withColumn("ctx_len", F.size("start_logits") - QUESTION_TOKENS)
    ft = ft.withColumn("offsets", F.transform("start_logits", lambda _, i: F.when(i >= QUESTION_TOKENS, F.struct(
        ((F.col("ctx_start") + i - QUESTION_TOKENS) * 6).alias("st"), ((F.col("ctx_start") + i - QUESTION_TOKENS) * 6 + 5).alias("ed")))))
    nb, _ = spans.nbest_spans(ex, spans.mark_max_context(ft, first_position=QUESTION_TOKENS))
    return nb.select("example_id", F.col("rank").cast("int").alias("rank"), "text",
                     F.round("score", 6).alias("score"), F.round("probability", 6).alias("probability"))


#: the windows' tokens one by one, and the window of each token that leaves most on its shorter side
SQL_NBEST_MAX_CONTEXT = ("WITH " + _SQL_NBEST.replace("(a.window_no % 5) * 100", "(a.window_no % 5) * 120").replace(
    "b.idx - a.idx + 1 <= 30)", "b.idx - a.idx + 1 <= 30 AND (a.window_no, a.idx) IN (SELECT window_no, idx FROM mx))").replace("pairs AS (", """
tok AS (SELECT example_id, window_no, (window_no % 5) * 20 AS s, i + 8 AS idx, (window_no % 5) * 20 + i AS t FROM f, range(56) r(i)),
mx AS (SELECT window_no, idx FROM (SELECT *, row_number() OVER (PARTITION BY example_id, t ORDER BY least(t - s, s + 55 - t) DESC, window_no) AS r FROM tok) WHERE r = 1),
pairs AS (""", 1) + """
SELECT example_id, rank, text, round(score, 6) AS score, round(probability, 6) AS probability FROM nb""")


QUERIES = {"nbest_ranked": nbest_ranked, "nbest_spans": nbest, "nbest_max_context": nbest_max_context, "best_answers": best_answers, "best_answers_null": best_answers_null,
           "null_scores": null_scores}
ORACLE = {"nbest_ranked": SQL_NBEST_RANKED, "nbest_spans": SQL_NBEST, "nbest_max_context": SQL_NBEST_MAX_CONTEXT, "best_answers": SQL_BEST, "best_answers_null": SQL_BEST_NULL,
          "null_scores": SQL_NULL_SCORES}
