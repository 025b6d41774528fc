"""Registered QA-scoring queries on ``conversations``.

Prediction of a conversation = its assistant turns (the last one wins,
duplicates by id); references = its user turns. Conversations with user
turns but no assistant turn are unanswered and score 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taskprep.functions.text import normalize_answer
from taskprep.operators import metrics
from taskprep.plans import sqltext as S
from taskprep.session import read_table, spread


def _refs_preds(spark: SparkSession, sf: str):
    conv = spread(read_table(spark, sf, "conversations").select("conv_id", "turn", "role", "text"))
    refs = conv.filter(F.col("role") == "user").select(
        F.col("conv_id").alias("id"), F.col("turn").alias("ref_no"), F.col("text").alias("answer_text"))
    preds = conv.filter(F.col("role") == "assistant").select(
        F.col("conv_id").alias("id"), F.col("turn").alias("pos"), F.col("text").alias("prediction_text"))
    return refs, preds


def normalized_turns(spark: SparkSession, sf: str) -> DataFrame:
    """P14 on every turn."""
    conv = read_table(spark, sf, "conversations")
    return conv.select("conv_id", "turn", normalize_answer("text").alias("normalized"))


SQL_NORMALIZED_TURNS = f"SELECT conv_id, turn, {S.normalize_answer('text')} AS normalized FROM conversations"


def qa_example_scores(spark: SparkSession, sf: str) -> DataFrame:
    """A11-A13 + J3: best EM and F1 per conversation over its references."""
    refs, preds = _refs_preds(spark, sf)
    ex = metrics.qa_example_scores(refs, preds, "id")
    return ex.select("id", F.round("exact_match", 6).alias("exact_match"), F.round("f1", 6).alias("f1"))


_SQL_PAIRS = f"""
refs AS (SELECT conv_id AS id, turn AS ref_no, text AS ref FROM conversations WHERE role = 'user'),
preds AS (SELECT conv_id AS id, arg_max(text, turn) AS pred FROM conversations WHERE role = 'assistant'
          GROUP BY conv_id),
pairs AS (SELECT r.id, r.ref_no, r.ref, p.pred, {S.answer_tokens('r.ref')} AS rt, {S.answer_tokens('p.pred')} AS pt
          FROM refs r LEFT JOIN preds p ON p.id = r.id),
rtok AS (SELECT id, ref_no, t, count(*) AS c FROM (SELECT id, ref_no, unnest(rt) AS t FROM pairs) GROUP BY id, ref_no, t),
ptok AS (SELECT id, t, count(*) AS c FROM (SELECT id, unnest({S.answer_tokens('pred')}) AS t FROM preds) GROUP BY id, t),
common AS (SELECT r.id, r.ref_no, sum(least(r.c, p.c)) AS common FROM rtok r JOIN ptok p ON p.id = r.id AND p.t = r.t
           GROUP BY r.id, r.ref_no),
scored AS (
  SELECT pairs.id, pairs.ref_no,
         CASE WHEN pred IS NOT NULL AND array_to_string(pt, ' ') = array_to_string(rt, ' ') THEN 1.0::DOUBLE
              ELSE 0.0::DOUBLE END AS em,
         CASE WHEN pred IS NULL OR coalesce(common, 0) = 0 THEN 0.0
              ELSE 2 * (common / len(pt)) * (common / len(rt)) / ((common / len(pt)) + (common / len(rt))) END AS f1
  FROM pairs LEFT JOIN common ON common.id = pairs.id AND common.ref_no = pairs.ref_no),
per_id AS (SELECT id, max(em) AS em, max(f1) AS f1 FROM scored GROUP BY id)
"""

SQL_QA_EXAMPLE_SCORES = f"""
WITH {_SQL_PAIRS}
SELECT id, round(em, 6) AS exact_match, round(f1, 6) AS f1 FROM per_id
"""


def qa_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Corpus EM and F1 in percent over all reference ids."""
    refs, preds = _refs_preds(spark, sf)
    s = metrics.qa_scores(refs, preds, "id")
    return s.select(F.round("exact_match", 6).alias("exact_match"), F.round("f1", 6).alias("f1"), "total")


SQL_QA_SCORES = f"""
WITH {_SQL_PAIRS}
SELECT round(100.0 * sum(em) / count(*), 6) AS exact_match, round(100.0 * sum(f1) / count(*), 6) AS f1,
       CAST(count(*) AS BIGINT) AS total
FROM per_id
"""


def token_overlap_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """U4: multiset intersection size of every (conversation, reference) pair."""
    refs, preds = _refs_preds(spark, sf)
    p = metrics.dedupe_predictions(preds, "id", "pos", "prediction_text")
    ov = metrics.token_overlap(refs, p, "id", "ref_no", "answer_text", "prediction_text")
    return ov.select("id", "ref_no", F.col("common").cast("long").alias("common"))


SQL_TOKEN_OVERLAP_PAIRS = f"""
WITH {_SQL_PAIRS}
SELECT id, ref_no, CAST(common AS BIGINT) AS common FROM common
"""


QUERIES = {
    "normalized_turns": normalized_turns,
    "qa_example_scores": qa_example_scores,
    "qa_scores": qa_scores,
    "token_overlap_pairs": token_overlap_pairs,
}
ORACLE = {
    "normalized_turns": SQL_NORMALIZED_TURNS,
    "qa_example_scores": SQL_QA_EXAMPLE_SCORES,
    "qa_scores": SQL_QA_SCORES,
    "token_overlap_pairs": SQL_TOKEN_OVERLAP_PAIRS,
}
