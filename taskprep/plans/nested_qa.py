"""Registered nested-QA queries on ``conversations``.

A conversation is a table (id ``c<conv_id>``, header = its sorted distinct
roles); its user turns are the questions, each answered by its own first 12
characters at offset 0. The nested export is flattened back with the QA JSON
reader's flattening.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taskprep.operators import specs as SP
from taskprep.session import read_table
from taskprep.sources import readers, sinks


def _tables_questions(spark: SparkSession, sf: str):
    conv = read_table(spark, sf, "conversations")
    tid = F.concat(F.lit("c"), F.col("conv_id").cast("string"))
    tables = conv.groupBy("conv_id").agg(F.sort_array(F.collect_set("role")).alias("header")).select(
        tid.alias("id"), "header")
    questions = conv.filter(F.col("role") == "user").select(
        tid.alias("table_id"), F.col("turn").alias("pos"), F.col("text").alias("question"),
        F.array(F.struct(F.substring("text", 1, 12).alias("text"), F.lit(0).alias("answer_start"))).alias("answers"))
    return tables, questions


def nested_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """K5 + J11 + A21 + W1 -> S4 + P4: export nested QA per table, flatten it back."""
    tables, questions = _tables_questions(spark, sf)
    nested = sinks.to_nested_qa(questions, tables)
    doc = nested.select("version", F.array(F.struct("title", "paragraphs")).alias("data"))
    flat = readers.flatten_qa(doc)
    return flat.select("id", "title", "context", "question",
                       F.array_join("answers.text", "|").alias("answer_text"),
                       F.array_join(F.transform("answers.answer_start", lambda x: x.cast("string")), ",")
                       .alias("answer_starts"))


def _ws(e: str) -> str:
    return f"regexp_replace({e}, '^\\s+|\\s+$', '', 'g')"


SQL_NESTED_ROUNDTRIP = f"""
WITH t AS (SELECT conv_id, list_sort(list(DISTINCT role)) AS header FROM conversations GROUP BY conv_id),
q AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n
      FROM conversations WHERE role = 'user')
SELECT 'c' || q.conv_id || '-' || q.n AS id, 'c' || q.conv_id AS title, {_ws("array_to_string(t.header, ' ')")} AS context,
       {_ws('q.text')} AS question, {_ws('substr(q.text, 1, 12)')} AS answer_text, '0' AS answer_starts
FROM q JOIN t ON t.conv_id = q.conv_id
"""


def attached_questions(spark: SparkSession, sf: str) -> DataFrame:
    """Every turn joined to its conversation's table; only conversations
    with an assistant turn have a table, the others are flagged missing."""
    conv = read_table(spark, sf, "conversations")
    tid = F.concat(F.lit("c"), F.col("conv_id").cast("string"))
    tables = conv.filter(F.col("role") == "assistant").groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n_answers")).select(tid.alias("id"), "n_answers")
    q = conv.select("conv_id", "turn", tid.alias("table_id"))
    out = SP.attach_tables(q, tables)
    return out.select("conv_id", "turn", "table_id", F.coalesce("n_answers", F.lit(0)).alias("n_answers"), "missing")


SQL_ATTACHED_QUESTIONS = """
WITH t AS (SELECT conv_id, count(*) AS n_answers FROM conversations WHERE role = 'assistant' GROUP BY conv_id)
SELECT c.conv_id, c.turn, 'c' || c.conv_id AS table_id, coalesce(t.n_answers, 0) AS n_answers,
       t.conv_id IS NULL AS missing
FROM conversations c LEFT JOIN t ON t.conv_id = c.conv_id
"""

QUERIES = {"nested_roundtrip": nested_roundtrip, "attached_questions": attached_questions}
ORACLE = {"nested_roundtrip": SQL_NESTED_ROUNDTRIP, "attached_questions": SQL_ATTACHED_QUESTIONS}
