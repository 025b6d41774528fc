"""Registered queries of the text-classification flow on the driver's tables.

``documents`` stands in for review corpora (``source`` = task), ``labels``
for class labels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taskprep.operators import clean, tasks
from taskprep.plans import sqltext as S
from taskprep.session import read_table, spread

SEED = 42
SAMPLE_PER_TASK = 10


def _labelled_docs(spark: SparkSession, sf: str) -> DataFrame:
    docs = spread(read_table(spark, sf, "documents").select("doc_id", "source", "text"))
    prepared = clean.prepare_text(docs, "text")
    labels = read_table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"))
    return prepared.join(labels, "doc_id")


def task_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship: clean -> length filter -> label join -> exact per-task sample ->
    majority-label prediction -> accuracy per task."""
    # the cleaned text is only needed for the length filter: keep the small
    # projection once instead of re-running the regex chain in both sampling passes
    labelled = _labelled_docs(spark, sf).select("doc_id", "source", "label").persist()
    sampled = tasks.sample_exact(labelled, SAMPLE_PER_TASK, SEED, "doc_id", by="source", strict=False)
    counts = sampled.groupBy("source", "label").agg(F.count(F.lit(1)).alias("c"))
    majority = counts.groupBy("source").agg(
        F.max_by("label", F.struct(F.col("c"), -F.col("label"))).alias("majority"))
    scored = sampled.join(majority, "source").withColumn("pred", F.col("majority"))
    return scored.groupBy("source", "majority").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg((F.col("pred") == F.col("label")).cast("double")), 6).alias("accuracy"))


def _sql_labelled() -> str:
    return f"""
      SELECT d.doc_id, d.source, {S.clean_text('d.text')} AS text, l.quality AS label
      FROM documents d JOIN labels l ON l.doc_id = d.doc_id
      WHERE d.text IS NOT NULL AND d.text NOT IN ({_na_sql()})
        AND length({S.clean_text('d.text')}) >= 20"""


def _na_sql() -> str:
    from taskprep.functions.text import NA_TOKENS
    return ", ".join("'" + t.replace("'", "''") + "'" for t in NA_TOKENS)


SQL_TASK_ACCURACY = f"""
WITH lab AS ({_sql_labelled()}),
samp AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY source ORDER BY {S.seeded_md5(SEED, 'doc_id')}, doc_id) AS rn
    FROM lab) WHERE rn <= {SAMPLE_PER_TASK}),
cnt AS (SELECT source, label, count(*) AS c FROM samp GROUP BY source, label),
maj AS (SELECT source, arg_max(label, c * 1000000 - label) AS majority FROM cnt GROUP BY source)
SELECT s.source, m.majority, CAST(count(*) AS BIGINT) AS n,
       round(avg(CASE WHEN m.majority = s.label THEN 1.0 ELSE 0.0 END), 6) AS accuracy
FROM samp s JOIN maj m ON m.source = s.source
GROUP BY s.source, m.majority
"""


def clean_documents(spark: SparkSession, sf: str) -> DataFrame:
    """P1 + F1 + F2: cleaned text of every document and whether it passes the length filter."""
    docs = spread(read_table(spark, sf, "documents").select("doc_id", "text"))
    c = clean.drop_missing(docs, ["text"]).withColumn("text_clean", F.col("text"))
    c = clean.clean_column(c, "text_clean")
    return c.select("doc_id", "text_clean", (F.char_length("text_clean") >= clean.MIN_CLEAN_LENGTH).alias("keep"))


SQL_CLEAN_DOCUMENTS = f"""
SELECT doc_id, {S.clean_text('text')} AS text_clean, length({S.clean_text('text')}) >= 20 AS keep
FROM documents WHERE text IS NOT NULL AND text NOT IN ({_na_sql()})
"""


def prepared_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Cleaned content + ``[SEP]`` + raw second field (here the source name);
    the length filter sees only the cleaned content."""
    docs = spread(read_table(spark, sf, "documents").select("doc_id", "text", "source"))
    out = clean.prepare_text(docs, "text", extra="source")
    return out.select("doc_id", F.col("text").alias("content"))


SQL_PREPARED_ROWS = f"""
SELECT doc_id, {S.clean_text('text')} || '[SEP]' || source AS content
FROM documents
WHERE text IS NOT NULL AND text NOT IN ({_na_sql()}) AND source IS NOT NULL AND source NOT IN ({_na_sql()})
  AND length({S.clean_text('text')}) >= 20
"""


def label_offsets(spark: SparkSession, sf: str) -> DataFrame:
    """U1 + W4 (+P3): tasks in name order, disjoint label ranges by running class counts."""
    lab = _labelled_docs(spark, sf)
    out = tasks.offset_labels(lab, "source", "label", "label_offset")
    return out.select("doc_id", "source", "task_no", "offset", "label_offset",
                      tasks_shift(F.col("label_offset") + 1).alias("label_zero_based"))


def tasks_shift(c):
    from taskprep.functions.text import shift_label
    return shift_label(c, -1)


SQL_LABEL_OFFSETS = f"""
WITH lab AS ({_sql_labelled()}),
pt AS (SELECT source, count(DISTINCT label) AS n_classes FROM lab GROUP BY source),
po AS (SELECT source, CAST(dense_rank() OVER (ORDER BY source) - 1 AS INTEGER) AS task_no,
              CAST(coalesce(sum(n_classes) OVER (ORDER BY source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
                   AS BIGINT) AS "offset"
       FROM pt)
SELECT lab.doc_id, lab.source, po.task_no, po."offset", lab.label + po."offset" AS label_offset,
       lab.label + po."offset" AS label_zero_based
FROM lab JOIN po ON po.source = lab.source
"""


def task_union(spark: SparkSession, sf: str) -> DataFrame:
    """U2 + U3: every language is a task with shared labels, in one pass over the documents."""
    docs = spread(read_table(spark, sf, "documents").select("doc_id", "lang", "text"))
    labels = read_table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"))
    union = tasks.as_tasks(clean.prepare_text(docs, "text").join(labels, "doc_id"), "lang")
    return union.groupBy("task", "task_no").agg(F.count(F.lit(1)).alias("n"), F.sum("label").cast("long").alias("n_positive"))


SQL_TASK_UNION = f"""
WITH lab AS ({_sql_labelled()}),
j AS (SELECT d.lang AS task, lab.label FROM lab JOIN documents d ON d.doc_id = lab.doc_id WHERE d.lang IS NOT NULL),
no AS (SELECT task, CAST(row_number() OVER (ORDER BY task) - 1 AS INTEGER) AS task_no FROM (SELECT DISTINCT task FROM j))
SELECT j.task, no.task_no, CAST(count(*) AS BIGINT) AS n, CAST(sum(j.label) AS BIGINT) AS n_positive
FROM j JOIN no USING (task) GROUP BY j.task, no.task_no
"""


def union_with_offsets(spark: SparkSession, sf: str) -> DataFrame:
    """Two label tables as tasks, the second one's labels after the first one's."""
    quality = read_table(spark, sf, "labels").select(F.col("doc_id").alias("item"), F.col("quality").cast("long").alias("label"))
    vectors = read_table(spark, sf, "embeddings").select(F.col("vec_id").alias("item"), F.col("label").cast("long").alias("label"))
    out = tasks.union_tasks([("quality", quality), ("vectors", vectors)], n_classes={"quality": 2, "vectors": 10})
    return out.select("task", "task_no", "item", "label")


SQL_UNION_WITH_OFFSETS = """
SELECT 'quality' AS task, 0 AS task_no, doc_id AS item, CAST(quality AS BIGINT) AS label FROM labels
UNION ALL SELECT 'vectors', 1, vec_id, CAST(label AS BIGINT) + 2 FROM embeddings
"""


def sample_per_task(spark: SparkSession, sf: str) -> DataFrame:
    """Exactly 20 documents per source by seeded hash order."""
    docs = read_table(spark, sf, "documents").select("doc_id", "source")
    return tasks.sample_exact(docs, 20, SEED, "doc_id", by="source", strict=True)


SQL_SAMPLE_PER_TASK = f"""
SELECT doc_id, source FROM (
  SELECT doc_id, source,
         row_number() OVER (PARTITION BY source ORDER BY {S.seeded_md5(SEED, 'doc_id')}, doc_id) AS rn
  FROM documents) WHERE rn <= 20
"""


def split_validation(spark: SparkSession, sf: str) -> DataFrame:
    """ceil(0.125 * n) rows of each source to validation, the rest to train."""
    docs = read_table(spark, sf, "documents").select("doc_id", "source")
    return tasks.train_test_split(docs, 0.125, 2020, "doc_id", by="source")


SQL_SPLIT_VALIDATION = f"""
SELECT doc_id, source, CASE WHEN rn <= ceil(0.125 * n) THEN 'validation' ELSE 'train' END AS split FROM (
  SELECT doc_id, source,
         row_number() OVER (PARTITION BY source ORDER BY {S.seeded_md5(2020, 'doc_id')}, doc_id) AS rn,
         count(*) OVER (PARTITION BY source) AS n
  FROM documents)
"""


def shuffle_head_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Seeded shuffle of all orders, first 500."""
    o = read_table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return tasks.shuffle_head(o, 500, 7, "o_orderkey")


SQL_SHUFFLE_HEAD_ORDERS = f"""
SELECT o_orderkey, o_custkey FROM orders
ORDER BY {S.seeded_md5(7, 'o_orderkey')}, o_orderkey LIMIT 500
"""


def batches_in_order(spark: SparkSession, sf: str) -> DataFrame:
    """X5 (eval): batches of 32 in document order; last batch kept short."""
    docs = read_table(spark, sf, "documents").select("doc_id")
    return tasks.assign_batches(docs, 32, order="doc_id").select("doc_id", "position", "batch")


SQL_BATCHES_IN_ORDER = """
SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS position,
       CAST(floor((row_number() OVER (ORDER BY doc_id) - 1) / 32) AS BIGINT) AS batch
FROM documents
"""


def batches_shuffled(spark: SparkSession, sf: str) -> DataFrame:
    """X5 (train): batches of 16 per source in seeded shuffled order."""
    docs = read_table(spark, sf, "documents").select("doc_id", "source")
    return tasks.assign_batches(docs, 16, seed=SEED, key="doc_id", by="source").select(
        "doc_id", "source", "position", "batch")


SQL_BATCHES_SHUFFLED = f"""
SELECT doc_id, source, rn AS position, CAST(floor((rn - 1) / 16) AS BIGINT) AS batch FROM (
  SELECT doc_id, source,
         row_number() OVER (PARTITION BY source ORDER BY {S.seeded_md5(SEED, 'doc_id')}, doc_id) AS rn
  FROM documents)
"""


def mix_sources(spark: SparkSession, sf: str) -> DataFrame:
    """X3 + H4: 200 steps x 4 rows, task drawn with p ~ size^0.4."""
    docs = read_table(spark, sf, "documents").select("doc_id", "source")
    return tasks.mix_tasks(docs, "source", "doc_id", steps=200, batch=4, seed=SEED).select(
        "step", "slot", "source", "doc_id")


SQL_MIX_SOURCES = f"""
WITH sizes AS (SELECT source, count(*) AS size FROM documents GROUP BY source),
w AS (SELECT source, size, pow(size, 0.4) / sum(pow(size, 0.4)) OVER () AS p FROM sizes),
c AS (SELECT source, size, sum(p) OVER (ORDER BY source ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hi,
             p FROM w),
r AS (SELECT source, size, hi - p AS lo, hi FROM c),
steps AS (SELECT range AS step, {S.uniform_hash(SEED, 'range')} AS u FROM range(200)),
picked AS (SELECT s.step, r.source, r.size FROM steps s JOIN r ON s.u >= r.lo AND s.u < r.hi),
slots AS (SELECT p.step, sl.slot, p.source,
                 CAST(floor({S.uniform_hash(SEED, 'p.step', 'sl.slot')} * p.size) + 1 AS BIGINT) AS "row"
          FROM picked p, (SELECT range AS slot FROM range(4)) sl),
numbered AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS "row" FROM documents)
SELECT s.step, CAST(s.slot AS INTEGER) AS slot, s.source, n.doc_id FROM slots s JOIN numbered n ON n.source = s.source AND n."row" = s."row"
"""


def label_index_events(spark: SparkSession, sf: str) -> DataFrame:
    """P6 + A19: ascending distinct labels -> index, and the number of classes."""
    ev = read_table(spark, sf, "events").select("event_type")
    return tasks.label_set(ev, "event_type").select("event_type", "label_id", "num_labels")


SQL_LABEL_INDEX_EVENTS = """
SELECT event_type, CAST(row_number() OVER (ORDER BY event_type) - 1 AS INTEGER) AS label_id,
       count(*) OVER () AS num_labels
FROM (SELECT DISTINCT event_type FROM events WHERE event_type IS NOT NULL)
"""


def head_orders(spark: SparkSession, sf: str) -> DataFrame:
    """F8: toy subset, the first 100 orders by key."""
    o = read_table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return tasks.head_rows(o, 100, "o_orderkey")


SQL_HEAD_ORDERS = "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 100"


QUERIES = {
    "task_accuracy": task_accuracy,
    "clean_documents": clean_documents,
    "prepared_rows": prepared_rows,
    "label_offsets": label_offsets,
    "task_union": task_union, "union_with_offsets": union_with_offsets,
    "sample_per_task": sample_per_task,
    "split_validation": split_validation,
    "shuffle_head_orders": shuffle_head_orders,
    "batches_in_order": batches_in_order,
    "batches_shuffled": batches_shuffled,
    "mix_sources": mix_sources,
    "label_index_events": label_index_events,
    "head_orders": head_orders,
}

ORACLE = {
    "task_accuracy": SQL_TASK_ACCURACY,
    "clean_documents": SQL_CLEAN_DOCUMENTS,
    "prepared_rows": SQL_PREPARED_ROWS,
    "label_offsets": SQL_LABEL_OFFSETS,
    "task_union": SQL_TASK_UNION, "union_with_offsets": SQL_UNION_WITH_OFFSETS,
    "sample_per_task": SQL_SAMPLE_PER_TASK,
    "split_validation": SQL_SPLIT_VALIDATION,
    "shuffle_head_orders": SQL_SHUFFLE_HEAD_ORDERS,
    "batches_in_order": SQL_BATCHES_IN_ORDER,
    "batches_shuffled": SQL_BATCHES_SHUFFLED,
    "mix_sources": SQL_MIX_SOURCES,
    "label_index_events": SQL_LABEL_INDEX_EVENTS,
    "head_orders": SQL_HEAD_ORDERS,
}
