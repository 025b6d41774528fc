"""Mixing sources to target weights: hash-random keys, range order, prefix sums, exact cuts.

Every document gets a hash-random key. Within its source the keys are laid in
ascending equal-width ranges (the keys are uniform, so the ranges are even,
also inside a source that holds a third of all rows); words are summed a
range, running offsets are taken over those small sums, and inside a range a
window gives each document the words before it. A source's budget is cut
exactly there; a budget above the source's size repeats whole epochs first.

Defined cases: a null or empty text has size 0 and takes 0; a null source is a
source of its own, last in order; a null or repeated ``doc_id`` is a row like
any other, ordered by (key, id, size); an empty table gives no rows; columns
besides the three named ones are not looked at, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from taskprep.session import cut_lineage, read_table

WORD = r"[^\x20\x09-\x0D]+"
#: 60 bits of the key, of which the upper RANGE_BITS number the range
KEY_HEX, RANGE_BITS = 15, 12


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: Sequence[float], max_epochs: float) -> DataFrame:
    """One row a source: share of all words by weight, capped at ``max_epochs`` times its size.

    Sources are taken by ascending cap / weight. ``level`` is the words a unit
    of weight would get if exactly the sources before were capped; it exceeds a
    source's own ratio just for the capped ones, and the first source that
    stays below its cap gives the level that all uncapped ones share. One row a
    source reaches the single-partition windows.
    """
    src = sized.groupBy("src").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("src").asc_nulls_last())
    src = src.withColumn("src_no", F.row_number().over(order) - 1)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("src_no") % len(weights) + 1).cast("int"))
    src = src.withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), "src_no")
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    src = src.withColumn("all_words", F.sum("source_size").over(everything)).withColumn(
        "level",
        (F.col("all_words") - F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        / F.sum("w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
    src = src.withColumn("capped", F.col("cap") <= F.col("w") * F.col("level"))
    src = src.withColumn("shared", F.max(F.when(~F.col("capped"), F.col("level"))).over(everything))
    target = F.when(F.col("capped"), F.col("cap")).otherwise(F.col("w") * F.col("shared"))
    # a millionth of a word absorbs rounding, so that a target of 3 whole epochs is 3 whole epochs
    budget = F.floor(target + F.lit(1e-6)).cast("long")
    src = src.withColumn("target", target).withColumn("budget", budget)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    return src.withColumn("epochs", epochs).select(
        F.col("src").alias("t_src"), "src_no", "source_size", "target", "epochs",
        (F.col("budget") - F.col("epochs") * F.col("source_size")).alias("rest"))


def mix_sources(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source",
                weights: Sequence[float] = (1, 2, 3), max_epochs: float = 3, seed: str = "mix") -> DataFrame:
    """doc_id, source, size, source_size, target, taken, epochs: how many words of each document the mix takes.

    ``taken`` = ``epochs`` whole passes plus the document's part of the last,
    cut pass. Order and cut depend on ``seed`` and the ids alone.
    """
    key = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))), 1, KEY_HEX), 16, 10).cast("long")
    sized = docs.select(F.col(doc_id).alias("id"), F.col(source).alias("src"), word_count(F.col(text)).alias("size")).withColumn("key", key)
    sized = cut_lineage(sized)  # the texts are read once
    targets = source_targets(sized, weights, max_epochs)
    rows = sized.join(targets, F.col("src").eqNullSafe(F.col("t_src"))).drop("t_src")
    rows = rows.withColumn("part", F.shiftright("key", 4 * KEY_HEX - RANGE_BITS))
    sums = rows.groupBy("src_no", "part").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("src_no").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("src_no", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("off"))
    inside = Window.partitionBy("src_no", "part").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("off") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    last = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("rest") - F.col("at")))
    return (rows.join(offsets, ["src_no", "part"]).withColumn("at", at)
            .select(F.col("id").alias(doc_id), F.col("src").alias(source), "size", "source_size", "target",
                    (F.col("epochs") * F.col("size") + last).alias("taken"), "epochs"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS key
  FROM documents),
src AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS w
  FROM sized GROUP BY source),
lev AS (
  SELECT *, 3.0::DOUBLE * source_size AS cap,
         (sum(source_size) OVER () - coalesce(sum(3.0::DOUBLE * source_size) OVER (ORDER BY 3.0::DOUBLE * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (ORDER BY 3.0::DOUBLE * source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM src),
tgt AS (
  SELECT source, source_size,
         CASE WHEN cap <= w * level THEN cap ELSE w * max(CASE WHEN cap > w * level THEN level END) OVER () END AS target
  FROM lev),
bud AS (
  SELECT *, CAST(floor(target + 1e-6) AS BIGINT) AS budget,
         CASE WHEN source_size > 0 THEN CAST(floor(target + 1e-6) AS BIGINT) // source_size ELSE 0 END AS epochs FROM tgt),
cum AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM sized)
SELECT c.doc_id, c.size, b.source_size, b.target,
       CAST(b.epochs * c.size + greatest(0, least(c.size, b.budget - b.epochs * b.source_size - c.before)) AS BIGINT) AS taken
FROM cum c JOIN bud b ON c.source IS NOT DISTINCT FROM b.source
"""
