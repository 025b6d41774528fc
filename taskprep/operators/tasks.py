"""Task assembly: labels, unions, offsets, samples, splits, batches, mixing.

P3, P6, U1-U3, W4, X1-X5, F8, H4.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taskprep.operators.order import hex_bucket, prefix_rows, ranked, seeded_hash

# Sizes of the original text-classification flow.
TRAIN_ROWS_PER_TASK = 115_000
TEST_ROWS_PER_TASK = 7_600
MIX_ALPHA = 0.4
RANGE_BUCKETS = 4096


def union_tasks(parts: Mapping[str, DataFrame] | Sequence[tuple[str, DataFrame]], label: str = "label",
                n_classes: Mapping[str, int] | None = None, offset: bool = True) -> DataFrame:
    """Union of task DataFrames in the given order, adding ``task`` and ``task_no``.

    With ``offset`` each task's labels are shifted by the number of classes of
    the tasks before it (disjoint label ranges); without it labels are shared.
    """
    items = list(parts.items()) if isinstance(parts, Mapping) else list(parts)
    out = None
    running = 0
    for no, (name, df) in enumerate(items):
        d = df.withColumn("task", F.lit(name)).withColumn("task_no", F.lit(no))
        if offset:
            d = d.withColumn(label, F.col(label) + F.lit(running))
            if n_classes is None:
                raise ValueError("offset=True needs n_classes per task")
            running += int(n_classes[name])
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out


def as_tasks(df: DataFrame, column: str) -> DataFrame:
    """Every value of ``column`` is a task: adds ``task`` and its number in name
    order (rows without a value belong to none), reading the rows once."""
    named = df.filter(F.col(column).isNotNull()).withColumn("task", F.col(column))
    numbers = named.select("task").distinct().withColumn("task_no", F.row_number().over(Window.orderBy("task")) - 1)
    return named.join(numbers, "task")


def class_offsets(task_classes: DataFrame, order: str = "task_no", n: str = "n_classes") -> DataFrame:
    """``offset`` = sum of class counts of all earlier tasks (one row per task)."""
    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return task_classes.withColumn("offset", F.coalesce(F.sum(n).over(w), F.lit(0)).cast("long"))


def offset_labels(df: DataFrame, task: str, label: str, out: str = "label_offset") -> DataFrame:
    """Disjoint label ranges by data: classes per task are the observed distinct
    labels, tasks ordered by name, offsets = running sum of earlier class counts.
    The per-task table has one row per task; the planner broadcasts it by its
    size."""
    per_task = (df.groupBy(task).agg(F.countDistinct(label).alias("n_classes"))
                .withColumn("task_no", F.dense_rank().over(Window.orderBy(task)) - 1))
    offs = class_offsets(per_task).select(task, "task_no", "n_classes", "offset")
    return df.join(offs, task).withColumn(out, F.col(label) + F.col("offset"))


def label_index(df: DataFrame, label: str = "label", out: str = "label_id") -> DataFrame:
    """Map labels to 0-based indexes of the ascending distinct label list.

    Float labels mean regression: returned unchanged with ``out`` = label.
    """
    dtype = df.schema[label].dataType
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return df.withColumn(out, F.col(label))
    distinct = df.select(label).where(F.col(label).isNotNull()).distinct()
    idx = ranked(distinct, [label], name="__r")
    idx = idx.select(label, (F.col("__r") - 1).cast("int").alias(out))
    return df.join(idx, label, "left")


def label_set(df: DataFrame, label: str = "label") -> DataFrame:
    """Distinct labels with their index and the number of classes."""
    idx = label_index(df.select(label).distinct(), label)
    return idx.withColumn("num_labels", F.count(F.lit(1)).over(Window.partitionBy()))


def task_slice(df: DataFrame, task: str, value) -> DataFrame:
    return df.filter(F.col(task) == F.lit(value))


def _hash_cols(df: DataFrame, seed, key: Sequence[str] | str) -> tuple[DataFrame, list[str]]:
    keys = [key] if isinstance(key, str) else list(key)
    return df.withColumn("__h", seeded_hash(seed, *keys)), keys


def sample_exact(df: DataFrame, n: int, seed, key: Sequence[str] | str, by: Sequence[str] | str | None = None,
                 strict: bool = True) -> DataFrame:
    """Exactly ``n`` rows per group (all rows if fewer and not ``strict``),
    chosen as the ``n`` smallest seeded hashes of ``key``. Deterministic and
    independent of partitioning; the rows themselves are never shuffled."""
    if strict:
        groups = [by] if isinstance(by, str) else list(by or [])
        short = df.groupBy(*groups).count().filter(F.col("count") < n).limit(1).collect()
        if short:
            raise ValueError(f"sample of {n} rows larger than a group: {short[0].asDict()}")
    h, keys = _hash_cols(df, seed, key)
    out = prefix_rows(h, [F.col("__h"), *[F.col(k) for k in keys]], hex_bucket("__h"), F.lit(n), by)
    return out.drop("__h")


def shuffle_head(df: DataFrame, n: int, seed, key: Sequence[str] | str) -> DataFrame:
    """Seeded shuffle and prefix: the first ``n`` rows of the hash order."""
    return sample_exact(df, n, seed, key, strict=False)


def train_test_split(df: DataFrame, frac: float, seed, key: Sequence[str] | str,
                     by: Sequence[str] | str | None = None, out: str = "split") -> DataFrame:
    """``ceil(frac * n)`` rows of each group go to ``validation``, the rest to
    ``train``; every row keeps all its columns, so features stay aligned."""
    h, keys = _hash_cols(df, seed, key)
    lim = F.ceil(F.lit(float(frac)) * F.col("__n"))
    flagged = prefix_rows(h, [F.col("__h"), *[F.col(k) for k in keys]], hex_bucket("__h"), lim, by,
                          flag="__val")
    return (flagged.withColumn(out, F.when(F.col("__val"), F.lit("validation")).otherwise(F.lit("train")))
            .drop("__val", "__h"))


def head_rows(df: DataFrame, n: int, pos: str) -> DataFrame:
    """The first ``n`` rows by an explicit position column (toy subsets): every
    task keeps its own first ``n`` before they meet."""
    return df.orderBy(pos).limit(n)


def assign_batches(df: DataFrame, size: int, order: Sequence[str] | str | None = None, seed=None,
                   key: Sequence[str] | str | None = None, by: Sequence[str] | str | None = None,
                   out: str = "batch") -> DataFrame:
    """Batch number = floor((position - 1) / size), last batch kept short.

    In order (``order`` = position column) or shuffled (``seed`` + ``key``).
    Positions come from :func:`ranked`: one range shuffle."""
    if seed is not None:
        h, keys = _hash_cols(df, seed, key)
        r = ranked(h, ["__h", *keys], by, name="__pos")
        r = r.drop("__h")
    else:
        cols = [order] if isinstance(order, str) else list(order)
        r = ranked(df, cols, by, name="__pos")
    return (r.withColumn(out, F.floor((F.col("__pos") - 1) / F.lit(size)).cast("long"))
            .withColumnRenamed("__pos", "position"))


def uniform_hash(seed, *cols) -> F.Column:
    """Uniform double in [0, 1) from the first 13 hex digits of a seeded md5."""
    return F.conv(F.substring(seeded_hash(seed, *cols), 1, 13), 16, 10).cast("double") / float(16 ** 13)


def task_weights(sizes: DataFrame, task: str = "task", size: str = "size", alpha: float = MIX_ALPHA) -> DataFrame:
    """p = size^alpha / sum(size^alpha), with cumulative ranges [lo, hi) in task order."""
    w = sizes.withColumn("weight", F.pow(F.col(size).cast("double"), F.lit(alpha)))
    tot = Window.partitionBy()
    order = Window.orderBy(task).rowsBetween(Window.unboundedPreceding, 0)
    w = w.withColumn("p", F.col("weight") / F.sum("weight").over(tot))
    # ranges share their borders and the last one ends at 1, so every draw falls into one
    running, last = F.sum("p").over(order), F.lead("p").over(Window.orderBy(task)).isNull()
    w = w.withColumn("hi", F.when(last, F.lit(1.0)).otherwise(running))
    return w.withColumn("lo", F.coalesce(F.lag("hi").over(Window.orderBy(task)), F.lit(0.0)))


def mix_tasks(df: DataFrame, task: str, key: str, steps: int, batch: int, seed, alpha: float = MIX_ALPHA) -> DataFrame:
    """Temperature-weighted task mixing.

    Each step draws one task with probability proportional to size^alpha and
    ``batch`` rows of that task (with replacement across steps). Draws are
    seeded hashes of the step/slot, rows are addressed by their rank inside the
    task, so the whole plan is equi-joins: no per-step driver loop.
    """
    spark = df.sparkSession
    sizes = df.groupBy(task).agg(F.count(F.lit(1)).alias("size"))
    weights = task_weights(sizes, task, "size", alpha)
    # range join by bucketing: each task's [lo, hi) covers the buckets
    # floor(lo * B) .. floor(hi * B); the draws join on their bucket (an
    # equi-join), then the exact range test picks the one task
    nb = RANGE_BUCKETS
    ranges = weights.withColumn("bucket", F.explode(F.sequence(
        F.floor(F.col("lo") * nb).cast("long"), F.least(F.floor(F.col("hi") * nb), F.lit(nb - 1)).cast("long"))))
    draws = spark.range(steps).withColumnRenamed("id", "step").withColumn("u", uniform_hash(seed, "step"))
    draws = draws.withColumn("bucket", F.floor(F.col("u") * nb).cast("long"))
    picked = draws.join(ranges, "bucket").filter((F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi")))
    slots = picked.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(batch - 1))))
    slots = slots.withColumn("row", (F.floor(uniform_hash(seed, "step", "slot") * F.col("size")) + 1).cast("long"))
    numbered = ranked(df, [key], task, name="row")
    return slots.select("step", "slot", task, "row").join(numbered, [task, "row"])
