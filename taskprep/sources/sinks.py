"""Sinks (K1-K5): JSON-lines results, QA output triple, metric log CSV,
sorted reports and TSV predictions, nested QA JSON export.

All writes are distributed ``DataFrameWriter`` calls; nothing is collected.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SKIP_ERROR = "Skip happened"


def write_results(df: DataFrame, path: str, mode: str = "overwrite", versioned: bool = False) -> None:
    """K1: one JSON object per question; rows flagged ``unmappable`` become
    ``{"error": "Skip happened", "nlu": ..., "table_id": ...}``. ``versioned``
    publishes the rows (see ``publish``) instead of overwriting the folder."""
    out = df
    if "unmappable" in df.columns:
        out = df.withColumn("error", F.when(F.col("unmappable"), F.lit(SKIP_ERROR)))
        keep = [c for c in df.columns if c not in ("unmappable",)]
        out = out.select(*[F.when(~F.col("unmappable"), F.col(c)).alias(c) if c not in ("nlu", "table_id") else F.col(c)
                           for c in keep], "error")
    put = lambda p: out.write.mode(mode).option("ignoreNullFields", "true").json(p)
    publish(df.sparkSession, path, put) if versioned else put(path)


def write_qa_outputs(best: DataFrame, nbest: DataFrame, path: str, null_odds: DataFrame | None = None,
                     prefix: str | None = None, mode: str = "overwrite", versioned: bool = False) -> None:
    """K2: best answers, n-best lists (one JSON record per example, entries
    ordered by rank) and, in null mode, null odds. ``versioned`` publishes the
    parts together: readers see all of one run or all of another."""
    if versioned:
        publish(best.sparkSession, path, lambda p: write_qa_outputs(best, nbest, p, null_odds, prefix, mode))
        return
    name = (lambda base: f"{base}_{prefix}" if prefix else base)
    best.write.mode(mode).json(f"{path}/{name('predictions')}")
    entries = nbest.groupBy("example_id").agg(
        F.sort_array(F.collect_list(F.struct("rank", "text", "probability", "start_logit", "end_logit"))).alias("nbest"))
    entries.write.mode(mode).json(f"{path}/{name('nbest_predictions')}")
    if null_odds is not None:
        null_odds.write.mode(mode).json(f"{path}/{name('null_odds')}")


LOG_COLUMNS = ["avg_acc", "epoch", "task", "task_num", "test_acc", "test_loss"]


def union_log(parts: Sequence[DataFrame], columns: Sequence[str] | None = None) -> DataFrame:
    """Rows with unequal keys unioned into one log; missing values are null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    cols = list(columns) if columns else sorted(out.columns)
    return out.select(*cols)


MANIFEST = "_current"


def _fs(spark, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs
    conf = spark._jsc.hadoopConfiguration()
    return hadoop.Path(path).getFileSystem(conf), hadoop.Path, hadoop, conf


def current_version(spark, path: str) -> str | None:
    """The folder that holds the published version of ``path``; None where nothing is published."""
    fs, at, _, _ = _fs(spark, path)
    manifest = at(f"{path}/{MANIFEST}")
    if not fs.exists(manifest):
        return None
    stream = fs.open(manifest)
    try:
        name = bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()
    return f"{path}/{name}"


def publish(spark, path: str, write: Callable[[str], None]) -> str:
    """Write a new version of ``path`` and make it the current one.

    ``write`` fills a folder of its own. Only when it has ended is the manifest,
    a small file that names the folder, written beside the old one and renamed
    over it, in one step of the file system: whatever breaks before, readers
    find the old version whole, and after it the new one. The version before the
    last is then removed; the last one stays for readers that have begun.
    """
    fs, at, _, _ = _fs(spark, path)
    name = f"version-{uuid.uuid4().hex}"
    before = current_version(spark, path)
    write(f"{path}/{name}")
    _swap_manifest(spark, path, name)
    for status in fs.listStatus(at(path)):
        old = status.getPath()
        if old.getName().startswith("version-") and old.getName() != name and (before is None or old.getName() != before.rsplit("/", 1)[-1]):
            fs.delete(old, True)
    return f"{path}/{name}"


def _swap_manifest(spark, path: str, name: str) -> None:
    fs, at, hadoop, conf = _fs(spark, path)
    fresh = at(f"{path}/{MANIFEST}.{name}")
    out = fs.create(fresh, True)
    out.write(name.encode())
    out.close()
    how = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    how[0] = hadoop.Options.Rename.OVERWRITE
    hadoop.FileContext.getFileContext(fs.getUri(), conf).rename(fresh, at(f"{path}/{MANIFEST}"), how)


def append_metrics(df: DataFrame, path: str, resume: bool = False) -> DataFrame:
    """K3: write a metric log CSV. ``resume`` unions the rows into the existing
    log (columns by name, holes as nulls); otherwise the log is replaced. The
    log is published as a whole (see ``publish``): a run that fails at any point leaves the old
    one in place, and an old log that is there but can't be read is an error, never
    a fresh start."""
    spark = df.sparkSession
    out = df
    old_path = current_version(spark, path)
    if resume and old_path:
        old = spark.read.option("header", True).option("inferSchema", True).csv(old_path)
        out = union_log([old, df.select(*[F.col(c).cast("double") if c in LOG_COLUMNS else F.col(c)
                                          for c in df.columns])])
    schema = out.schema
    at = publish(spark, path, lambda p: out.write.option("header", True).csv(p))
    return spark.read.schema(schema).option("header", True).csv(at)


def read_log(spark, path: str) -> DataFrame:
    """The current version of a metric log."""
    at = current_version(spark, path)
    if at is None:
        raise FileNotFoundError(f"no metric log at {path}")
    return spark.read.option("header", True).option("inferSchema", True).csv(at)


def report_lines(metrics: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """K4: ``key = value`` lines sorted by key."""
    return metrics.orderBy(key).select(F.concat_ws(" = ", F.col(key), F.col(value).cast("string")).alias("value"))


def prediction_lines(df: DataFrame, index: str, pred: str, regression: bool = False,
                     labels: Sequence[str] | None = None) -> DataFrame:
    """K4: ``index<TAB>prediction``; regression to 3 decimals, class index mapped
    to its label name when ``labels`` is given."""
    p = F.col(pred)
    if regression:
        text = F.format_string("%.3f", p.cast("double"))
    elif labels is not None:
        text = F.element_at(F.array(*[F.lit(x) for x in labels]), p.cast("int") + 1)
    else:
        text = p.cast("string")
    return df.select(F.col(index), F.concat_ws("\t", F.col(index).cast("string"), text).alias("value"))


def write_lines(lines: DataFrame, path: str, order: str | None = None, header: str | None = None) -> None:
    """Write a one-column text output, optionally range-ordered by ``order`` and
    with a ``header`` line first (``index<TAB>prediction`` for predictions)."""
    out = lines
    if header is not None:
        top = lines.sparkSession.range(1).select(F.lit(header).alias("value"), F.lit(0).alias("__at"))
        rest = lines.select("value", *([order] if order and order != "value" else []), F.lit(1).alias("__at"))
        out = rest.unionByName(top, allowMissingColumns=True).orderBy("__at", *([order] if order else []))
    elif order:
        out = lines.orderBy(order)
    out.select("value").write.mode("overwrite").text(path)


def to_nested_qa(questions: DataFrame, tables: DataFrame, version: str = "1.1") -> DataFrame:
    """K5 + J11 + A21 + W1: one record per table (tables without questions keep
    an empty list): context = headers joined by space, qas = the table's
    questions numbered ``table-n`` in question order. One equi left join."""
    from taskprep.operators.specs import number_within
    q = number_within(questions, "table_id", "pos", "qid")
    qas = q.groupBy("table_id").agg(F.sort_array(F.collect_list(F.struct(
        F.col("pos"), F.col("qid").alias("id"), F.col("question"), F.col("answers")))).alias("qs"))
    qas = qas.select("table_id", F.transform("qs", lambda x: x.dropFields("pos")).alias("qas"))
    t = tables.select(F.col("id").alias("table_id"), F.array_join("header", " ").alias("context"))
    para = t.join(qas, "table_id", "left").select(
        "table_id", F.struct("context", F.coalesce("qas", F.array().cast(qas.schema["qas"].dataType)).alias("qas"))
        .alias("paragraph"))
    return para.select(F.lit(version).alias("version"), F.col("table_id").alias("title"),
                       F.array("paragraph").alias("paragraphs"))


def write_cells(cells: DataFrame, path: str, n_buckets: int = 256, mode: str = "overwrite") -> None:
    """Store a cell catalog as parquet partitioned by a hash bucket of
    ``table_id``, so queries over a set of tables read only their buckets.
    No shuffle: each task writes the buckets it holds (rows sorted by bucket
    within the task), so one very large table does not land in one task."""
    b = F.pmod(F.xxhash64("table_id"), F.lit(n_buckets)).cast("int")
    (cells.withColumn("table_bucket", b).sortWithinPartitions("table_bucket", "table_id", "col_idx")
     .write.mode(mode).partitionBy("table_bucket").parquet(path))
