"""Session construction, table loading and lineage cuts."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

#: Spark's own setting: remove the shuffle files of a query when it ends
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def get_session(master: str | None = None, shuffle_partitions: int = 8,
                app: str = "taskprep") -> SparkSession:
    """Local/test session. On a cluster the caller's session is used as is."""
    master = master or os.environ.get("TASKPREP_MASTER", "local[8]")
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("TASKPREP_DRIVER_MEM", "8g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder.

    ``spark.checkpoint.dir`` is read from the session. Where it is unset a
    scratch folder is made for local runs and tests only; on a cluster, whose
    executors don't share local folders, that is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        conf = tempfile.mkdtemp(prefix="taskprep-ckpt-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", conf)
    sc.setCheckpointDir(conf)
    return sc.getCheckpointDir() or conf


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a parquet table in the shared checkpoint folder and
    read it back: the lineage is cut, the data survives executor loss, and the
    planner gets real file sizes for its broadcast decisions. Nothing reads the
    shuffles of that job again, so Spark removes their files when it ends."""
    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark)
    path = f"{base.rstrip('/')}/taskprep-{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)
    out = spark.read.parquet(path)
    out.cut_path = path
    return out


def discard(*cuts: DataFrame) -> None:
    """Delete tables that ``cut_lineage`` wrote and that nothing reads any more; other frames are left alone."""
    for df in cuts:
        path = df.__dict__.pop("cut_path", None)
        if path:
            spark = df.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {t: read_table(spark, sf_dir, t) for t in TABLES}


# Inputs up to this many estimated bytes a core are spread over the cores.
SPREAD_BYTES_PER_CORE = 128 << 20


def spread(df: DataFrame) -> DataFrame:
    """Spread a small input over all cores before CPU-heavy per-row work.

    A table of one row group is read by one task. The planner's size estimate
    decides: only inputs of at most one ordinary file split a core are dealt
    out, a shuffle of bounded size; larger ones already have a split for every
    core and are left alone, however few their files.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size <= cores * SPREAD_BYTES_PER_CORE else df
