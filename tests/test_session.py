import os
import time
from urllib.parse import urlparse

from pyspark.sql import functions as F

from taskprep.session import SHUFFLE_CLEANUP, cut_lineage, discard


def shuffle_files(spark):
    found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {found.apply(i).getName() for i in range(found.size()) if found.apply(i).getName().startswith("shuffle_")}


def test_cut_lineage_leaves_no_shuffle_files(spark):
    before, setting = shuffle_files(spark), spark.conf.get(SHUFFLE_CLEANUP, None)
    out = cut_lineage(spark.range(20000).groupBy((F.col("id") % 997).alias("k")).agg(F.sum("id").alias("s")))
    for _ in range(50):
        left = shuffle_files(spark) - before
        if not left:
            break
        time.sleep(0.2)
    assert not left and spark.conf.get(SHUFFLE_CLEANUP, None) == setting
    assert out.agg(F.sum("s")).first()[0] == 20000 * 19999 // 2


def test_discard_deletes_only_cut_tables(spark, tmp_path):
    path = str(tmp_path / "kept")
    spark.range(5).write.parquet(path)
    kept, cut, other = spark.read.parquet(path), cut_lineage(spark.range(7)), cut_lineage(spark.range(3))
    folder = urlparse(cut.cut_path).path
    assert os.path.isdir(folder)
    discard(kept, cut, cut.filter("id > 1"), cut)
    assert not os.path.exists(folder) and kept.count() == 5 and other.count() == 3
