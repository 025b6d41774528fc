"""Deterministic total orders at scale.

Several operators need a position in a global (or per-group) order: exact
fixed-size samples, train/validation splits, batch numbers, dense vocabulary
ids. None of them funnels the data through one task:

* :func:`ranked` range-partitions the rows by (group, order), numbers them
  where they lie, and adds the rows before each (group, partition), a table of
  at most one row a group and one a partition, whatever the keys look like;
* :func:`prefix_rows` buckets a seeded md5 by its first hex digits (a fixed
  number of buckets) and ranks only the bucket in which the cut falls.

A seeded md5 of the key gives the same order in Spark and in DuckDB, which
is what makes the sampling operators checkable against an SQL oracle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taskprep.session import cut_lineage

# Hex characters of the md5 used as a bucket: 16**4 = 65536 buckets.
HASH_BUCKET_CHARS = 4


def seeded_hash(seed, *cols: str | Column) -> Column:
    """md5(seed ':' key[':' key2 ...]) as lowercase hex, identical to DuckDB md5."""
    parts: list[Column] = [F.lit(str(seed))]
    for c in cols:
        parts.append(F.lit(":"))
        parts.append((F.col(c) if isinstance(c, str) else c).cast("string"))
    return F.md5(F.concat(*parts))


def hex_bucket(hex_col: str | Column, chars: int = HASH_BUCKET_CHARS) -> Column:
    c = F.col(hex_col) if isinstance(hex_col, str) else hex_col
    return F.conv(F.substring(c, 1, chars), 16, 10).cast("long")


def _cols(by: Sequence[str] | str | None) -> list[str]:
    if by is None:
        return []
    return [by] if isinstance(by, str) else list(by)


def ranked(df: DataFrame, order_cols: Sequence[Column | str], by: Sequence[str] | str | None = None,
           name: str = "rn") -> DataFrame:
    """Add ``name`` = 1-based position of each row in ``order_cols`` within ``by``.

    One range shuffle on (group, order): bounds come from sampled quantiles, so
    sparse ids, common-prefix strings and hot groups all spread evenly. The
    sorted rows are written once with their partition and running number; a
    group's rows are consecutive in a partition, so the first number and the
    count of each (group, partition) place every row, without a window over
    the data.
    """
    by = _cols(by)
    keys = [F.col(c) for c in by] + [F.col(c) if isinstance(c, str) else c for c in order_cols]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    laid = cut_lineage(laid.withColumn("__part", F.spark_partition_id()).withColumn("__idx", F.monotonically_increasing_id()))
    counts = laid.groupBy(*by, "__part").agg(F.count(F.lit(1)).alias("__cnt"), F.min("__idx").alias("__first"))
    before = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("__off", F.coalesce(F.sum("__cnt").over(before), F.lit(0)) - F.col("__first") + 1)
    named = offsets.select(*[F.col(c).alias(f"__g{i}") for i, c in enumerate(by)], F.col("__part").alias("__p"), "__off")
    same = F.col("__part") == F.col("__p")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"__g{i}"))
    return laid.join(named, same).withColumn(name, F.col("__off") + F.col("__idx")).select(*df.columns, name)


def prefix_rows(df: DataFrame, order_cols: Sequence[str | Column], bucket: Column, limit: Column,
                by: Sequence[str] | str | None = None, flag: str | None = None) -> DataFrame:
    """Rows among the first ``limit`` of each group in ``order_cols`` order.

    ``bucket`` must be monotone in ``order_cols``. ``limit`` is an expression
    over the group columns and ``__n`` (the group size). Rows in buckets wholly
    before the cut are kept by a map-side filter, rows wholly after it are
    dropped (or flagged), and only the single boundary bucket of each group is
    ranked, so the data itself is not shuffled: only per-(group, bucket) counts
    and the boundary rows are.

    With ``flag`` every row is returned with a boolean ``flag`` column instead
    of being filtered.
    """
    by = _cols(by)
    b = "__bucket"
    keyed = df.withColumn(b, bucket)
    counts = keyed.groupBy(*by, b).agg(F.count(F.lit(1)).alias("__cnt"))
    gw = Window.partitionBy(*by)
    before = gw.orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    cum = counts.select(
        *by, b, "__cnt",
        F.coalesce(F.sum("__cnt").over(before), F.lit(0)).alias("__off"),
        F.sum("__cnt").over(gw).alias("__n"),
    ).withColumn("__lim", limit)
    # one row per group: the last bucket wholly inside the cut, and the bucket
    # where the cut falls with its offset (null when the cut is on a bucket edge)
    off, cnt, lim_c = F.col("__off"), F.col("__cnt"), F.col("__lim")
    at_cut = (off < lim_c) & (off + cnt > lim_c)
    groups = cum.groupBy(*by).agg(
        F.max("__n").alias("__n"), F.max("__lim").alias("__lim"),
        F.max(F.when(off + cnt <= lim_c, F.col(b))).alias("__last_full"),
        F.max(F.when(at_cut, F.col(b))).alias("__cut"), F.max(F.when(at_cut, off)).alias("__off"))
    if by:
        joined = keyed.join(groups, by)
    else:
        # a single group: one row, taken as scalar values
        held = groups.select(F.struct(*groups.columns).alias("__s")).scalar()
        joined = keyed.withColumn("__s", held).select("*", "__s.*").drop("__s")
    lim, off, cutb, full = F.col("__lim"), F.col("__off"), F.col("__cut"), F.col("__last_full")
    certain_in = full.isNotNull() & (F.col(b) <= full)
    boundary = cutb.isNotNull() & (F.col(b) == cutb)
    w = Window.partitionBy(*by, b).orderBy(*order_cols)
    helpers = [b, "__cut", "__off", "__lim", "__n", "__last_full"]
    edge = joined.filter(boundary).withColumn("__rn", off + F.row_number().over(w))
    if flag is None:
        inside = joined.filter(certain_in).drop(*helpers)
        edge_in = edge.filter(F.col("__rn") <= lim).drop("__rn", *helpers)
        return inside.unionByName(edge_in)
    rest = joined.filter(~boundary).withColumn(flag, F.coalesce(certain_in, F.lit(False))).drop(*helpers)
    edge_f = edge.withColumn(flag, F.col("__rn") <= lim).drop("__rn", *helpers)
    return rest.unionByName(edge_f)
