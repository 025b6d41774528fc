"""Vocabulary (A7, J5): distinct tokens in first-occurrence order, ids from 3
(0 unknown, 1 begin, 2 end), limited to tokens that have an embedding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taskprep.operators.order import ranked

FIRST_ID = 3


def build_vocab(tokens: DataFrame, embedded: DataFrame | None = None, source: str = "source_no",
                row: str = "row_id", pos: str = "pos", token: str = "token") -> DataFrame:
    """tokens: one row per token occurrence with (source, row, pos) giving the
    reading order. Returns (token, id, n). One partial aggregation per token,
    then a range-partitioned global rank (no single-task sort). ``embedded`` keeps only
    tokens present in an embedding table (semi-join)."""
    first = tokens.groupBy(token).agg(
        F.min(F.struct(F.col(source).alias("s"), F.col(row).alias("r"), F.col(pos).alias("p"))).alias("first"),
        F.count(F.lit(1)).alias("n"))
    if embedded is not None:
        first = first.join(embedded.select(token).distinct(), token, "left_semi")
    r = ranked(first, ["first"], name="__rank")
    return r.select(token, (F.col("__rank") + FIRST_ID - 1).cast("int").alias("id"), "n")
