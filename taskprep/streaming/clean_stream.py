"""Stateless text preparation on streaming DataFrames.

The cleaning filters and projections (P1-P3, F1, F2) are row-local, so the
same functions apply unchanged to a ``readStream`` source; no state, no
watermark. The reference has no streaming operator beyond that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from taskprep.operators.clean import prepare_text


def cleaned_stream(stream: DataFrame, text: str = "content", extra: str | None = None) -> DataFrame:
    """drop_missing -> clean_text -> min_length on a streaming DataFrame."""
    return prepare_text(stream, text, extra=extra)


def start_cleaning(stream: DataFrame, path: str, checkpoint: str, text: str = "content", fmt: str = "parquet"):
    """Continuously clean a stream into files; ``checkpoint`` must be in shared storage."""
    return (cleaned_stream(stream, text).writeStream.format(fmt).option("path", path)
            .option("checkpointLocation", checkpoint).outputMode("append").start())
