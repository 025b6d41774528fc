"""Row filters and projections of the text-preparation flow."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taskprep.functions.text import clean_text, is_missing, sep_concat

MIN_CLEAN_LENGTH = 20


def drop_missing(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Drop rows whose value in any of ``cols`` is null or a CSV NA token."""
    cond = F.lit(False)
    for c in cols:
        cond = cond | is_missing(c)
    return df.filter(~cond)


def clean_column(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """Cleaned text in ``out``. The value comes out of a one-element
    ``explode``: a later filter on it (the length filter) cannot be pushed below
    a generator, so the regex chain runs once per row instead of once for the
    filter and again for the projection."""
    out = out or col
    value = F.explode(F.array(clean_text(col))).alias(out)
    cols = [value if c == out else F.col(c) for c in df.columns]
    if out not in df.columns:
        cols.append(value)
    return df.select(*cols)


def min_length(df: DataFrame, col: str, n: int = MIN_CLEAN_LENGTH) -> DataFrame:
    """Keep rows whose text has at least ``n`` code points."""
    return df.filter(F.char_length(col) >= n)


def prepare_text(df: DataFrame, text: str = "content", extra: str | None = None,
                 required: Sequence[str] | None = None, n: int = MIN_CLEAN_LENGTH) -> DataFrame:
    """drop_missing -> clean -> min_length; ``extra`` (raw) appended after ``[SEP]``.

    The length filter only sees the cleaned first field.
    """
    req = list(required) if required is not None else [text] + ([extra] if extra else [])
    out = min_length(clean_column(drop_missing(df, req), text), text, n)
    if extra:
        out = out.withColumn(text, sep_concat(text, extra))
    return out


# Text columns of each named task.
TASK_TEXT_COLUMNS = {
    "cola": ("sentence", None),
    "mnli": ("premise", "hypothesis"),
    "mrpc": ("sentence1", "sentence2"),
    "qnli": ("question", "sentence"),
    "qqp": ("question1", "question2"),
    "rte": ("sentence1", "sentence2"),
    "sst2": ("sentence", None),
    "stsb": ("sentence1", "sentence2"),
    "wnli": ("sentence1", "sentence2"),
}


def resolve_columns(columns: Sequence[str], label: str = "label", task: str | None = None) -> tuple[str, str | None]:
    """The text column(s): those of the named task; without a task name
    ``sentence1`` and ``sentence2`` if both are there, else the first two
    columns besides the label (the second only if present)."""
    if task is not None:
        return TASK_TEXT_COLUMNS[task]
    cols = [c for c in columns if c != label]
    if {"sentence1", "sentence2"} <= set(cols):
        return "sentence1", "sentence2"
    return cols[0], cols[1] if len(cols) > 1 else None


def select_model_columns(df: DataFrame, accepted: Sequence[str]) -> DataFrame:
    """Keep only columns a scorer accepts, plus ``label``/``label_ids``."""
    keep = [c for c in df.columns if c in set(accepted) | {"label", "label_ids"}]
    return df.select(*keep)
