"""Records of large files read by many tasks.

Spark splits a text file at any chosen separator, but a review may hold line
ends inside quotes and a QA file is one JSON document, so neither is a record a
line. Here a file is read as pieces that end with a separator which every
record border has too; the splits of a file are then put in step:

1. each split is scanned once for what it does to the state of a scanner (are
   we inside a string; how deep are the brackets), for both possible starts;
2. the splits of a file are chained, a row a split, which gives each its start;
3. each split gives out its whole records. What it holds of a record that began
   or ends elsewhere goes out as a fragment, and fragments are joined in order.

Texts stream through the tasks, nothing is held but the record in hand, and
what the driver sees is one row a split (an input of 128 MB). Files are only
opened by Spark's own text reader, so any store that it reads will do.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ESCAPES = re.compile(r'\\.|["{}\[\]]', re.S)


class QuotedLines:
    """CSV: a line end outside quotes ends a record; a quote in a quoted field is doubled, so parity tells inside from outside."""

    sep = "\n"

    def scan(self, text: str, inside: bool, depth: int) -> tuple[bool, int, int | None, int | None]:
        return inside ^ (text.count('"') % 2 == 1), depth, None, None

    def border(self, inside: bool, depth: int) -> bool:
        return not inside

    def cut(self, record: str, start: int | None, end: int | None) -> str:
        return record.removesuffix(self.sep).removesuffix("\r")


class JsonScan:
    """State of a JSON text, and where the content of the record in hand starts and ends in it."""

    def scan(self, text: str, inside: bool, depth: int) -> tuple[bool, int, int | None, int | None]:
        start = end = None
        for m in ESCAPES.finditer(text):
            c = m[0]
            if c == '"':
                inside = not inside
            elif inside or len(c) > 1:
                continue
            elif c in "{[":
                if start is None and self.opens(c, depth):
                    start = m.start() + self.skip
                depth += 1
            else:
                depth -= 1
                if self.closes(c, depth):
                    end = m.start()
        return inside, depth, start, end


class JsonElements(JsonScan):
    """The objects at ``level``, counted in enclosing brackets: 2 for those of an array that is a member of the document."""

    sep, skip = "}", 0

    def __init__(self, level: int = 2):
        self.level = level

    def opens(self, c: str, depth: int) -> bool:
        return c == "{" and depth == self.level

    def closes(self, c: str, depth: int) -> bool:
        return False

    def border(self, inside: bool, depth: int) -> bool:
        return not inside and depth == self.level

    def cut(self, record: str, start: int | None, end: int | None) -> str:
        return record[start or 0 :]


class JsonMembers(JsonScan):
    """The members of a document that is one object, each as ``"key": value``."""

    sep, skip = ",", 1

    def opens(self, c: str, depth: int) -> bool:
        return c == "{" and depth == 0

    def closes(self, c: str, depth: int) -> bool:
        return depth == 0

    def border(self, inside: bool, depth: int) -> bool:
        return not inside and depth <= 1

    def cut(self, record: str, start: int | None, end: int | None) -> str:
        return record[start or 0 : end] if end is not None else record[start or 0 :].removesuffix(self.sep)


def _pieces(spark: SparkSession, path, sep: str) -> DataFrame:
    text = spark.read.option("lineSep", sep).text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], str | None]]:
    """((file, block), piece) of a task's pieces in order; a split ends with a None piece."""
    last = None
    for batch in batches:
        for file, block, value in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if last is not None and last != (file, block):
                yield last, None
            last = (file, block)
            yield last, value
    if last is not None:
        yield last, None


def _summaries(pieces: DataFrame, form) -> DataFrame:
    """What each split does to the state: does it flip inside and outside, and its change of depth from either start."""
    def run(batches):
        state = [(False, 0), (True, 0)]
        for (file, block), value in _splits(batches):
            if value is not None:
                state = [form.scan(value + form.sep, *s)[:2] for s in state]
                continue
            yield pa.RecordBatch.from_pylist([{"file": file, "block": block, "flips": state[0][0], "out": state[0][1], "in": state[1][1]}])
            state = [(False, 0), (True, 0)]

    return pieces.mapInArrow(run, "file string, block long, flips boolean, `out` long, `in` long")


def _starts(summaries: DataFrame) -> DataFrame:
    """The state in which each split starts."""
    def chain(rows: pd.DataFrame) -> pd.DataFrame:
        inside, depth, out = False, 0, []
        for r in rows.sort_values("block").itertuples(index=False):
            out.append((r.file, r.block, inside, depth))
            depth += getattr(r, "in_") if inside else r.out
            inside ^= r.flips
        return pd.DataFrame(out, columns=["file", "block", "inside", "depth"])

    return summaries.withColumnRenamed("in", "in_").groupBy("file").applyInPandas(chain, "file string, block long, inside boolean, depth long")


def read_records(spark: SparkSession, path, form) -> DataFrame:
    """(file, block, n, before, record): the records of files of one ``form``, in order by block and n; blank ones are left out.

    ``block`` is where the split that holds the record's start begins. What
    stands before the content of a record is in ``before`` (null if nothing but
    commas does): the document's members ahead of its ``JsonElements``. What
    follows the last record of a file comes as a record too.
    """
    pieces = _pieces(spark, path, form.sep)
    began = {(r["file"], r["block"]): (r["inside"], r["depth"]) for r in _starts(_summaries(pieces, form)).collect()}
    known = spark.sparkContext.broadcast(began)

    def run(batches):
        out: list[dict] = []
        held: list[str] = []
        state, n, start, end, size, whole = None, 0, None, None, 0, True

        def put(kind: str, at: tuple[str, int]) -> None:
            nonlocal held, start, end, size, n
            text = "".join(held)
            out.append({"file": at[0], "block": at[1], "n": n, "kind": kind, "record": form.cut(text, start, end) if kind == "w" else text,
                        "before": _before(text, start) if kind == "w" else None, "start": -1 if start is None else start, "end": -1 if end is None else end})
            held, start, end, size, n = [], None, None, 0, n + 1

        for at, value in _splits(batches):
            if state is None:
                state = known.value[at]
                whole = at[1] == 0 or form.border(*state)  # else the first record began in an earlier split
            if value is None:
                if held:
                    put("t" if whole else "m", at)
                state, n = None, 0
            else:
                text = value + form.sep
                *state, s, e = form.scan(text, *state)
                start, end = (size + s if s is not None and start is None else start), (size + e if e is not None else end)
                held.append(text)
                size += len(text)
                if form.border(*state):
                    put("w" if whole else "h", at)
                    whole = True
            if len(out) >= 1000:
                yield pa.RecordBatch.from_pylist(out)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out)

    parts = pieces.mapInArrow(run, "file string, block long, n long, kind string, record string, before string, start long, `end` long")
    return _joined(parts, form).filter(F.trim("record") != "")


def _before(text: str, start: int | None) -> str | None:
    return text[:start].strip(" \t\r\n,") or None if start else None


def _joined(parts: DataFrame, form) -> DataFrame:
    """Whole records, and those put together from their fragments: a tail, the splits it fills, a head."""
    from taskprep.session import cut_lineage
    parts = cut_lineage(parts)
    order = Window.partitionBy("file").orderBy("block", "n")
    broken = parts.filter("kind <> 'w'").withColumn("no", F.sum((F.col("kind") == "t").cast("int")).over(order))

    def join(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["block", "n"])
        size, start, end = 0, None, None
        for r in rows.itertuples(index=False):
            start = size + r.start if r.start >= 0 and start is None else start
            end = size + r.end if r.end >= 0 else end
            size += len(r.record)
        first = rows.iloc[0]
        text = "".join(rows["record"])
        return pd.DataFrame([(first["file"], first["block"], first["n"], _before(text, start), form.cut(text, start, end))], columns=["file", "block", "n", "before", "record"])

    mended = broken.groupBy("file", "no").applyInPandas(join, "file string, block long, n long, before string, record string")
    return parts.filter("kind = 'w'").select("file", "block", "n", "before", "record").unionByName(mended)
