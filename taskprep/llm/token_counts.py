"""Token counts by offset-mapped attribution.

The fields of a document are laid end to end and encoded once, as a whole, so
the tokens are those the model will see. Every token covers a byte range; the
ranges are interval-joined to the document's sections (fields, or the lines of
fields), which are sorted and leave no gap, so each token's first and last
section are found by binary search. A token that crosses a border is allocated
by an explicit rule: ``start`` gives it to the section of its first byte,
``most`` to the section with most of its bytes (the first of ties). Section
spans are reported in characters.

Counts of a document's sections always sum to its number of tokens.

Defined cases: a null field is empty; an empty field is a section without
tokens; a document without bytes has one empty section a field; a row
without id or repeated rows are counted like any other; an empty table gives
no rows; columns that are not named are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taskprep.session import read_table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: how byte-level BPE cuts text before merging (fixed with the vocabulary)
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BORDER = "\n"


@cache
def encoding(vocabulary: bytes):
    """The encoder and the byte length of every token id, built once a worker."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    size = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, i in ranks.items():
        size[i] = len(token)
    return tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), size


def section_borders(fields: Sequence[bytes], lines: bool) -> tuple[np.ndarray, np.ndarray]:
    """Start byte of every section, and its field. A field ends with the border laid after it, a line with its own."""
    starts, owner, at = [], [], 0
    for k, field in enumerate(fields):
        cuts = [0]
        if lines:
            nl = np.flatnonzero(np.frombuffer(field, np.uint8) == 10) + 1
            cuts += [int(x) for x in nl if x < len(field)]
        starts += [at + c for c in cuts]
        owner += [k] * len(cuts)
        at += len(field) + len(BORDER)
    return np.array(starts, np.int64), np.array(owner, np.int64)


def allocate(begin: np.ndarray, end: np.ndarray, starts: np.ndarray, total: int, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens given to each section, and how many of those cross a border."""
    first = np.searchsorted(starts, begin, side="right") - 1
    last = np.searchsorted(starts, end - 1, side="right") - 1
    to, cross = first.copy(), last > first
    if rule == "most":
        stops = np.append(starts[1:], total)
        for i in np.flatnonzero(cross).tolist():
            parts = [min(end[i], stops[s]) - max(begin[i], starts[s]) for s in range(first[i], last[i] + 1)]
            to[i] = first[i] + int(np.argmax(parts))
    return np.bincount(to, minlength=len(starts)), np.bincount(to[cross], minlength=len(starts))


def token_counts(docs: DataFrame, *, doc_id: str = "doc_id", fields: Sequence[str] = ("text",), lines: bool = True, rule: str = "start", vocabulary: str = VOCABULARY) -> DataFrame:
    """One row a section: doc_id, field, section, char_start, char_end, n_tokens, n_crossing, doc_tokens.

    ``vocabulary`` is a file of ranks on the driver; its bytes (a megabyte) are
    sent to the workers.
    """
    if rule not in ("start", "most"):
        raise ValueError(f"unknown rule {rule!r}")
    with open(vocabulary, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())
    names = list(fields)
    rows = docs.select(F.col(doc_id).alias("id"), *(F.col(c).cast("string").alias(f"f{k}") for k, c in enumerate(names)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, size = encoding(ranks.value)
        for batch in batches:
            cols = [batch.column(f"f{k}") for k in range(len(names))]
            own, out, n, bytes_held = [], [], 0, 0
            for i in range(batch.num_rows):
                texts = [c[i].as_py() or "" for c in cols]
                whole = BORDER.join(texts)
                raw = whole.encode()
                ids = enc.encode_to_numpy(whole, allowed_special=set(), disallowed_special=()) if raw else np.empty(0, np.uint32)
                end = np.cumsum(size[ids])
                starts, owner = section_borders([t.encode() for t in texts], lines)
                counts, crossing = allocate(end - size[ids], end, starts, len(raw), rule)
                chars = np.concatenate(([0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))
                at = chars[np.minimum(np.append(starts, len(raw)), len(raw))]
                own.append(i)
                out.append((owner, np.arange(len(starts)), at[:-1], at[1:], counts, crossing, np.full(len(starts), len(ids))))
                n, bytes_held = n + len(starts), bytes_held + len(raw)
                if n >= 50_000 or i + 1 == batch.num_rows:
                    who = np.repeat(own, [len(x[0]) for x in out])
                    cols_out = [np.concatenate([x[k] for x in out]) for k in range(7)]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("id").take(pa.array(who)), pa.array([names[k] for k in cols_out[0]], pa.string()), *(pa.array(c.astype(np.int64)) for c in cols_out[1:])],
                        ["id", "field", "section", "char_start", "char_end", "n_tokens", "n_crossing", "doc_tokens"])
                    own, out, n = [], [], 0

    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, field string, section long, char_start long, char_end long, n_tokens long, n_crossing long, doc_tokens long"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", doc_id)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read_table(spark, sf_dir, "documents"))
