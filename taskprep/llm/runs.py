"""Periodic runs of words: Lyndon arrays by Baier grouping under both orders, roots extended into runs.

A run is a stretch of consecutive words with smallest period q that no
neighbouring word extends; those of at least ``min_length`` words and
``min_exponent`` periods are found. By the runs theorem every run holds its
Lyndon root, under the order of words or its reverse, as the longest Lyndon
word that starts there.

1. Where runs can lie: inside a run of L words each of the first L - q -
   ``GRAM`` + 1 word triples comes again at most q words later, so it lies in
   a stretch of such triples that is (``min_exponent`` - 1) times longer, but
   for the triple's own words. Stretches are cut at triples that come again
   too late, or never, until nothing changes. No run is lost; texts without
   near repetitions leave nothing.
2. On each stretch that is left, phase one of Baier's suffix sorter
   (``lyndon_lengths``) groups the suffixes by their longest Lyndon prefix. Its
   group contexts are the Lyndon array; a second pass has the order of the
   words reversed.
3. A run of e >= 3 periods has e - 1 or more whole roots in a row. Where roots
   of one length follow each other that often, the common extension of the
   words at distance q is measured to both sides, over the whole document.
4. The operator returns the runs and the text in which each run is cut down to
   its first period.

A task holds one chunk of documents (``arrow_text``) and nothing is shuffled.
Time is linear but for the measured extensions, whose total is that of the
runs' lengths. Words are compared by 64-bit hashes, and ordered by them.

Defined cases: a null text, an empty one or one without words has no words, no
runs and an empty collapsed text; a null id gives a row as any other; repeated
rows get equal results; very long texts are never cut (a document is in one
task); runs of equal start are told apart by period; an empty table gives no
rows; other columns are not read and cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taskprep.llm import arrow_text as at
from taskprep.llm.quality import let
from taskprep.session import read_table

MIN_LENGTH, MIN_EXPONENT = 6, 4
GRAM = 3
TABLE = at.byte_values(at.WHITE, lower=False)
WORD = r"[^\x20\x09-\x0D]+"


def lyndon_lengths(w: list[int]) -> list[int]:
    """Length of the longest Lyndon word that starts at each place of ``w``.

    Suffixes are grouped by their first symbol. From the highest group down,
    each suffix of a group points to the nearest one before it that lies in a
    lower group; suffixes with l such pointers leave their group for a new one
    right above it, whose context is their old one followed by l times the
    context of the group in hand.
    """
    n = len(w)
    order = sorted(set(w))
    number = {x: g for g, x in enumerate(order)}
    group = [number[x] for x in w]
    members: list[list[int]] = [[] for _ in order]
    for i, g in enumerate(group):
        members[g].append(i)
    context, size = [1] * len(order), [len(m) for m in members]
    lower, upper = list(range(-1, len(order) - 1)), list(range(1, len(order) + 1))  # neighbours in the order of groups
    upper[-1:] = [-1] * bool(order)
    left = list(range(n))  # links to the nearest place at or before one that is not yet in hand
    g = len(order) - 1
    while g >= 0:
        here = [i for i in members[g] if group[i] == g]
        for i in here:
            left[i] = i - 1
        pointed: dict[int, int] = {}
        for i in here:
            j, seen = i, []
            while j >= 0 and left[j] != j:
                seen.append(j)
                j = left[j]
            for k in seen:
                left[k] = j
            if j >= 0:
                pointed[j] = pointed.get(j, 0) + 1
        sets: dict[tuple[int, int], list[int]] = {}
        for j, times in pointed.items():
            sets.setdefault((-times, group[j]), []).append(j)
        for (times, old), moved in sorted(sets.items()) if len(sets) > 1 else sets.items():
            longer = context[old] - times * context[g]
            if size[old] == len(moved):  # nothing else is left in it
                context[old] = longer
                continue
            new = len(members)
            members.append(moved)
            size.append(len(moved))
            size[old] -= len(moved)
            context.append(longer)
            lower.append(old)
            upper.append(upper[old])
            if upper[old] >= 0:
                lower[upper[old]] = new
            upper[old] = new
            for j in moved:
                group[j] = new
        g = lower[g]
    return [context[x] for x in group]


def stretches(h: np.ndarray, first: np.ndarray, least: int, exponent: int) -> np.ndarray:
    """(start, end) of the parts of a chunk, each inside one document, in which all its runs lie."""
    n = len(h)
    if n < least:
        return np.empty((0, 2), np.int64)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    same_words = min(max(least - q, (exponent - 1) * q) for q in range(1, least + 1))  # words of a run that come again, at least
    size = min(GRAM, same_words)
    grams = at.gram_hashes(h, size)
    key = grams ^ at.mix64(doc[: len(grams)].astype(at.U64) + at.U64(1))
    inside = np.flatnonzero(doc[: len(grams)] == doc[size - 1 :])
    order = inside[np.argsort(key[inside], kind="stable")]
    same = np.flatnonzero((key[order[1:]] == key[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]]))
    p, gap = order[same], order[same + 1] - order[same]  # places whose triple comes again, and how much later
    by = np.argsort(p)
    p, gap = p[by], gap[by]
    while len(p):
        cut = np.flatnonzero((np.diff(p) != 1) | (doc[p[1:]] != doc[p[:-1]])) + 1
        bounds = np.concatenate([[0], cut, [len(p)]])
        long = np.diff(bounds)
        room = np.repeat(long, long)
        keep = (gap * (exponent - 1) <= room + size - 1) & (room > same_words - size)
        if keep.all():
            s, e = p[bounds[:-1]], p[bounds[1:] - 1] + 1
            e = np.minimum(e + size - 1 + (long + size - 1) // (exponent - 1), first[doc[s] + 1])
            return np.stack([s, e], 1)
        p, gap = p[keep], gap[keep]
    return np.empty((0, 2), np.int64)


def extended(h: np.ndarray, i: int, p: int) -> tuple[int, int]:
    """The widest (start, end) about place ``i`` in which words ``p`` apart are equal, by comparisons of doubling length."""
    ends = []
    for a, b in ((h[i:], h[i + p :]), (h[: i + p][::-1][p:], h[: i + p][::-1])):
        n, at_, block = min(len(a), len(b)), 0, 64
        while at_ < n:
            odd = np.flatnonzero(a[at_ : min(at_ + block, n)] != b[at_ : min(at_ + block, n)])
            if len(odd):
                n = at_ + int(odd[0])
            at_, block = at_ + block, 2 * block
        ends.append(n)
    return i - ends[1], i + p + ends[0]


def find_runs(h: np.ndarray, parts: np.ndarray, least: int, exponent: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of one document that meet ``parts``, by start, then period."""
    found = set()
    for s, e in parts.tolist():
        rank = np.unique(h[s:e], return_inverse=True)[1]
        for w in (rank, rank.max() - rank):
            lam = np.array(lyndon_lengths(w.tolist()), np.int64)
            i = np.arange(len(lam))
            row = np.ones(len(lam), bool)  # roots of one length in a row
            for k in range(1, exponent - 1):
                to = i + k * lam
                row &= (to < len(lam)) & (lam[np.minimum(to, len(lam) - 1)] == lam)
            ends: dict[int, int] = {}
            for r in np.flatnonzero(row).tolist():
                q = int(lam[r])
                if s + r + q <= ends.get(q, 0):
                    continue  # this root lies in a run that is known
                a, b = extended(h, s + r, q)
                ends[q] = b
                if b - a >= max(least, exponent * q):
                    found.add((a, b - a, q))
    return sorted(found, key=lambda x: (x[0], x[2]))


def periodic_runs(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """doc_id, n_words, runs (start, length, period in words), collapsed (the words outside runs and those of first periods, joined by one space)."""
    if min_exponent < 3:
        raise ValueError("min_exponent must be 3 or more")
    docs = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, offs in at.chunks(batches, "text"):
            h, starts, ends, first = at.find_words(buf, offs, TABLE)
            keep = np.ones(len(h), bool)
            each: list[list[tuple[int, int, int]]] = [[] for _ in range(rows.num_rows)]
            parts = stretches(h, first, min_length, min_exponent)
            home = np.searchsorted(first, parts[:, 0], side="right") - 1
            for d in np.unique(home).tolist():
                f = int(first[d])
                each[d] = find_runs(h[f : first[d + 1]], parts[home == d] - f, min_length, min_exponent)
                for s, n, q in each[d]:
                    keep[f + s + q : f + s + n] = False
            data, at_, _, _ = at.join_words(buf, starts, ends, first, keep)
            flat = [np.array([x[c] for r in each for x in r], np.int64) for c in range(3)]
            counts = np.zeros(len(each) + 1, np.int32)
            np.cumsum([len(r) for r in each], out=counts[1:])
            yield pa.RecordBatch.from_arrays(
                [rows.column("id"), pa.array(np.diff(first), pa.int64()),
                 pa.ListArray.from_arrays(pa.array(counts), pa.StructArray.from_arrays([pa.array(x) for x in flat], fields=list(run_type))),
                 pa.LargeStringArray.from_buffers(len(each), pa.py_buffer(at_), pa.py_buffer(data)).cast(pa.string())],
                ["id", "n_words", "runs", "collapsed"])

    kind = docs.schema["id"].dataType.simpleString()
    out = docs.mapInArrow(run, f"id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
    return out.withColumnRenamed("id", doc_id)


def planted(text: Column, doc_id: Column) -> Column:
    """The query's planted repetition: in a tenth of the documents the words from a on repeat p words."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10).cast("long")

    def repeated(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        tail = F.slice(F.flatten(F.array_repeat(F.slice(w, a + 1, p), F.ceil((n - a) / p).cast("int"))), F.lit(1), (n - a).cast("int"))
        return F.array_join(F.concat(F.slice(w, F.lit(1), a), tail), " ")

    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return F.when(h % 10 == 0, let(words, lambda w: F.when(F.size(w) > 0, repeated(w)).otherwise(text))).otherwise(text)


def op12_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    docs = docs.select("doc_id", planted(F.col("text"), F.col("doc_id")).alias("text"))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    greater = lambda b, r: F.when(r["length"] * b["period"] > b["length"] * r["period"], r).otherwise(b)
    out = periodic_runs(docs).withColumn("best", F.aggregate("runs", F.get("runs", F.lit(0)), greater))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    return out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), *(f"best.{c}" for c in ("start", "length", "period")),
                      F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
                      F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


#: crc32 byte by byte, the planted words, pairs of equal words q apart, their islands, smallest periods
ORACLE = r"""
WITH RECURSIVE tab(i, k, c) AS (
  SELECT i, 0, i FROM range(256) t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM tab WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM tab WHERE k = 8),
raw AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^ 	-
]+'), []) AS w,
         xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))),
             lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS h
  FROM documents, crc),
par AS (SELECT *, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM raw),
par2 AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM par),
words AS (
  SELECT doc_id, i, w[CASE WHEN a IS NOT NULL AND i >= a THEN a + (i - a) % p ELSE i END + 1] AS x
  FROM (SELECT *, unnest(range(n)) AS i FROM par2)),
pairs AS (
  SELECT l.doc_id, l.i, r.i - l.i AS q FROM words l JOIN words r ON l.doc_id = r.doc_id AND l.x = r.x AND l.i < r.i),
isles AS (
  SELECT doc_id, q, min(i) AS s, max(i) + 1 + q - min(i) AS n
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS isle FROM pairs) GROUP BY doc_id, q, isle),
runs AS (
  SELECT * FROM isles a WHERE n >= greatest(6, 4 * q)
  AND NOT EXISTS (SELECT 1 FROM isles b WHERE b.doc_id = a.doc_id AND b.q < a.q AND b.n >= greatest(2, 2 * b.q) AND b.s <= a.s AND b.s + b.n >= a.s + a.n)),
summed AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || n || ',' || q || chr(10), '' ORDER BY s, q) AS listed FROM runs GROUP BY doc_id),
best AS (
  SELECT * FROM runs a WHERE NOT EXISTS (SELECT 1 FROM runs b WHERE b.doc_id = a.doc_id AND (b.n * a.q > a.n * b.q
    OR (b.n * a.q = a.n * b.q AND (b.s < a.s OR (b.s = a.s AND b.q < a.q)))))),
dropped AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + n)) AS i FROM runs),
kept AS (
  SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t FROM words ANTI JOIN dropped USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, CAST(b.s AS BIGINT) AS start, CAST(b.n AS BIGINT) AS length, CAST(b.q AS BIGINT) AS period,
       CAST(1000 * b.n // b.q AS BIGINT) AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
FROM documents d LEFT JOIN summed USING (doc_id) LEFT JOIN best b USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
