"""Benchmark decontamination by winnowing: fingerprints, a join, and extension of the hits.

Words of documents and items are hashed; of every ``WINDOW`` consecutive
words the smallest ``GRAM_WORDS``-gram hash is kept (the rightmost of ties).
The choice depends on the window's words alone, so an item window that occurs
in a document leaves at least one fingerprint that both sides kept. Equal
fingerprints are joined, each hit names an alignment of the document with the
item, and the alignment is compared word by word: runs of at least a window
are contamination. An item of fewer words is one window; such lengths are
winnowed with a window of their own length, one pass a length that occurs
(at most ``WINDOW`` - 1 of them).

The fingerprints of the items are written first, so the planner sees their
size and broadcasts them only under its own threshold; beyond it the join is a
shuffle join.

Defined cases: a null text has no words and is clean; an item without words
matches nothing; repeated rows, and rows without id, are judged by their own
text; a null ``item_id`` hits but is not listed; empty tables give no rows or
no hits; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from taskprep.llm import arrow_text as at
from taskprep.session import cut_lineage, read_table

WINDOW, GRAM_WORDS = 13, 5
#: every ASCII character that is neither a letter nor a digit
SEPARATORS = bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TABLE = at.byte_values(SEPARATORS)


def winnow(h: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of every ``length``-word window of a word-hash sequence, and their positions."""
    k = min(GRAM_WORDS, length)
    g = at.gram_hashes(h, k)
    pos = np.unique(at.sliding_min_pos(g, length - k + 1))
    return at.mix64(g[pos] + at.U64(length)).view(np.int64), pos


def fingerprints(rows: DataFrame, keys: list[str], lengths: list[int], items: bool = False) -> DataFrame:
    """keys, n, fp, pos: the winnowed fingerprints of ``text`` for each window length.

    An item is winnowed for its own length alone: ``WINDOW``, or its words.
    """
    kept = rows.select(*keys, "text")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema.fields if f.name != "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, buf, offs in at.chunks(batches, "text"):
            h, _, _, first = at.find_words(buf, offs, TABLE)
            fps, poss, lens = [], [], []
            for s, e in zip(first[:-1].tolist(), first[1:].tolist()):
                use = [min(e - s, WINDOW)] if items else lengths
                got = [winnow(h[s:e], length) for length in use if 0 < length <= e - s]
                fps += [x[0] for x in got]
                poss += [x[1] for x in got]
                lens.append(sum(len(x[0]) for x in got))
            lens = np.array(lens, np.int64)
            fp = np.concatenate(fps) if fps else np.empty(0, np.int64)
            pos = np.concatenate(poss) if poss else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [*(part.column(k) for k in keys), pa.array(np.diff(first), pa.int32()), at.list_array(fp, lens, pa.int64()), at.list_array(pos.astype(np.int32), lens, pa.int32())],
                [*keys, "n", "fp", "pos"])

    found = kept.mapInArrow(run, f"{kinds}, n int, fp array<long>, pos array<int>")
    return found.select(*keys, "n", F.explode(F.arrays_zip("fp", "pos")).alias("x")).select(*keys, "n", "x.fp", "x.pos")


def item_words(items: DataFrame) -> DataFrame:
    """iid, ith, words: the word hashes of every distinct item."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, buf, offs in at.chunks(batches, "text"):
            h, _, _, first = at.find_words(buf, offs, TABLE)
            yield pa.RecordBatch.from_arrays([part.column("iid"), part.column("ith"), at.list_array(h.view(np.int64), np.diff(first), pa.int64())], ["iid", "ith", "words"])

    return items.mapInArrow(run, f"iid {items.schema['iid'].dataType.simpleString()}, ith long, words array<long>")


def aligned_slices(docs: DataFrame) -> DataFrame:
    """One row an alignment: the document's words that lie under the item."""
    kind = docs.schema["id"].dataType.simpleString()
    iid = docs.schema["hits"].dataType.elementType["iid"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, buf, offs in at.chunks(batches, "text"):
            h, _, _, first = at.find_words(buf, offs, TABLE)
            hits = part.column("hits")
            own, flat = np.repeat(np.arange(part.num_rows), hits.value_lengths().to_numpy(zero_copy_only=False)), hits.flatten()
            diag, n = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("diag", "n"))
            s = first[own] + np.maximum(diag, 0)
            e = np.minimum(first[own + 1], first[own] + diag + n)
            words = np.concatenate([h[a:b] for a, b in zip(s.tolist(), e.tolist())]) if len(s) else np.empty(0, at.U64)
            take = pa.array(own)
            yield pa.RecordBatch.from_arrays(
                [part.column("id").take(take), part.column("th").take(take), flat.field("iid"), flat.field("ith"), pa.array(diag.astype(np.int32)),
                 pa.array((s - first[own]).astype(np.int32)), at.list_array(words.view(np.int64), e - s, pa.int64())],
                ["id", "th", "iid", "ith", "diag", "at", "found"])

    return docs.mapInArrow(run, f"id {kind}, th long, iid {iid}, ith long, diag int, at int, found array<long>")


def equal_runs(pairs: DataFrame) -> DataFrame:
    """id, th, iid, s, e: document word ranges that hold whole windows of the item."""
    kind, iid = pairs.schema["id"].dataType.simpleString(), pairs.schema["iid"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, starts, ends = [], [], []
            cols = [batch.column(c) for c in ("found", "words")]
            for i, (diag, pos) in enumerate(zip(batch.column("diag").to_pylist(), batch.column("at").to_pylist())):
                x, y = (c[i].values.to_numpy(zero_copy_only=False) for c in cols)
                same = np.zeros(len(x) + 2, bool)
                same[1:-1] = x == y[pos - diag : pos - diag + len(x)]
                edge = np.flatnonzero(same[1:] != same[:-1])
                for s, e in zip(edge[::2].tolist(), edge[1::2].tolist()):
                    if e - s >= min(WINDOW, len(y)):
                        rows.append(i)
                        starts.append(pos + s)
                        ends.append(pos + e)
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in ("id", "th", "iid")), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], ["id", "th", "iid", "s", "e"])

    return pairs.select("id", "th", "iid", "diag", "at", "found", "words").mapInArrow(run, f"id {kind}, th long, iid {iid}, s int, e int")


def contaminated_spans(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """id, th (hash of the text), iid, s, e: every maximal run of a document's words that holds windows of an item."""
    docs = docs.select(F.col(doc_id).alias("id"), F.xxhash64(text).alias("th"), F.col(text).alias("text"))
    items = benchmark.select(F.col(item_id).alias("iid"), F.xxhash64(item_text).alias("ith"), F.col(item_text).alias("text")).distinct()
    iw = cut_lineage(item_words(items).filter("size(words) > 0"))
    lengths = [r[0] for r in iw.select(F.least(F.lit(WINDOW), F.size("words"))).distinct().collect()]  # at most WINDOW
    marks = cut_lineage(fingerprints(items, ["iid", "ith"], [], items=True).withColumnRenamed("pos", "ipos"))
    hits = fingerprints(docs, ["id", "th"], lengths).drop("n").join(marks, "fp")
    hits = hits.select("id", "th", "iid", "ith", (F.col("pos") - F.col("ipos")).alias("diag"), "n").distinct()
    hits = cut_lineage(hits.groupBy("id", "th").agg(F.collect_list(F.struct("iid", "ith", "diag", "n")).alias("hits")))
    hit = hits.select(F.col("id").alias("hid"), F.col("th").alias("hth"), "hits")
    found = docs.join(hit, F.col("id").eqNullSafe(F.col("hid")) & (F.col("th") == F.col("hth"))).select("id", "th", "text", "hits")
    iw = iw.select(F.col("iid").alias("wid"), F.col("ith").alias("wth"), "words")
    pairs = aligned_slices(found).join(iw, F.col("iid").eqNullSafe(F.col("wid")) & (F.col("ith") == F.col("wth")))
    return equal_runs(pairs).distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", percent: int = 5, **names: str) -> DataFrame:
    """``docs`` columns are kept under ``row``; beside it n_words, n_hit, n_items, items_sha256, contaminated.

    A document is contaminated when at least ``percent`` of its words are hit.
    """
    spans = cut_lineage(contaminated_spans(docs, benchmark, doc_id=doc_id, text=text, **names))
    before = Window.partitionBy("id", "th").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.greatest(F.col("s"), F.coalesce(F.max("e").over(before), F.lit(0)))
    words = spans.withColumn("new", F.greatest(F.lit(0), F.col("e") - reach)).groupBy("id", "th").agg(
        F.sum("new").alias("n_hit"), F.array_sort(F.collect_set(F.col("iid").cast("string"))).alias("items"))
    words = words.select(F.col("id").alias("wid"), F.col("th").alias("wth"), "n_hit", "items")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(doc_id).alias("id"), F.xxhash64(text).alias("th"),
                       F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("n_words"))
    out = rows.join(words, F.col("id").eqNullSafe(F.col("wid")) & (F.col("th") == F.col("wth")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select(
        "row", "n_words", n_hit.alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * 100 >= percent * F.col("n_words"))).alias("contaminated"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate(docs, read_table(spark, sf_dir, "benchmark"))
    return out.select("row.doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
iw AS (SELECT DISTINCT item_id, least(len(w), 13) AS l, array_to_string(list_slice(w, p, p + least(len(w), 13) - 1), ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS p FROM i WHERE len(w) > 0)),
ls AS (SELECT DISTINCT l FROM iw),
dw AS (SELECT doc_id, l, p, array_to_string(list_slice(w, p, p + l - 1), ' ') AS win
  FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS p FROM d CROSS JOIN ls WHERE len(w) >= l)),
hit AS (SELECT doc_id, p, dw.l, item_id FROM dw JOIN iw ON dw.l = iw.l AND dw.win = iw.win),
pos AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + l)) AS q FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
