"""SimHash near-duplicates: segment popcounts as an embedding, a grid range join, exact verification.

1. A fingerprint bit is set where over half of a document's word shingles
   (repeats included) have it set in their XXH64. Documents of one fingerprint
   are one class before anything is joined.
2. Embedding: the fingerprint's 32 segments of two bits, each by the number of
   bits set in it. Counts are written as thermometers (0, 01, 11), so the
   embedding is one long, and the Manhattan distance of two embeddings is the
   popcount of their XOR. It never exceeds the fingerprints' own distance.
3. Grid: the segments lie in ``distance`` + ``ALIKE`` groups. A pair within the
   distance can differ in ``distance`` groups at most, so in ``ALIKE`` of them its
   Manhattan distance is 0: each choice of ``ALIKE`` groups is a grid, its cell
   the counts in them. Members of a cell are compared under the Manhattan bound
   first, then by exact distance.
4. No cell yields all its pairs. Each member is compared with its cell's hub
   (the member that comes first in one order of all fingerprints) and links are
   contracted; then members outside a cell's largest component meet the members
   of its other components. A pair within the distance is so either linked or
   already connected, nothing is capped, and a join gives out links alone.

n fingerprints spread evenly meet 1.5e-7 n others by chance in a cell (equal
counts of half the segments; two bits' counts are equal in 3 cases of 8), in each
of 70 grids. ``alike`` is the choice between more grids and fuller cells: with 3
there are 35 grids, but 1.5e-6 n others.

Defined cases: a null text, an empty one or one without words has fingerprint
zero, linked like any other; fewer words than a shingle are one shingle; a row
without id is linked like any other, but names no component (its component_id
is null where no member has an id); repeated rows get equal results; a bit set
in exactly half the hashes is 0; very long texts are hashed whole, in blocks;
an empty table gives no rows; other columns are not read and cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taskprep.llm import arrow_text as at
from taskprep.llm.components import components
from taskprep.session import cut_lineage, read_table

WORDS, DISTANCE, SEED = 4, 4, 42
SEGMENTS, ALIKE = 32, 4
#: shingles whose bits are unpacked at once
BLOCK = 1 << 16
TABLE = at.byte_values(at.WHITE)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def bit_majorities(h: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    """For each document the bits that over half of its hashes have; ``doc`` ascends."""
    ones = np.zeros((docs, 64), np.int64)
    for i in range(0, len(h), BLOCK):
        bits = np.unpackbits(h[i : i + BLOCK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        d = doc[i : i + BLOCK]
        heads = np.concatenate([[0], np.flatnonzero(np.diff(d)) + 1])
        ones[d[heads]] += np.add.reduceat(bits, heads, axis=0, dtype=np.int64)
    total = np.bincount(doc, minlength=docs)
    return np.packbits(2 * ones > total[:, None], axis=1).reshape(-1).view(">u8").astype(np.uint64)


def fingerprints(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, seed: int = SEED) -> DataFrame:
    """id, fp: the 64-bit SimHash of each text's shingles of ``words`` words, ASCII letters lower-cased."""
    docs = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, offs in at.chunks(batches, "text"):
            _, starts, ends, first = at.find_words(buf, offs, TABLE)
            data, _, s, e = at.join_words(LOWER[buf], starts, ends, first)
            count = np.diff(first)
            held = np.where(count >= words, count - words + 1, np.minimum(count, 1))
            doc = np.repeat(np.arange(len(count)), held)
            # word number of each shingle's first and last word
            head = np.arange(len(doc)) - np.repeat(np.cumsum(held) - held, held) + first[doc]
            tail = np.minimum(head + words, first[doc + 1]) - 1
            view = memoryview(data)
            h = np.fromiter((xxhash.xxh64_intdigest(view[a:b], seed) for a, b in zip(s[head].tolist(), e[tail].tolist())), np.uint64, len(doc))
            fp = bit_majorities(h, doc, len(count))
            yield pa.RecordBatch.from_arrays([rows.column("id"), pa.array(fp.view(np.int64))], ["id", "fp"])

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, fp long")


def embedding(fp: Column) -> Column:
    """Segment popcounts as thermometers: the Manhattan distance of two is the popcount of their XOR."""
    low = F.lit(0x5555555555555555)
    up = F.shiftrightunsigned(fp, 1)
    return fp.bitwiseOR(up).bitwiseAND(low).bitwiseOR(F.shiftleft(fp.bitwiseAND(up).bitwiseAND(low), 1))


def grid_masks(distance: int, alike: int) -> list[int]:
    """The bits of each choice of ``alike`` groups of segments, as signed longs."""
    groups = [0] * (distance + alike)
    for s in range(SEGMENTS):
        groups[s % len(groups)] |= 3 << 2 * s
    return [m - (1 << 64) if m >> 63 else m for m in (sum(c) for c in combinations(groups, alike))]


def near(a: str, b: str, distance: int) -> Column:
    """The Manhattan bound on embeddings, then the exact distance."""
    bound = F.bit_count(embedding(F.col(a)).bitwiseXOR(embedding(F.col(b)))) <= distance
    return bound & (F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= distance)


def cells(points: DataFrame, distance: int, alike: int) -> DataFrame:
    """(grid, cell, hub) and the columns of ``points`` (fp, ...), for cells in which points may be near each other.

    Most cells that are shared by chance hold two points; the bits in which their
    OR and AND differ are then those in which the two do, so that such a cell
    is judged by the counts of cells, and its points never leave their place.
    Spark sizes an exploded table by the rows it came from, and files by their
    compressed bytes, so no side of the joins by cell is left to be broadcast.
    """
    masks = grid_masks(distance, alike)
    dealt = (points.withColumn("t", embedding(F.col("fp")))
             .select(*points.columns, "t", F.posexplode(F.array(*[F.lit(m) for m in masks])).alias("grid", "mask"))
             .select("grid", F.col("t").bitwiseAND(F.col("mask")).alias("cell"), *points.columns))
    hubs = dealt.groupBy("grid", "cell").agg(F.count(F.lit(1)).alias("n"), F.min_by("fp", F.xxhash64("fp")).alias("hub"), F.bit_or("fp").alias("some"), F.bit_and("fp").alias("all"))
    apart = F.bit_count(F.col("some").bitwiseXOR(F.col("all")))
    hubs = hubs.filter((F.col("n") > 2) | ((F.col("n") == 2) & (apart <= distance)))
    return cut_lineage(dealt.hint("merge").join(hubs.select("grid", "cell", "hub"), ["grid", "cell"]))


def linked(points: DataFrame, distance: int, alike: int) -> DataFrame:
    """(node, comp) for the fingerprints that others are within the distance of, chains included."""
    met = cells(points, distance, alike)
    comps = cut_lineage(components(met.filter((F.col("fp") != F.col("hub")) & near("fp", "hub", distance)).select(F.col("fp").alias("a"), F.col("hub").alias("b"))))
    named = met.drop("hub").join(comps, F.col("fp") == F.col("node"), "left").withColumn("comp", F.coalesce("comp", "fp")).drop("node")
    named = cut_lineage(named)
    per = named.groupBy("grid", "cell", "comp").agg(F.count(F.lit(1)).alias("c"))
    main = per.groupBy("grid", "cell").agg(F.max(F.struct("c", "comp")).alias("m"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    named = cut_lineage(named.hint("merge").join(main.select("grid", "cell", F.col("m.comp").alias("main")), ["grid", "cell"]))
    x = named.filter("comp <> main").select("grid", "cell", F.col("fp").alias("x_fp"), F.col("comp").alias("x_comp"))
    y = named.withColumn("in_main", F.col("comp") == F.col("main")).drop("main")
    once = (F.col("x_comp") != F.col("comp")) & (F.col("in_main") | (F.col("x_fp") < F.col("fp")))
    met_again = x.hint("merge").join(y, (x["grid"] == y["grid"]) & (x["cell"] == y["cell"]) & once & near("x_fp", "fp", distance))
    more = met_again.select(F.col("x_comp").alias("a"), F.col("comp").alias("b")).distinct()
    return components(comps.select(F.col("node").alias("a"), F.col("comp").alias("b")).union(more))


def simhash_groups(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, distance: int = DISTANCE,
                   alike: int = ALIKE, seed: int = SEED) -> DataFrame:
    """doc_id, fp (long), component_id: smallest id reachable over fingerprints that differ in ``distance`` bits or fewer."""
    rows = cut_lineage(fingerprints(docs, doc_id=doc_id, text=text, words=words, seed=seed))
    classes = cut_lineage(rows.groupBy("fp").agg(F.min("id").alias("least")))
    comps = linked(classes.select("fp"), distance, alike)
    named = cut_lineage(classes.join(comps, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("comp", "fp").alias("comp")))
    ids = named.groupBy("comp").agg(F.min("least").alias("component_id"))
    named = named.join(ids, "comp").select("fp", "component_id")
    return rows.join(named, "fp").select(F.col("id").alias(doc_id), "fp", "component_id")


def op13_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash_groups(read_table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
