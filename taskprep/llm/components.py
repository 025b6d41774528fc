"""Connected components of an edge table by hash-random contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taskprep.session import cut_lineage

#: up to so many edges are contracted by one task, whatever the input's size; more go by rounds until so few are left
FEW = 1 << 16


def contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """u, to: every node of the edges (a, b) and one node of its component."""
    parts = list(batches)
    if not parts:
        return
    edges = pa.Table.from_batches(parts).combine_chunks()
    nodes = pa.chunked_array([*edges.column("a").chunks, *edges.column("b").chunks]).combine_chunks().dictionary_encode()
    if isinstance(nodes, pa.ChunkedArray):
        nodes = nodes.combine_chunks()
    x, y = nodes.indices.to_numpy().reshape(2, -1)
    name = np.arange(len(nodes.dictionary))
    while (name[x] != name[y]).any():
        np.minimum.at(name, np.maximum(name[x], name[y]), np.minimum(name[x], name[y]))
        while (name != name[name]).any():
            name = name[name]
    yield pa.RecordBatch.from_arrays([nodes.dictionary, nodes.dictionary.take(pa.array(name))], ["u", "to"])


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of ``edges`` (a, b): comp is the smallest node reachable.

    Each round every vertex takes the name of the vertex with the smallest
    round-seeded hash among itself and its neighbours, edges are renamed, and
    loops and doubles go. Chains shrink by a constant factor whatever their
    order, so rounds grow with the logarithm of the longest one. A hot vertex
    is only ever a key of a map-side combined minimum. The last ``FEW`` edges,
    whose rounds would each cost more than they do, are contracted by one task.
    """
    edges = cut_lineage(edges.select("a", "b").filter("a <> b").distinct())
    labels = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("cur", F.col("node"))
    r = 0
    while left := edges.count():
        if left <= FEW:
            kind = edges.schema["a"].dataType.simpleString()
            names = cut_lineage(edges.repartition(1).mapInArrow(contracted, f"u {kind}, to {kind}"))
            labels = labels.join(names, F.col("cur") == F.col("u"), "left").select("node", F.coalesce("to", "cur").alias("cur"))
            break
        h = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(r)).alias("h"), F.col(c).alias("v"))
        both = edges.select(F.col("a").alias("u"), h("b").alias("m")).union(edges.select(F.col("b"), h("a")))
        best = both.groupBy("u").agg(F.min("m").alias("m"))
        names = cut_lineage(best.select("u", F.least("m", F.struct(F.xxhash64("u", F.lit(r)).alias("h"), F.col("u").alias("v")))["v"].alias("to")))
        # the renamings are applied one after the other when the labels are read
        labels = labels.join(names, F.col("cur") == F.col("u"), "left").select("node", F.coalesce("to", "cur").alias("cur"))
        a, b = names.select(F.col("u").alias("a"), F.col("to").alias("ta")), names.select(F.col("u").alias("b"), F.col("to").alias("tb"))
        edges = edges.join(a, "a").join(b, "b").filter("ta <> tb")
        edges = cut_lineage(edges.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct())
        r += 1
    labels = cut_lineage(labels)
    roots = labels.groupBy("cur").agg(F.min("node").alias("comp"))
    return labels.join(roots, "cur").select("node", "comp")
