"""Merkle dataset manifest: leaf places by bitmap rank, slot arrays reduced level by level, proofs for every row.

1. A row's leaf is the hash of its fields. Rows that are equal in all of them
   collapse to one with a count.
2. Ids become bitmaps: per group a 64-bit word for every 64 ids that holds any,
   merged by OR. Their directory sums the counts of words, of runs of words, of
   runs of those and so on (``DIRECTORY`` bits a level), each level inside its own parent
   only. A leaf's place in its group is the directory's count before its word
   plus the popcount of the word's lower bits: leaves are never sorted. Words
   in which an id stands for several rows list the surplus. Rows of one id that
   differ are placed in the order of their leaves, by the same ranks over the
   leaf's leading bits.
3. Leaves meet by (group, place / ``slots``) in slot arrays; each reduces as many
   levels as it spans at once and passes one node on, until a group has one
   left, its subroot. The subroots are the leaves of the last tree.
4. From the top down every slot array gets the proof of its own node and adds
   the levels inside it, so a proof is only put together where it is returned.

No array is longer than ``slots``, no key heavier than that (a word has 64 ids),
whatever the sizes of groups, and what reaches the driver is the largest count.

Defined cases: null fields hash as ``-``; a null id comes first in its group, a
null group first of all; repeated rows each have a leaf and a proof of their
own; rows of one id in one group ascend by leaf; a group of one row has its leaf
as subroot, a table of one group its subroot as root; a null or empty text and
very long texts are hashed whole; an empty table gives no rows; other columns
are not read and cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from taskprep.operators.order import ranked
from taskprep.session import cut_lineage, read_table

SLOTS = 1024
DIRECTORY = (10, 14, 14)
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: the word of null ids, below that of any long; hex digits of a leaf that fit a long
NIL_WORD, LEAF_HEX = -(1 << 62), 15


def framed(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, ``:`` and the value."""
    s = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf_hash(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*map(framed, values)), 256)


def counts_before(nodes: DataFrame, by: list[str], widths: Sequence[int] = DIRECTORY) -> DataFrame:
    """``by``, k, base: the sum of c over smaller k of the same ``by``; one directory level for each width."""
    below = lambda *keys: Window.partitionBy(*by, *keys).orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    inside = lambda *keys: F.coalesce(F.sum("c").over(below(*keys)), F.lit(0))
    if not widths:
        return nodes.select(*by, "k", inside().alias("base"))
    nodes = nodes.withColumn("up", F.shiftright("k", widths[0]))
    parents = nodes.groupBy(*by, "up").agg(F.sum("c").alias("c")).withColumnRenamed("up", "k")
    parents = counts_before(parents, by, widths[1:]).select(*by, F.col("k").alias("up"), F.col("base").alias("over"))
    nodes = nodes.withColumn("part", inside("up"))
    return nodes.join(parents, [*by, "up"]).select(*by, "k", (F.col("over") + F.col("part")).alias("base"))


def bitmap_ranks(units: DataFrame, by: list[str]) -> DataFrame:
    """``units`` (``by``, word, low, c; each key once) with ``before``: the rows of smaller keys of the same ``by``."""
    bit = F.expr("shiftleft(1L, low)")
    surplus = F.when(F.col("c") > 1, F.struct(F.col("low").alias("at"), (F.col("c") - 1).alias("more")))
    words = cut_lineage(units.groupBy(*by, "word").agg(F.bit_or(bit).alias("bits"), F.sum("c").alias("n"), F.collect_list(surplus).alias("surplus")))
    base = counts_before(words.select(*by, F.col("word").alias("k"), F.col("n").alias("c")), by).withColumnRenamed("k", "word")
    popcount = F.bit_count(F.expr("bits & ~shiftleft(-1L, low)"))
    more = F.expr("aggregate(filter(surplus, x -> x.at < low), 0L, (s, x) -> s + x.more)")
    return (units.join(words.join(base, [*by, "word"]), [*by, "word"])
            .withColumn("before", F.col("base") + popcount + more).select(*units.columns, "before"))


def placed(leaves: DataFrame) -> DataFrame:
    """Leaves (g, id, leaf, ...) with ``copies`` of equal ones taken together and ``pos``, the first one's place in its group."""
    rows = leaves.groupBy(*leaves.columns).agg(F.count(F.lit(1)).alias("copies"))
    rows = rows.withColumn("word", F.coalesce(F.shiftright("id", 6), F.lit(NIL_WORD))).withColumn("low", F.coalesce(F.col("id").bitwiseAND(63), F.lit(0)).cast("int"))
    rows = cut_lineage(rows)
    key = ["g", "word", "low"]
    units = cut_lineage(rows.groupBy(*key).agg(F.sum("copies").alias("c"), F.count(F.lit(1)).alias("kinds")))
    at = bitmap_ranks(units, ["g"]).select(*key, "kinds", F.col("before").alias("start"))
    rows = rows.join(at, key)
    # rows that share their id with others: ranked by leaf among these
    lead = F.conv(F.substring("leaf", 1, LEAF_HEX), 16, 10).cast("long")
    several = rows.filter("kinds > 1").select(F.col("g").alias("g0"), F.col("word").alias("w0"), F.col("low").alias("l0"), "leaf", "copies", lead.alias("lead"))
    several = several.select("g0", "w0", "l0", "leaf", F.shiftright("lead", 6).alias("word"), F.col("lead").bitwiseAND(63).cast("int").alias("low"), F.col("copies").alias("c"))
    among = bitmap_ranks(several, ["g0", "w0", "l0"]).select(F.col("g0").alias("g"), F.col("w0").alias("word"), F.col("l0").alias("low"), "leaf", "before")
    alone = rows.filter("kinds = 1").withColumn("pos", F.col("start"))
    shared = rows.filter("kinds > 1").join(among, [*key, "leaf"]).withColumn("pos", F.col("start") + F.col("before"))
    return alone.unionByName(shared.drop("before")).drop("word", "low", "kinds", "start")


def reduce_slots(nodes: list[str], fan: int, depth: int | None) -> list[list[str]]:
    """The levels above ``nodes``: ``depth`` of them, or up to a single node."""
    levels = [nodes]
    while len(levels) <= depth if depth is not None else len(levels[-1]) > 1:
        x = levels[-1]
        levels.append([hashlib.sha256("".join(x[i : i + fan]).encode()).hexdigest() for i in range(0, len(x), fan)])
    return levels


def path_in(levels: list[list[str]], slot: int, fan: int) -> tuple[list[int], list[str]]:
    """A slot's place in its run and the run's other nodes, level by level."""
    places, siblings = [], []
    for x in levels[:-1]:
        slot, i = divmod(slot, fan)
        run = x[slot * fan : (slot + 1) * fan]
        places.append(i)
        siblings.append("".join(run[:i] + run[i + 1 :]))
    return places, siblings


def slot_depth(fan: int, slots: int) -> int:
    """Levels that a slot array spans."""
    depth = 1
    while fan ** (depth + 1) <= slots:
        depth += 1
    return depth


def slot_levels(row: dict, fan: int, depth: int) -> list[list[str]]:
    """The levels that a slot array spans: all up to the last node where it holds its whole group."""
    nodes = [x["node"] for x in sorted(row["slots"], key=lambda x: x["slot"]) for _ in range(x.get("copies", 1))]
    return reduce_slots(nodes, fan, None if row["n"] <= fan**depth else depth)


PROOF = {"places": "array<int>", "siblings": "array<string>"}
KINDS = {"string": pa.string(), "long": pa.int64(), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string())}


def each_block(blocks: DataFrame, columns: Mapping[str, str], emit: Callable[[dict], list[dict]]) -> DataFrame:
    """The rows that ``emit`` makes of every block; one block's rows are a batch."""
    schema = pa.schema([(c, KINDS[kind]) for c, kind in columns.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield pa.RecordBatch.from_pylist(emit(batch.slice(i, 1).to_pylist()[0]), schema=schema)

    return blocks.mapInArrow(run, ", ".join(f"{c} {kind}" for c, kind in columns.items()))


def climb(blocks: DataFrame, most: int, fan: int, depth: int) -> tuple[list[DataFrame], DataFrame]:
    """The tables of slot arrays (g, block, n, slots) from ``blocks`` up, and the last node (g, node) of every group."""
    span = fan**depth
    tables = [blocks]
    while True:
        up = each_block(tables[-1], {"g": "string", "pos": "long", "n": "long", "node": "string"}, lambda row: [
            {"g": row["g"], "pos": row["block"], "n": -(-row["n"] // span), "node": slot_levels(row, fan, depth)[-1][0]}])
        most = -(-most // span)
        if most <= 1:
            return tables, cut_lineage(up.select("g", "node"))
        slot = F.struct((F.col("pos") % span).alias("slot"), "node")
        tables.append(cut_lineage(up.groupBy("g", F.floor(F.col("pos") / span).cast("long").alias("block"), "n").agg(F.collect_list(slot).alias("slots"))))


def descend(tables: list[DataFrame], paths: DataFrame, fan: int, depth: int) -> DataFrame:
    """The lowest slot arrays, each with the proof (places, siblings) of its own node; ``paths`` has those of the groups."""
    paths = paths.withColumn("block", F.lit(0).cast("long"))
    span = fan**depth

    def emit(row: dict) -> list[dict]:
        levels, out = slot_levels(row, fan, depth), []
        for x in row["slots"]:
            places, siblings = path_in(levels, x["slot"], fan)
            out.append({"g": row["g"], "block": row["block"] * span + x["slot"], "places": places + row["places"], "siblings": siblings + row["siblings"]})
        return out

    for table in reversed(tables[1:]):
        paths = cut_lineage(each_block(table.join(paths, ["g", "block"]), {"g": "string", "block": "long", **PROOF}, emit))
    return tables[0].join(paths, ["g", "block"])


def folded(leaf: Column, places: Column, siblings: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    step = lambda h, s: F.sha2(F.concat(F.substring(s["siblings"], F.lit(1), 64 * s["places"]), h, F.substring(s["siblings"], 64 * s["places"] + 1, F.length(s["siblings"]))), 256)
    return F.aggregate(F.arrays_zip(places.alias("places"), siblings.alias("siblings")), leaf, step)


def merkle_manifest(docs: DataFrame, *, doc_id: str = "doc_id", group: str = "lang", fields: Sequence[str] = FIELDS,
                    claimed: Mapping[str, Column] | None = None, fan: int = 2, slots: int = SLOTS) -> DataFrame:
    """doc_id, leaf, claimed_leaf, subroot, root, places, siblings, folded_root, verified: one row for each row of ``docs``.

    ``claimed`` gives the values of some fields as another holder states them;
    the proof is folded from the leaf over those. ``places`` and ``siblings``
    are the proof: for each level up to the root the node's place in its run
    and the run's other nodes, left to right. Ids are integers.
    """
    claimed = dict(claimed or {})
    depth = slot_depth(fan, slots)
    span = fan**depth
    own = [F.col(c) for c in fields]
    changed = F.lit(False)
    for c, value in claimed.items():
        changed = changed | ~F.col(c).eqNullSafe(value)
    leaves = docs.select(
        F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("g"),  # null first, then bytewise
        F.col(doc_id).cast("long").alias("id"), leaf_hash(own).alias("leaf"),
        F.when(changed, leaf_hash([claimed.get(c, F.col(c)) for c in fields])).alias("claimed"))
    rows = cut_lineage(placed(leaves))
    sizes = cut_lineage(rows.groupBy("g").agg(F.sum("copies").alias("n")))
    most = sizes.agg(F.max("n")).first()[0] or 1

    # slot arrays of leaves; equal rows that reach over a border are in both arrays
    blocks = rows.withColumn("block", F.explode(F.sequence(F.floor(F.col("pos") / span).cast("long"), F.floor((F.col("pos") + F.col("copies") - 1) / span).cast("long"))))
    begin, end = F.greatest(F.col("pos"), F.col("block") * span), F.least(F.col("pos") + F.col("copies"), (F.col("block") + 1) * span)
    slot = F.struct((begin - F.col("block") * span).alias("slot"), (end - begin).alias("copies"), F.col("leaf").alias("node"), "id", "claimed")
    blocks = blocks.groupBy("g", "block").agg(F.collect_list(slot).alias("slots")).join(sizes, "g")
    tables, subroots = climb(cut_lineage(blocks), most, fan, depth)

    # the tree of subroots: one leaf a group
    order = cut_lineage(ranked(subroots, ["g"], name="rn").select((F.col("rn") - 1).alias("pos"), "g", "node"))
    groups = order.count()
    top = order.select(F.lit("").alias("g"), F.floor(F.col("pos") / span).cast("long").alias("block"), F.lit(groups).cast("long").alias("n"), F.struct((F.col("pos") % span).alias("slot"), "node").alias("x"))
    upper, root = climb(cut_lineage(top.groupBy("g", "block", "n").agg(F.collect_list("x").alias("slots"))), groups, fan, depth)
    none = root.select("g", F.array().cast("array<int>").alias("places"), F.array().cast("array<string>").alias("siblings"))

    def proofs(row: dict) -> Iterator[tuple[dict, int, list[int], list[str]]]:
        levels = slot_levels(row, fan, depth)
        for x in row["slots"]:
            for i in range(x.get("copies", 1)):
                places, siblings = path_in(levels, x["slot"] + i, fan)
                yield x, x["slot"] + i, places + row["places"], siblings + row["siblings"]

    named = each_block(descend(upper, none, fan, depth), {"pos": "long", **PROOF}, lambda row: [
        {"pos": row["block"] * span + s, "places": p, "siblings": q} for _, s, p, q in proofs(row)])
    heads = cut_lineage(order.join(named, "pos").select("g", F.col("node").alias("subroot"), "places", "siblings").withColumn("root", root.select("node").scalar()))
    out = each_block(descend(tables, heads.select("g", "places", "siblings"), fan, depth), {"g": "string", "id": "long", "leaf": "string", "claimed": "string", **PROOF}, lambda row: [
        {"g": row["g"], "id": x["id"], "leaf": x["node"], "claimed": x["claimed"], "places": p, "siblings": q} for x, _, p, q in proofs(row)])
    out = out.join(heads.select("g", "subroot", "root"), "g").withColumn("claimed_leaf", F.coalesce("claimed", "leaf"))
    out = out.withColumn("folded_root", folded(F.col("claimed_leaf"), F.col("places"), F.col("siblings")))
    return out.select(F.col("id").alias(doc_id), "leaf", "claimed_leaf", "subroot", "root", "places", "siblings", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    rows = merkle_manifest(read_table(spark, sf_dir, "documents"), claimed={"n_chars": tampered})
    return rows.select("doc_id", "leaf", "subroot", "root", F.sha2(F.array_join("siblings", ""), 256).alias("proof_sha256"), "folded_root", "verified")


#: crc32 byte by byte, both trees level by level, every leaf's siblings, the fold along them
ORACLE = r"""
WITH RECURSIVE tab(i, k, c) AS (
  SELECT i, 0, i FROM range(256) t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM tab WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM tab WHERE k = 8),
raw AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))),
            lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 7 = 0 AS forged
  FROM documents, crc),
hashed AS (
  SELECT doc_id, lang,
         sha256(coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
                || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         sha256(coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
                || coalesce(strlen(CAST(n_chars + forged::INT AS VARCHAR)) || ':' || (n_chars + forged::INT), '-') || coalesce(strlen(text) || ':' || text, '-')) AS claimed
  FROM raw),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM hashed),
low AS (
  SELECT 0 AS lvl, lang, pos, leaf AS h, n FROM leaves
  UNION ALL SELECT lvl + 1, lang, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM low WHERE n > 1 GROUP BY lvl, lang, pos // 2, n),
subs AS (SELECT lang, h AS subroot, lvl AS depth, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM low WHERE n = 1),
top AS (
  SELECT 0 AS lvl, pos, subroot AS h, n FROM subs
  UNION ALL SELECT lvl + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM top WHERE n > 1 GROUP BY lvl, pos // 2, n),
own AS (
  SELECT l.lang, l.pos, l.leaf, l.claimed, l.doc_id, s.subroot, s.depth, s.pos AS sub_pos FROM leaves l JOIN subs s ON l.lang IS NOT DISTINCT FROM s.lang),
steps AS (
  SELECT o.lang, o.pos, a.lvl, b.h AS sib, b.pos < a.pos AS before
  FROM own o JOIN low a ON a.lang IS NOT DISTINCT FROM o.lang AND a.pos = o.pos >> a.lvl AND a.n > 1
  LEFT JOIN low b ON b.lang IS NOT DISTINCT FROM a.lang AND b.lvl = a.lvl AND b.pos = xor(a.pos, 1)
  UNION ALL
  SELECT o.lang, o.pos, o.depth + a.lvl, b.h, b.pos < a.pos
  FROM own o JOIN top a ON a.pos = o.sub_pos >> a.lvl AND a.n > 1 LEFT JOIN top b ON b.lvl = a.lvl AND b.pos = xor(a.pos, 1)),
fold AS (
  SELECT lang, pos, 0 AS lvl, claimed AS h FROM own
  UNION ALL SELECT f.lang, f.pos, f.lvl + 1, sha256(CASE WHEN s.before THEN s.sib ELSE '' END || f.h || CASE WHEN NOT s.before THEN s.sib ELSE '' END)
  FROM fold f JOIN steps s ON f.lang IS NOT DISTINCT FROM s.lang AND f.pos = s.pos AND f.lvl = s.lvl),
ends AS (SELECT lang, pos, arg_max(h, lvl) AS folded_root FROM fold GROUP BY lang, pos),
proofs AS (SELECT lang, pos, sha256(coalesce(string_agg(sib, '' ORDER BY lvl), '')) AS proof_sha256 FROM steps GROUP BY lang, pos)
SELECT o.doc_id, o.leaf, o.subroot, r.h AS root, coalesce(p.proof_sha256, sha256('')) AS proof_sha256, e.folded_root, e.folded_root = r.h AS verified
FROM own o JOIN ends e ON o.lang IS NOT DISTINCT FROM e.lang AND o.pos = e.pos
LEFT JOIN proofs p ON o.lang IS NOT DISTINCT FROM p.lang AND o.pos = p.pos, (SELECT h FROM top WHERE n = 1) r
"""
