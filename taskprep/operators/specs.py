"""Structured query specs over a long cell table.

A spec is ``SELECT agg(col[sel]) FROM table WHERE col[c] op v AND ...``
(``agg`` 0..5 = none, MAX, MIN, COUNT, SUM, AVG; ``op`` 0..3 = ``=``, ``>``,
``<``, invalid). Thousands of small tables live in one DataFrame of cells::

    cells(table_id, row_idx, col_idx, col_type, num_val, text_val)
    meta(table_id, col_idx, col_type[, header])

A cell holds either a number (``num_val``) or text (``text_val``), like the
storage class of a value in a dynamically typed store: ``real`` columns hold
numbers, and text where the value is not numeric; ``text`` columns hold text.

Comparison rules (fixed, they decide which rows match):
* the condition value is lower-cased; for a ``real`` column it is turned into a
  number when possible (``1,234.5`` style, else the first numeric substring);
* a number is always less than a text; text compares byte-wise and
  case-sensitively; a null cell never matches;
* MAX/MIN: text beats numbers for MAX, numbers beat text for MIN; SUM/AVG use
  the leading numeric prefix of a text (else 0);
* no matching rows: none -> ``[]``, COUNT -> ``[0]``, others -> ``[null]``.

J6/A1/F3/F6 execution is a few joins: equality conditions join cells on
(table, column, value), range conditions on (table, column) plus a filter;
rows where every condition holds are counted per (spec, row); the selected
cells are joined back and aggregated. Aggregates under ranges alone are taken
from the sorted column or from groups of equal values instead, and what plain
selects list under ranges alone is counted by those groups and read from packs
of consecutive rows, without a stored row a match. Results are returned in long form
(one row per result value), never collected into one array per spec.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taskprep.functions.arrays import let
from taskprep.functions.text import coerce_number
from taskprep.operators.order import ranked
from taskprep.session import cut_lineage

# Aggregate and operator codes.
AGG_OPS = ["", "MAX", "MIN", "COUNT", "SUM", "AVG"]
COND_OPS = ["=", ">", "<", "OP"]

COND_TYPE = T.StructType([T.StructField("col", T.IntegerType()), T.StructField("op", T.IntegerType()),
                          T.StructField("val", T.StringType())])
SPEC_TYPE = T.StructType([T.StructField("sel", T.IntegerType()), T.StructField("agg", T.IntegerType()),
                          T.StructField("conds", T.ArrayType(COND_TYPE))])
LEADING_NUMBER = r"^\s*[-+]?(\d+\.?\d*([eE][-+]?\d+)?|\.\d+([eE][-+]?\d+)?)"


# ------------------------------------------------------------------ catalog

def table_name(c) -> F.Column:
    """``1-23-4`` -> ``table_1_23_4``; ids already starting with ``table`` kept."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.startswith("table"), c).otherwise(F.concat(F.lit("table_"), F.regexp_replace(c, "-", "_")))


def _cell(col_idx: int, col_type: str, value: F.Column, lower_text: bool) -> F.Column:
    if col_type == "real":
        num = value.cast("double")
        text = F.when(num.isNull() & value.isNotNull(), value.cast("string"))
    else:
        num = F.lit(None).cast("double")
        text = F.lower(value.cast("string")) if lower_text else value.cast("string")
    return F.struct(F.lit(col_idx).alias("col_idx"), F.lit(col_type).alias("col_type"),
                    num.alias("num_val"), text.alias("text_val"))


def melt(df: DataFrame, table_id: str, row_idx: F.Column, columns: Sequence[tuple[str, str]],
         lower_text: bool = True) -> DataFrame:
    """A relational table -> cells (narrow: one ``inline`` per row, no shuffle)."""
    cells = F.array(*[_cell(i, t, F.col(name), lower_text) for i, (name, t) in enumerate(columns)])
    return df.select(F.lit(table_id).alias("table_id"), row_idx.cast("long").alias("row_idx"), F.inline(cells))


def meta_of(table_id: str, columns: Sequence[tuple[str, str]], spark) -> DataFrame:
    rows = [(table_id, i, t, name) for i, (name, t) in enumerate(columns)]
    return spark.createDataFrame(rows, "table_id string, col_idx int, col_type string, header string")


def to_cells(tables: DataFrame, lower_text: bool = False) -> tuple[DataFrame, DataFrame]:
    """Tables in JSON shape (id, header, types, rows array<array<string>>) ->
    (cells, meta). Row order = position in ``rows``."""
    tid = table_name("id").alias("table_id")
    meta = tables.select(tid, F.posexplode(F.arrays_zip("header", "types")).alias("col_idx", "h")).select(
        "table_id", F.col("col_idx").cast("int"), F.col("h.types").alias("col_type"), F.col("h.header").alias("header"))
    rows = tables.select(tid, "types", F.posexplode("rows").alias("row_idx", "row"))
    cells = rows.select("table_id", F.col("row_idx").cast("long"),
                        F.posexplode(F.arrays_zip("row", "types")).alias("col_idx", "v"))
    v = F.col("v.row")
    is_real = F.col("v.types") == "real"
    # only what is written as a number is one: ``nan``, ``infinity`` or ``1d`` stay text
    num = F.when(is_real & v.rlike(LEADING_NUMBER + r"\s*$"), v.try_cast("double"))
    text = F.when(~is_real | num.isNull(), F.lower(v) if lower_text else v)
    cells = cells.select("table_id", "row_idx", F.col("col_idx").cast("int"), F.col("v.types").alias("col_type"),
                         num.alias("num_val"), F.when(v.isNotNull(), text).alias("text_val"))
    return cells, meta


# -------------------------------------------------------------- execution

def _conditions(specs: DataFrame, meta: DataFrame, last_value_wins: bool) -> DataFrame:
    c = specs.select("spec_id", "table_id", F.size("conds").alias("n_conds"),
                     F.posexplode("conds").alias("cond_no", "c"))
    c = c.select("spec_id", "table_id", "n_conds", "cond_no", F.col("c.col").alias("col_idx"),
                 F.col("c.op").alias("op"), F.lower(F.col("c.val")).alias("vtext"))
    if last_value_wins:
        # one bind name per column: the last value on a column is used for all of its conditions
        w = Window.partitionBy("spec_id", "col_idx")
        c = c.withColumn("vtext", F.max_by("vtext", "cond_no").over(w))
    c = c.join(meta.select("table_id", "col_idx", "col_type"), ["table_id", "col_idx"], "left")
    return c.withColumn("vnum", F.when(F.col("col_type") == "real", coerce_number("vtext")))


def spec_errors(specs: DataFrame, meta: DataFrame, conds: DataFrame | None = None) -> DataFrame:
    """Specs that cannot run (``spec_id, error``): an invalid operator, an
    unknown condition or selected column, an aggregate code outside 0..5."""
    c = conds if conds is not None else _conditions(specs, meta, False)
    bad_cond = c.filter(F.col("col_type").isNull() | ~F.col("op").between(0, 2)).select("spec_id")
    sel = specs.select("spec_id", "table_id", F.col("sel").alias("col_idx"), "agg").join(
        meta.select("table_id", "col_idx", F.lit(True).alias("known")), ["table_id", "col_idx"], "left")
    bad_sel = sel.filter(F.col("known").isNull() | ~F.col("agg").between(0, 5)).select("spec_id")
    bad = bad_cond.unionByName(bad_sel).distinct().withColumn("error", F.lit(True))
    return specs.select("spec_id").join(bad, "spec_id", "left").select(
        "spec_id", F.coalesce("error", F.lit(False)).alias("error"))


def _holds(op, vnum, vtext, num, text) -> F.Column:
    """Does a cell (num, text) satisfy ``op`` against the typed value?"""
    eq = F.when(vnum.isNotNull(), num == vnum).otherwise(text == vtext)
    gt = F.when(vnum.isNotNull(), (num > vnum) | text.isNotNull()).otherwise(text > vtext)
    lt = F.when(vnum.isNotNull(), num < vnum).otherwise(num.isNotNull() | (text < vtext))
    return F.coalesce(F.when(op == 0, eq).when(op == 1, gt).when(op == 2, lt), F.lit(False))


# A column of one large table is one join key; its rows are dealt over this many.
ROW_BLOCKS = 32


def _blocks(cells: DataFrame) -> DataFrame:
    return cells.withColumn("block", F.pmod(F.xxhash64("row_idx"), F.lit(ROW_BLOCKS)).cast("int"))


def _over_blocks(specs: DataFrame) -> DataFrame:
    return specs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(ROW_BLOCKS - 1))))


def matching_rows(specs: DataFrame, cells: DataFrame, meta: DataFrame, last_value_wins: bool = False,
                  conds: DataFrame | None = None) -> DataFrame:
    """(spec_id, table_id, row_idx) of rows where every condition holds
    (specs with conditions only). A condition with an invalid operator or an
    unknown column matches no row.

    Each spec has an anchor condition: its first equality when it has one,
    else its first condition. Only the anchor is matched against whole
    columns (an equality as an equi-join on the value itself, a range as an
    equi-join on (table, column, row block) plus a filter); every other condition is
    checked only on the anchor's rows, through an equi-join on
    (table, row, column).
    """
    c = conds if conds is not None else cut_lineage(_conditions(specs, meta, last_value_wins))
    key = ["table_id", "col_idx"]
    first_eq = F.min(F.when(F.col("op") == 0, F.col("cond_no"))).over(Window.partitionBy("spec_id"))
    anchor_no = F.coalesce(first_eq, F.min("cond_no").over(Window.partitionBy("spec_id")))
    c = c.withColumn("is_anchor", F.col("cond_no") == anchor_no)
    anchor, rest = c.filter("is_anchor"), c.filter(~F.col("is_anchor"))
    cols = ["spec_id", "table_id", "row_idx", "n_conds"]
    eq_num = (anchor.filter((F.col("op") == 0) & F.col("vnum").isNotNull())
              .select("spec_id", "table_id", "col_idx", "n_conds", F.col("vnum").alias("num_val"))
              .join(cells.select("table_id", "col_idx", "num_val", "row_idx"), [*key, "num_val"]).select(*cols))
    eq_text = (anchor.filter((F.col("op") == 0) & F.col("vnum").isNull())
               .select("spec_id", "table_id", "col_idx", "n_conds", F.col("vtext").alias("text_val"))
               .join(cells.select("table_id", "col_idx", "text_val", "row_idx"), [*key, "text_val"]).select(*cols))
    rng = _over_blocks(anchor.filter(F.col("op").isin(1, 2))).join(
        _blocks(cells.select("table_id", "col_idx", "row_idx", "num_val", "text_val")), [*key, "block"])
    rng = rng.filter(_holds(F.col("op"), F.col("vnum"), F.col("vtext"), F.col("num_val"), F.col("text_val")))
    # the anchor's rows feed both branches below
    cand = cut_lineage(eq_num.unionByName(eq_text).unionByName(rng.select(*cols)))
    single = cand.filter(F.col("n_conds") == 1).select("spec_id", "table_id", "row_idx")
    # remaining conditions, checked on the anchor's rows only
    multi = cand.filter(F.col("n_conds") > 1).join(
        rest.select("spec_id", "cond_no", "col_idx", "op", "vnum", "vtext"), "spec_id")
    checked = multi.join(cells.select("table_id", "row_idx", "col_idx", "num_val", "text_val"),
                         ["table_id", "row_idx", "col_idx"])
    ok = checked.filter(_holds(F.col("op"), F.col("vnum"), F.col("vtext"), F.col("num_val"), F.col("text_val")))
    # a (spec, condition, row) hit is unique: cells are unique per (table, row, column)
    per_row = ok.groupBy("spec_id", "table_id", "row_idx", "n_conds").agg(F.count(F.lit(1)).alias("n_hit"))
    multi_rows = per_row.filter(F.col("n_hit") == F.col("n_conds") - 1).select("spec_id", "table_id", "row_idx")
    return single.unionByName(multi_rows)


def _leading_number(text: F.Column) -> F.Column:
    m = F.regexp_extract(text, LEADING_NUMBER, 0)
    return F.when(text.isNull(), F.lit(None).cast("double")).otherwise(
        F.coalesce(F.when(m != "", F.trim(m)).try_cast("double"), F.lit(0.0)))


def _partials(num: F.Column, text: F.Column) -> list[F.Column]:
    """What every aggregate is made of; the parts of disjoint rows can be merged."""
    as_num = F.coalesce(num, _leading_number(text))
    return [F.count(F.coalesce(num.cast("string"), text)).alias("cnt"), F.max(num).alias("max_n"), F.max(text).alias("max_t"),
            F.min(num).alias("min_n"), F.min(text).alias("min_t"), F.sum(as_num).alias("sum_v"), F.count(as_num).alias("n_v")]


MERGED = {"cnt": F.sum, "max_n": F.max, "max_t": F.max, "min_n": F.min, "min_t": F.min, "sum_v": F.sum, "n_v": F.sum}


def _value_groups(shapes: DataFrame, cells: DataFrame) -> DataFrame:
    """Partial aggregates of a selected column by the values of condition columns.

    shapes: shape, table_id, sel, cols (sorted). Rows that agree in all ``cols``
    are one group: (shape, at, parts), ``at`` mapping a column to its (num, text).
    """
    wanted = shapes.select("shape", "table_id", "sel", F.explode(F.array_union("cols", F.array("sel"))).alias("col_idx"))
    held = wanted.join(cells.select("table_id", "row_idx", "col_idx", "num_val", "text_val"), ["table_id", "col_idx"])
    cell = F.struct(F.col("num_val").alias("num"), F.col("text_val").alias("text"))
    rows = held.groupBy("shape", "row_idx").agg(F.first("sel").alias("sel"), F.map_from_entries(F.collect_list(F.struct("col_idx", cell.alias("c")))).alias("m"))
    rows = rows.join(shapes.select("shape", "cols"), "shape")
    own = F.try_element_at("m", F.col("sel"))
    rows = rows.select("shape", F.transform("cols", lambda i: F.struct(i.alias("col"), F.try_element_at("m", i).alias("c"))).alias("at"), own["num"].alias("num"), own["text"].alias("text"))
    return rows.groupBy("shape", "at").agg(*_partials(F.col("num"), F.col("text")))


def _swept(specs: DataFrame, groups: DataFrame, name: str = "spec_id", merged: dict = MERGED) -> DataFrame:
    """Partial aggregates (``merged``: how each is merged) of specs with one range, by a sweep over the sorted column.

    Groups and bounds are laid out in one order, numbers before texts, a bound
    past its equals for ``>`` and ahead of them for ``<``. Running aggregates from
    below and from above, in each range partition and over the partitions
    before and after it, give every bound its result: a row a spec, no pairs.
    """
    parts = list(merged)
    cell = F.get("at", F.lit(0))["c"]
    key = lambda num, text: [num.isNull().cast("int").alias("is_text"), num.alias("num"), text.alias("text")]
    g = groups.filter(cell["num"].isNotNull() | cell["text"].isNotNull())
    g = g.select("shape", *key(cell["num"], cell["text"]), F.lit(1).alias("place"), F.lit(None).cast("string").alias(name), F.lit(0).alias("op"), *parts)
    c = F.get("cs", F.lit(0))
    b = specs.select("shape", *key(c["vnum"], F.when(c["vnum"].isNull(), c["vtext"])), F.when(c["op"] == 1, 2).otherwise(0).alias("place"), F.col(name), c["op"].alias("op"))
    order = ["shape", "is_text", "num", "text", "place"]
    n = int(specs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = g.unionByName(b, allowMissingColumns=True).repartitionByRange(n, *order).sortWithinPartitions(*order)
    laid = cut_lineage(laid.withColumn("part", F.spark_partition_id()).withColumn("i", F.monotonically_increasing_id()))
    sums = laid.filter("place = 1").groupBy("shape", "part").agg(*(merged[p](p).alias(p) for p in parts))
    every = laid.select("shape", "part").distinct().join(sums, ["shape", "part"], "left")
    over = Window.partitionBy("shape").orderBy("part")
    outer = {"lo": over.rowsBetween(Window.unboundedPreceding, -1), "hi": over.rowsBetween(1, Window.unboundedFollowing)}
    totals = every.select("shape", "part", *(merged[p](p).over(w).alias(f"{side}_{p}") for side, w in outer.items() for p in parts))
    inside = Window.partitionBy("shape", "part").orderBy("i")
    inner = {"lo": inside.rowsBetween(Window.unboundedPreceding, -1), "hi": inside.rowsBetween(1, Window.unboundedFollowing)}
    run = laid.select("shape", "part", name, "op", *(merged[p](p).over(w).alias(f"in_{side}_{p}") for side, w in inner.items() for p in parts)).filter(F.col(name).isNotNull())
    merge = {F.sum: lambda x, y: F.coalesce(x + y, x, y), F.max: F.greatest, F.min: F.least}
    both = run.join(totals, ["shape", "part"])
    pick = lambda p: F.when(F.col("op") == 1, merge[merged[p]](F.col(f"in_hi_{p}"), F.col(f"hi_{p}"))).otherwise(merge[merged[p]](F.col(f"in_lo_{p}"), F.col(f"lo_{p}")))
    return both.select(name, *(pick(p).alias(p) for p in parts))


def _ranged(specs: DataFrame, conds: DataFrame, once: bool = False) -> DataFrame:
    """Of ``specs``, those whose conditions (one at least) are all ranges: spec_id, table_id, sel, cs (conditions), cols, shape.

    With ``once`` those whose id repeats are left out."""
    own = conds.groupBy("spec_id").agg(F.max((~F.col("op").isin(1, 2)).cast("int")).alias("other"), F.collect_list(F.struct("col_idx", "op", "vnum", "vtext")).alias("cs"), F.max("n_conds").alias("n"))
    own = own.filter(F.size("cs") == F.col("n")).drop("n") if once else own.drop("n")
    cols = F.array_sort(F.array_distinct(F.transform("cs", lambda c: c["col_idx"])))
    ranged = specs.select("spec_id", "table_id", "sel").join(own.filter("other = 0").drop("other"), "spec_id").withColumn("cols", cols)
    return cut_lineage(ranged.withColumn("shape", F.concat_ws(":", F.col("table_id"), F.col("sel"), F.array_join("cols", ","))))


def _all_hold(at) -> F.Column:
    """Do the condition cells ``at`` satisfy every condition of ``cs``?"""
    held = lambda c: F.get(F.filter(at, lambda x: x["col"] == c["col_idx"]), F.lit(0))["c"]
    return F.forall("cs", lambda c: let(held(c), lambda x: _holds(c["op"], c["vnum"], c["vtext"], x["num"], x["text"])))


def _shape_rows(ranged: DataFrame, cells: DataFrame) -> DataFrame:
    """The rows that specs of a shape may list: shape, row_idx, ``at`` (condition cells) and ``own`` (selected cells).

    A row lists nothing without a selected cell. Cells that repeat are rows of
    their own under one condition column and match nothing under more."""
    shapes = ranged.select("shape", "table_id", "sel", "cols").distinct()
    wanted = shapes.select("shape", "table_id", "sel", "cols", F.explode(F.array_union("cols", F.array("sel"))).alias("col_idx"))
    held = wanted.join(cells.filter("row_idx IS NOT NULL").select("table_id", "row_idx", "col_idx", "num_val", "text_val"), ["table_id", "col_idx"])
    cell = F.struct(F.col("num_val").alias("num"), F.col("text_val").alias("text"))
    rows = held.groupBy("shape", "row_idx").agg(F.first("sel").alias("sel"), F.first("cols").alias("cols"), F.collect_list(F.struct(F.col("col_idx").alias("col"), cell.alias("c"))).alias("m"))
    mine = F.filter("m", lambda x: F.array_contains("cols", x["col"]))
    own = F.transform(F.filter("m", lambda x: x["col"] == F.col("sel")), lambda x: x["c"])
    rows = rows.select("shape", "row_idx", "cols", mine.alias("mine"), own.alias("own")).filter(F.size("own") > 0)
    lone = rows.filter(F.size("cols") == 1).select("shape", "row_idx", F.explode("mine").alias("x"), "own").select("shape", "row_idx", F.array("x").alias("at"), "own")
    more = rows.filter((F.size("cols") > 1) & (F.size("mine") == F.size("cols"))).filter(F.size(F.array_distinct(F.transform("mine", lambda x: x["col"]))) == F.size("cols"))
    return lone.unionByName(more.select("shape", "row_idx", F.array_sort("mine").alias("at"), "own"))


def _range_sizes(ranged: DataFrame, cells: DataFrame) -> DataFrame:
    """spec_id, n_results: how many rows specs of ranges alone (``_ranged``) match, none for none.

    Rows of a shape are counted by the values of its condition columns. One
    range is answered by the sweep, more by meeting the counted groups, which
    go straight into the sums."""
    groups = cut_lineage(_shape_rows(ranged, cells).groupBy("shape", "at").agg(F.count(F.lit(1)).alias("n")))
    one = _swept(ranged.filter(F.size("cs") == 1), groups.filter(F.size("at") == 1), merged={"n": F.sum})
    dealt = groups.withColumn("block", F.pmod(F.xxhash64("at"), F.lit(ROW_BLOCKS)).cast("int"))
    met = _over_blocks(ranged.filter(F.size("cs") > 1).select("spec_id", "shape", "cs")).join(dealt, ["shape", "block"]).filter(_all_hold("at"))
    return one.filter("n > 0").select("spec_id", F.col("n").alias("n_results")).unionByName(met.groupBy("spec_id").agg(F.sum("n").alias("n_results")))


# Consecutive values of a column that are listed together, and over how many keys the specs that meet them are dealt.
LIST_ROWS, LIST_SALTS = 1 << 16, 8


def _range_lists(ranged: DataFrame, cells: DataFrame) -> DataFrame:
    """(spec_id, res_pos, num, text): the values that specs of ranges alone (``_ranged``) list, in row order.

    The values of a shape are numbered and packed, ``LIST_ROWS`` in their order a
    pack, with their places in it by the values of the condition columns. A spec
    tests those values, first to count what it takes of each pack, then, with the
    counts of the packs before, to list it where it lies: matched rows are never
    written, shuffled or sorted."""
    rows = ranked(_shape_rows(ranged, cells).select("shape", "row_idx", "at", F.explode("own").alias("c")), ["row_idx"], "shape", name="__p")
    rows = rows.select("shape", "at", "c", F.floor((F.col("__p") - 1) / LIST_ROWS).alias("block"), ((F.col("__p") - 1) % LIST_ROWS).cast("int").alias("i"))
    pack = ["shape", "block"]
    groups = rows.groupBy(*pack, "at").agg(F.collect_list("i").alias("places")).groupBy(*pack).agg(F.collect_list(F.struct("at", "places")).alias("groups"))
    values = rows.groupBy(*pack).agg(F.array_sort(F.collect_list(F.struct("i", "c"))).alias("x")).select(*pack, F.transform("x", lambda x: x["c"]).alias("cells"))
    packs = cut_lineage(groups.join(values, pack))
    dealt = lambda df: df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(LIST_SALTS - 1))))
    specs = ranged.select("spec_id", "shape", "cs", F.pmod(F.xxhash64("spec_id"), F.lit(LIST_SALTS)).cast("int").alias("salt"))
    specs = specs.join(packs.select(*pack).distinct(), "shape")
    met = F.filter("groups", lambda g: _all_hold(g["at"]))
    counts = specs.join(dealt(packs.select(*pack, "groups")), [*pack, "salt"])
    counts = cut_lineage(counts.select("spec_id", "cs", *pack, "salt", F.aggregate(met, F.lit(0), lambda n, g: n + F.size(g["places"])).alias("n")).filter("n > 0"))
    before = Window.partitionBy("spec_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.withColumn("off", F.coalesce(F.sum("n").over(before), F.lit(0)))
    taken = F.transform(F.array_sort(F.flatten(F.transform(met, lambda g: g["places"]))), lambda i: F.get("cells", i))
    listed = placed.join(dealt(packs), [*pack, "salt"]).select("spec_id", "off", F.posexplode(taken).alias("i", "c"))
    return listed.select("spec_id", (F.col("off") + F.col("i")).cast("int").alias("res_pos"), F.col("c.num").alias("num"), F.col("c.text").alias("text"))


def _range_aggregates(specs: DataFrame, conds: DataFrame, cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Partial aggregates of the aggregate specs whose conditions are all ranges, and those specs' ids.

    Their rows are never matched one by one: a table is first grouped by the
    values of the condition columns, once for all specs of one shape (table,
    selected column, condition columns). One range is answered by the sweep,
    more by meeting the groups that are left.
    """
    ranged = _ranged(specs.filter(F.col("agg").between(1, 5)), conds)
    groups = cut_lineage(_value_groups(ranged.select("shape", "table_id", "sel", "cols").distinct(), cells))
    one = _swept(ranged.filter(F.size("cs") == 1), groups.filter(F.size("at") == 1))
    dealt = groups.withColumn("block", F.pmod(F.xxhash64("at"), F.lit(ROW_BLOCKS)).cast("int"))
    met = _over_blocks(ranged.filter(F.size("cs") > 1).select("spec_id", "shape", "cs")).join(dealt, ["shape", "block"]).filter(_all_hold("at"))
    more = met.groupBy("spec_id").agg(*(f(p).alias(p) for p, f in MERGED.items()))
    return one.unionByName(more), ranged.select("spec_id")


def run_specs(specs: DataFrame, cells: DataFrame, meta: DataFrame, last_value_wins: bool = False,
              width: int = 1 << 16) -> DataFrame:
    """Execute every spec; long result ``(spec_id, res_pos, num, text)``.

    agg none: one row per selected value in row order (an empty result has no
    rows); aggregates: one row with ``res_pos`` 0. Specs with errors yield no
    rows (see :func:`spec_status`).
    """
    conds = cut_lineage(_conditions(specs, meta, last_value_wins))
    # errors only change aggregates: a bad condition or column already matches nothing
    bad = spec_errors(specs, meta, conds).filter("error").select("spec_id")
    ok = specs
    ranged, by_range = _range_aggregates(ok, conds, cells)
    plain = _ranged(ok.filter(F.col("agg") == 0), conds, True)
    by_range = by_range.unionByName(plain.select("spec_id"))
    with_conds = ok.filter(F.size("conds") > 0).join(by_range, "spec_id", "left_anti")
    no_conds = ok.filter(F.size("conds") == 0)
    rows = matching_rows(with_conds, cells, meta, last_value_wins, conds.join(by_range, "spec_id", "left_anti"))
    sel = ok.select("spec_id", F.col("sel").alias("col_idx"), "agg")
    picked_c = rows.join(sel, "spec_id").join(
        cells.select("table_id", "row_idx", "col_idx", "num_val", "text_val"), ["table_id", "row_idx", "col_idx"])
    picked_n = _over_blocks(no_conds.select("spec_id", "table_id", F.col("sel").alias("col_idx"), "agg")).join(
        _blocks(cells.select("table_id", "row_idx", "col_idx", "num_val", "text_val")), ["table_id", "col_idx", "block"])
    cols = ["spec_id", "agg", "row_idx", "num_val", "text_val"]
    # the selected values feed the bucket counts, the ordered list and the aggregates
    picked = cut_lineage(picked_c.select(*cols).unionByName(picked_n.select(*cols)))

    # agg none: the selected values in row order, positions from a bucketed global rank
    listed = ranked(picked.filter(F.col("agg") == 0), ["row_idx"], "spec_id", name="__p")
    listed = listed.select("spec_id", (F.col("__p") - 1).cast("int").alias("res_pos"),
                           F.col("num_val").alias("num"), F.col("text_val").alias("text"))

    # aggregates: one row per spec, empty groups restored by the left join
    agg_rows = picked.filter(F.col("agg") > 0).groupBy("spec_id").agg(*_partials(F.col("num_val"), F.col("text_val")))
    aggs = (ok.filter(F.col("agg").between(1, 5)).select("spec_id", "agg").join(bad, "spec_id", "left_anti")
            .join(agg_rows.unionByName(ranged), "spec_id", "left"))
    a = F.col("agg")
    out_num = (F.when(a == 1, F.when(F.col("max_t").isNull(), F.col("max_n")))
               .when(a == 2, F.col("min_n"))
               .when(a == 3, F.coalesce(F.col("cnt"), F.lit(0)).cast("double"))
               .when(a == 4, F.col("sum_v"))
               .when(a == 5, F.when(F.col("n_v") > 0, F.col("sum_v") / F.col("n_v"))))
    out_text = (F.when(a == 1, F.col("max_t"))
                .when(a == 2, F.when(F.col("min_n").isNull(), F.col("min_t"))))
    aggs = aggs.select("spec_id", F.lit(0).alias("res_pos"), out_num.alias("num"), out_text.cast("string").alias("text"))
    return listed.unionByName(_range_lists(plain, cells)).unionByName(aggs)


def result_sizes(specs: DataFrame, cells: DataFrame, meta: DataFrame) -> DataFrame:
    """spec_id, n_results: how many values each spec gives, none where it has an
    error, without selecting, ordering or aggregating any."""
    conds = cut_lineage(_conditions(specs, meta, False))
    fine = specs.join(spec_errors(specs, meta, conds).filter("error").select("spec_id"), "spec_id", "left_anti")
    plain = fine.filter(F.col("agg") == 0)
    sel = plain.select("spec_id", "table_id", F.col("sel").alias("col_idx"))
    ranged = _ranged(plain, conds, True)
    some = plain.filter(F.size("conds") > 0).join(ranged.select("spec_id"), "spec_id", "left_anti")
    hit = matching_rows(some, cells, meta, False, conds.join(some.select("spec_id"), "spec_id", "left_semi"))
    hit = hit.join(sel.select("spec_id", "col_idx"), "spec_id").join(cells.select("table_id", "row_idx", "col_idx"), ["table_id", "row_idx", "col_idx"], "left_semi")
    columns = cells.groupBy("table_id", "col_idx").agg(F.count(F.lit(1)).alias("n_results"))
    whole = sel.join(plain.filter(F.size("conds") == 0).select("spec_id"), "spec_id", "left_semi").join(columns, ["table_id", "col_idx"])
    one = fine.filter(F.col("agg").between(1, 5)).select("spec_id", F.lit(1).cast("long").alias("n_results"))
    return hit.groupBy("spec_id").agg(F.count(F.lit(1)).alias("n_results")).unionByName(whole.select("spec_id", "n_results")).unionByName(one).unionByName(_range_sizes(ranged, cells))


def spec_status(specs: DataFrame, sizes: DataFrame, meta: DataFrame) -> DataFrame:
    """Per spec: number of result values, executable (result list not empty),
    error. ``sizes`` is what ``result_sizes`` gives, or the results themselves."""
    n = sizes if "n_results" in sizes.columns else sizes.groupBy("spec_id").agg(F.count(F.lit(1)).alias("n_results"))
    err = spec_errors(specs, meta)
    return (specs.select("spec_id").join(err, "spec_id", "left").join(n, "spec_id", "left")
            .select("spec_id", F.coalesce("n_results", F.lit(0)).alias("n_results"),
                    (F.coalesce("n_results", F.lit(0)) > 0).alias("executable"), "error"))


def _column_extremes(cells: DataFrame) -> DataFrame:
    """One row a column: the smallest and largest number and text (null where it has none)."""
    return cells.groupBy("table_id", "col_idx").agg(*(f(v).alias(f"{n}_{v[:-4]}") for v in ("num_val", "text_val") for n, f in (("min", F.min), ("max", F.max))))


def _held_values(own: DataFrame, sel: DataFrame, cells: DataFrame) -> DataFrame:
    """Of lone equality conditions, the specs (spec_id) whose value a row with a selected cell holds.

    Columns are cut to their distinct values once for all specs, so a value that
    many rows hold and many specs ask for is one row."""
    own = own.join(sel.select("spec_id", F.col("col_idx").alias("sel")), "spec_id")
    wanted = F.broadcast(own.select("table_id", "col_idx", "sel").distinct())
    there = F.broadcast(wanted.select("table_id", F.col("sel").alias("col_idx")).distinct())
    chosen = cells.join(there, ["table_id", "col_idx"]).select("table_id", "row_idx", F.col("col_idx").alias("sel")).distinct()
    held = cells.select("table_id", "row_idx", "col_idx", "num_val", "text_val").join(wanted, ["table_id", "col_idx"])
    held = held.join(chosen, ["table_id", "row_idx", "sel"], "left_semi").select("table_id", "sel", "col_idx", "num_val", "text_val").distinct()
    asked = own.select("spec_id", "table_id", "sel", "col_idx", F.col("vnum").alias("num_val"), F.when(F.col("vnum").isNull(), F.col("vtext")).alias("text_val"))
    # each asked value is looked up once, however many specs ask for it
    keys = ["table_id", "sel", "col_idx"]
    found = [asked.join(asked.filter(f"{v} IS NOT NULL").select(*keys, v).distinct().join(held.select(*keys, v).distinct(), [*keys, v], "left_semi"), [*keys, v], "left_semi").select("spec_id")
             for v in ("num_val", "text_val")]
    return found[0].unionByName(found[1])


def keep_executable(candidates: DataFrame, cells: DataFrame, meta: DataFrame) -> DataFrame:
    """candidates whose query returns a non-empty list (an aggregate over no
    rows is executable; an empty row list is not).

    An aggregate always has a result; a plain select needs one matching row. A
    lone range has one where an extreme of its column lies beyond the bound, so
    it meets a row a column, and a lone equality where its value is among the
    column's distinct ones. Ranges alone are counted by value groups. Other
    conditions are matched against rows, whose existence is all that is asked:
    no ranks, values or aggregates."""
    conds = _conditions(candidates, meta, False)
    fine = candidates.join(spec_errors(candidates, meta, conds).filter("error").select("spec_id"), "spec_id", "left_anti")
    plain = fine.filter(F.col("agg") == 0)
    sel = plain.select("spec_id", "table_id", F.col("sel").alias("col_idx"))
    lone = (F.col("n_conds") == 1) & F.col("op").isin(1, 2)
    own = conds.join(plain.select("spec_id"), "spec_id", "left_semi")
    op, vnum, vtext = F.col("op"), F.col("vnum"), F.col("vtext")
    above = F.when(vnum.isNotNull(), (F.col("max_num") > vnum) | F.col("max_text").isNotNull()).otherwise(F.col("max_text") > vtext)
    below = F.when(vnum.isNotNull(), F.col("min_num") < vnum).otherwise(F.col("min_num").isNotNull() | (F.col("min_text") < vtext))
    ranges = own.filter(lone).join(_column_extremes(cells), ["table_id", "col_idx"]).filter(F.when(op == 1, above).otherwise(below))
    equal = _held_values(own.filter((F.col("n_conds") == 1) & (op == 0)), sel, cells)
    rest = own.filter(F.col("n_conds") > 1)
    ranged = _ranged(plain.join(rest.select("spec_id").distinct(), "spec_id", "left_semi"), rest, True)
    rest = rest.join(ranged.select("spec_id"), "spec_id", "left_anti")
    hit = matching_rows(plain.join(rest.select("spec_id").distinct(), "spec_id", "left_semi"), cells, meta, False, rest)
    hit = hit.join(sel.select("spec_id", "col_idx"), "spec_id").join(cells.select("table_id", "row_idx", "col_idx"), ["table_id", "row_idx", "col_idx"], "left_semi")
    whole = sel.join(plain.filter(F.size("conds") == 0).select("spec_id"), "spec_id", "left_semi").join(
        cells.select("table_id", "col_idx").distinct(), ["table_id", "col_idx"], "left_semi")
    some = hit.select("spec_id").unionByName(ranges.select("spec_id")).unionByName(whole.select("spec_id")).unionByName(equal).unionByName(_range_sizes(ranged, cells).select("spec_id")).distinct()
    return candidates.join(fine.filter(F.col("agg").between(1, 5)).select("spec_id").unionByName(some), "spec_id", "left_semi")


# --------------------------------------------------- spec manipulation

def decompose_spec(df: DataFrame, spec: str = "sql") -> DataFrame:
    """P10: sel, agg, number of conditions, condition columns / ops / values."""
    s = F.col(spec)
    return df.withColumns({
        "sel": s.sel, "agg": s.agg, "wn": F.size(s.conds),
        "wc": F.transform(s.conds, lambda c: c.col),
        "wo": F.transform(s.conds, lambda c: c.op),
        "wv": F.transform(s.conds, lambda c: c.val),
        "spec_error": s.agg < 0,
    })


def assemble_spec(df: DataFrame, sel="sel", agg="agg", wn="wn", wc="wc", wo="wo", wv="wv", out="sql") -> DataFrame:
    """Spec struct from predicted parts; conditions cut to ``wn``."""
    zipped = F.arrays_zip(F.col(wc).alias("col"), F.col(wo).alias("op"), F.col(wv).alias("val"))
    conds = F.slice(zipped, 1, F.col(wn))
    conds = F.transform(conds, lambda c: F.struct(c["col"].cast("int").alias("col"), c["op"].cast("int").alias("op"),
                                                  c["val"].cast("string").alias("val")))
    return df.withColumn(out, F.struct(F.col(sel).cast("int").alias("sel"), F.col(agg).cast("int").alias("agg"),
                                       conds.alias("conds")))


def sort_conditions(df: DataFrame, spec: str = "sql") -> DataFrame:
    """Conditions sorted by column index (stable), parts kept aligned."""
    s = F.col(spec)
    indexed = F.transform(s.conds, lambda c, i: F.struct(c.col.alias("col"), i.alias("i"), c.alias("c")))
    ordered = F.transform(F.array_sort(indexed), lambda x: x.c)
    return df.withColumn(spec, F.struct(s.sel.alias("sel"), s.agg.alias("agg"), ordered.alias("conds")))


def render_spec(df: DataFrame, spec: str = "sql", header: str = "header", table: str = "table_id",
                out: str = "query_text") -> DataFrame:
    """``SELECT agg(h) FROM id WHERE h op v AND ...`` with header names;
    agg none still writes the parentheses."""
    s, h = F.col(spec), F.col(header)
    # an unknown column, operator or aggregate makes this row's text null, not the job fail
    agg_name = F.get(F.array(*[F.lit(a.lower()) for a in AGG_OPS]), s.agg)
    ops = F.array(*[F.lit(o) for o in COND_OPS])
    head = F.concat(F.lit("SELECT "), agg_name, F.lit("("), F.get(h, s.sel), F.lit(") FROM "), F.col(table))
    conds = F.transform(s.conds, lambda c: F.concat(F.get(h, c.col), F.lit(" "), F.get(ops, c.op), F.lit(" "),
                                                    F.coalesce(c.val, F.lit(""))))
    conds = F.when(F.forall(conds, lambda x: x.isNotNull()), conds)
    where = F.when(F.size(s.conds) > 0, F.concat(F.lit(" WHERE "), F.array_join(conds, " AND "))).otherwise(F.lit(""))
    return df.withColumn(out, F.concat(head, where))


def legal_agg(df: DataFrame, sel_type: str = "sel_type", agg: str = "agg") -> F.Column:
    """text columns allow only none and COUNT; real allows all; other types are errors (null)."""
    t = F.col(sel_type)
    return (F.when(t == "text", F.col(agg).isin(0, 3)).when(t == "real", F.lit(True)))


def table_context(df: DataFrame, header: str = "header", out: str = "context") -> DataFrame:
    """Headers joined by a space."""
    return df.withColumn(out, F.array_join(F.col(header), " "))


def spans_from_conditions(df: DataFrame, question: str = "question", spec: str = "sql",
                          out: str = "wv_spans") -> DataFrame:
    """Each condition value's first case-insensitive occurrence in the
    question as a character span [st, ed); null when any value is absent."""
    q = F.lower(F.col(question))
    spans = F.transform(F.col(spec).conds, lambda c: F.struct(
        (F.position(F.lower(c.val), q) - 1).alias("st"),
        (F.position(F.lower(c.val), q) - 1 + F.length(c.val)).alias("ed")))
    ok = F.forall(spans, lambda s: s.st >= 0)
    return df.withColumn(out, F.when(ok, spans)).withColumn("unmappable", ~ok)


def number_within(df: DataFrame, group: str, pos: str, out: str = "qid") -> DataFrame:
    """Running number of each row inside its group, id = ``group-n``."""
    r = ranked(df, [pos], group, name="__n")
    return r.withColumn(out, F.concat_ws("-", F.col(group), (F.col("__n") - 1).cast("string"))).drop("__n")


def attach_tables(questions: DataFrame, tables: DataFrame, key: str = "table_id") -> DataFrame:
    """Each question with its table (header, types); ``missing`` marks a
    question whose table is absent (an error in the original, a flag here)."""
    t = tables.select(F.col("id").alias(key), *[c for c in tables.columns if c != "id"], F.lit(True).alias("__t"))
    out = questions.join(t, key, "left")
    return out.withColumn("missing", F.col("__t").isNull()).drop("__t")
