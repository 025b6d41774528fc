"""Registered spec-evaluation queries: gold and predicted specs derived from
``orders`` rows (one question per order), over the melted ``orders`` table
(headers = its melted column names).

gold: sel = orderkey % 5, agg = custkey % 6, orderkey % 4 conditions, k-th =
(col (custkey + 2k) % 5, op (orderkey + k) % 3, val 'v' || (custkey * (k+1)) % 97).
pred: some select/aggregate changes, a condition count that differs for odd
customers, upper-cased values for every fifth customer, conditions sorted by
column (assembled from parts, as a decoder emits them).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taskprep.operators import components as C
from taskprep.operators import specs as SP
from taskprep.session import read_table, spread

HEADERS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
TYPES = ["real", "real", "text", "real", "text"]


def _conds(n, upper) -> F.Column:
    ks = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<bigint>"))
    return F.transform(ks, lambda k: F.struct(
        ((F.col("o_custkey") + 2 * k) % 5).cast("int").alias("col"),
        ((F.col("o_orderkey") + k) % 3).cast("int").alias("op"),
        F.when(upper, F.upper(F.concat(F.lit("v"), ((F.col("o_custkey") * (k + 1)) % 97).cast("string"))))
        .otherwise(F.concat(F.lit("v"), ((F.col("o_custkey") * (k + 1)) % 97).cast("string"))).alias("val")))


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    o = spread(read_table(spark, sf, "orders").select("o_orderkey", "o_custkey"))
    g = F.struct((F.col("o_orderkey") % 5).cast("int").alias("sel"), (F.col("o_custkey") % 6).cast("int").alias("agg"),
                 _conds(F.col("o_orderkey") % 4, F.lit(False)).alias("conds"))
    # predicted parts, assembled and sorted by column
    n_p = (F.col("o_orderkey") + F.col("o_custkey") % 2) % 4
    raw = _conds(n_p, F.col("o_custkey") % 5 == 0)
    parts = o.select(
        F.col("o_orderkey").alias("qid"), g.alias("g"),
        F.when(F.col("o_custkey") % 3 == 0, (F.col("o_orderkey") + 1) % 5).otherwise(F.col("o_orderkey") % 5)
        .alias("sel"),
        F.when(F.col("o_orderkey") % 7 == 0, (F.col("o_custkey") + 1) % 6).otherwise(F.col("o_custkey") % 6)
        .alias("agg"),
        n_p.alias("wn"), F.transform(raw, lambda c: c.col).alias("wc"), F.transform(raw, lambda c: c.op).alias("wo"),
        F.transform(raw, lambda c: c.val).alias("wv"))
    assembled = SP.assemble_spec(parts, out="p")
    return SP.sort_conditions(assembled, "p").select("qid", "g", "p")


def component_scores(spark: SparkSession, sf: str) -> DataFrame:
    """A2-A6, A8 per question."""
    f = C.component_flags(pairs(spark, sf))
    return f.select("qid", "sc", "sa", "wn", "wc", "wo", "wv", "lx")


def value_span_scores(spark: SparkSession, sf: str) -> DataFrame:
    """A5: predicted value spans against gold ones. A condition's value spans
    [col * 7, col * 7 + length of the value); the predictions of every eleventh
    order are a character off."""
    off = F.when(F.col("qid") % 11 == 0, F.lit(1)).otherwise(F.lit(0))
    span = lambda c, by: F.struct((c.col * 7 + by).alias("st"), (c.col * 7 + F.length(c.val) + by).alias("ed"))
    rows = pairs(spark, sf).withColumn("g_spans", F.transform(F.col("g").conds, lambda c: span(c, F.lit(0)))).withColumn(
        "p_spans", F.transform(F.col("p").conds, lambda c: span(c, off)))
    return C.value_span_flags(rows).select("qid", "wvi")


def component_totals(spark: SparkSession, sf: str) -> DataFrame:
    """A2 counts and accuracies; lx = logical-form accuracy."""
    t = C.component_totals(C.component_flags(pairs(spark, sf)))
    return t.select("n", *[F.col(f"cnt_{k}") for k in ["sc", "sa", "wn", "wc", "wo", "wv", "lx"]],
                    *[F.round(f"acc_{k}", 6).alias(f"acc_{k}") for k in ["sc", "sa", "wn", "wc", "wo", "wv", "lx"]])


def rendered_specs(spark: SparkSession, sf: str) -> DataFrame:
    """Readable query text of the gold spec, select
    legality, table context, and the character spans of the gold values in the
    predicted query text (unmappable when a value is absent)."""
    pr = pairs(spark, sf).withColumn("header", F.array(*[F.lit(h) for h in HEADERS])).withColumn(
        "types", F.array(*[F.lit(t) for t in TYPES])).withColumn("table_id", F.lit("orders"))
    pr = SP.render_spec(pr, "g", out="query_text")
    pr = SP.render_spec(pr, "p", out="question")
    pr = SP.table_context(pr)
    pr = SP.decompose_spec(pr, "g")
    pr = pr.withColumn("sel_type", F.element_at("types", F.col("sel") + 1))
    pr = pr.withColumn("legal", SP.legal_agg(pr, "sel_type", "agg"))
    pr = SP.spans_from_conditions(pr, "question", "g", "spans")
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s.st.cast("string"), s.ed.cast("string"))), ",")
    return pr.select("qid", "query_text", "legal", "context", "wn", F.array_join("wc", ",").alias("wc"),
                     spans.alias("spans"), "unmappable")


_SQL_PAIRS = """
o AS (SELECT o_orderkey, o_custkey, o_orderkey % 4 AS ng, (o_orderkey + o_custkey % 2) % 4 AS np FROM orders),
pr AS (
  SELECT o_orderkey AS qid,
         CAST(o_orderkey % 5 AS INTEGER) AS g_sel, CAST(o_custkey % 6 AS INTEGER) AS g_agg,
         list_transform(range(ng), lambda k: {'col': CAST((o_custkey + 2 * k) % 5 AS INTEGER),
                        'op': CAST((o_orderkey + k) % 3 AS INTEGER), 'val': 'v' || CAST((o_custkey * (k + 1)) % 97 AS VARCHAR)})
           AS g_conds,
         CAST(CASE WHEN o_custkey % 3 = 0 THEN (o_orderkey + 1) % 5 ELSE o_orderkey % 5 END AS INTEGER) AS p_sel,
         CAST(CASE WHEN o_orderkey % 7 = 0 THEN (o_custkey + 1) % 6 ELSE o_custkey % 6 END AS INTEGER) AS p_agg,
         list_transform(list_sort(list_transform(
           list_transform(range(np), lambda k: {'col': CAST((o_custkey + 2 * k) % 5 AS INTEGER),
                          'op': CAST((o_orderkey + k) % 3 AS INTEGER),
                          'val': CASE WHEN o_custkey % 5 = 0 THEN upper('v' || CAST((o_custkey * (k + 1)) % 97 AS VARCHAR))
                                      ELSE 'v' || CAST((o_custkey * (k + 1)) % 97 AS VARCHAR) END}),
           lambda c, i: {'col': c.col, 'i': i, 'c': c})), lambda x: x.c) AS p_conds
  FROM o),
gs AS (SELECT *, list_transform(list_sort(list_transform(g_conds, lambda c, i: {'col': c.col, 'i': i, 'c': c})),
                                lambda x: x.c) AS g_sorted FROM pr),
fl AS (
  SELECT qid,
         CAST(g_sel = p_sel AS INTEGER) AS sc, CAST(g_agg = p_agg AS INTEGER) AS sa,
         CAST(len(g_conds) = len(p_conds) AS INTEGER) AS wn,
         CAST(len(g_conds) = len(p_conds) AND list_sort(list_transform(g_conds, lambda c: c.col))
              = list_transform(p_conds, lambda c: c.col) AS INTEGER) AS wc,
         CAST(len(g_conds) = len(p_conds) AND list_transform(g_sorted, lambda c: c.op)
              = list_transform(p_conds, lambda c: c.op) AS INTEGER) AS wo,
         CAST(len(g_conds) = len(p_conds) AND list_transform(g_sorted, lambda c: lower(c.val))
              = list_transform(p_conds, lambda c: lower(c.val)) AS INTEGER) AS wv
  FROM gs),
fx AS (SELECT *, sc * sa * wn * wc * wo * wv AS lx FROM fl)"""

SQL_COMPONENT_SCORES = "WITH " + _SQL_PAIRS + "\nSELECT qid, sc, sa, wn, wc, wo, wv, lx FROM fx"

_KS = ["sc", "sa", "wn", "wc", "wo", "wv", "lx"]
SQL_COMPONENT_TOTALS = ("WITH " + _SQL_PAIRS + "\nSELECT count(*) AS n, "
                        + ", ".join(f"CAST(sum({k}) AS BIGINT) AS cnt_{k}" for k in _KS) + ", "
                        + ", ".join(f"round(avg({k}), 6) AS acc_{k}" for k in _KS) + " FROM fx")

_H = "['o_orderkey', 'o_custkey', 'o_orderstatus', 'o_totalprice', 'o_orderpriority']"
_T = "['real', 'real', 'text', 'real', 'text']"
_AGG = "['', 'max', 'min', 'count', 'sum', 'avg']"
_OPS = "['=', '>', '<', 'OP']"


def _render_sql(sel: str, agg: str, conds: str) -> str:
    return (f"'SELECT ' || {_AGG}[{agg} + 1] || '(' || {_H}[{sel} + 1] || ') FROM orders' || "
            f"CASE WHEN len({conds}) > 0 THEN ' WHERE ' || array_to_string(list_transform({conds}, lambda c: "
            f"{_H}[c.col + 1] || ' ' || {_OPS}[c.op + 1] || ' ' || c.val), ' AND ') ELSE '' END")


SQL_RENDERED_SPECS = "WITH " + _SQL_PAIRS + f""",
r AS (SELECT qid, g_sel, g_agg, g_conds, {_render_sql('g_sel', 'g_agg', 'g_conds')} AS query_text,
             lower({_render_sql('p_sel', 'p_agg', 'p_conds')}) AS q FROM pr),
s AS (SELECT *, list_transform(g_conds, lambda c: strpos(q, lower(c.val)) - 1) AS st FROM r)
SELECT qid, query_text,
       CASE WHEN {_T}[g_sel + 1] = 'text' THEN g_agg IN (0, 3) ELSE TRUE END AS legal,
       array_to_string({_H}, ' ') AS context,
       CAST(len(g_conds) AS INTEGER) AS wn,
       array_to_string(list_transform(g_conds, lambda c: CAST(c.col AS VARCHAR)), ',') AS wc,
       CASE WHEN list_bool_and(list_transform(st, lambda x: x >= 0)) OR len(st) = 0 THEN
         array_to_string(list_transform(list_zip(st, g_conds), lambda z: CAST(z[1] AS VARCHAR) || ':' ||
                         CAST(z[1] + length(z[2].val) AS VARCHAR)), ',') END AS spans,
       NOT (list_bool_and(list_transform(st, lambda x: x >= 0)) OR len(st) = 0) AS unmappable
FROM s
"""


def pointer_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """T13 + T14 + A9: gold spec (value span k..k+1 for condition k) -> pointer
    sequence -> spec again; the sequence as text and whether the round trip
    and the pointer sequences of gold and prediction agree."""
    from taskprep.functions.arrays import sequence_match
    from taskprep.operators import tokens as TK
    pr = pairs(spark, sf)

    def spanned(spec):
        s = F.col(spec)
        return F.struct(s.sel.alias("sel"), s.agg.alias("agg"), F.transform(s.conds, lambda c, i: F.struct(
            c.col.alias("col"), c.op.alias("op"), i.alias("st"), (i + 1).alias("ed"))).alias("conds"))

    pr = pr.select("qid", spanned("g").alias("gs"), spanned("p").alias("ps"))
    pr = pr.withColumn("gp", TK.spec_to_pointers("gs")).withColumn("pp", TK.spec_to_pointers("ps"))
    back = TK.pointers_to_spec("gp")
    text = F.array_join(F.transform("gp", lambda t: F.concat_ws(":", t.kind, t.value.cast("string"))), ",")
    part = lambda c: F.concat_ws(":", *(c[k].cast("string") for k in ("col", "op", "st", "ed")))
    return pr.withColumn("back", back).select(
        "qid", text.alias("pointers"), F.col("back.sel").alias("sel"), F.col("back.agg").alias("agg"),
        F.array_join(F.transform("back.conds", part), ",").alias("conds"), F.col("back.malformed").alias("malformed"),
        sequence_match("gp", "pp").alias("seq_match"))


def _pointer_sql(sel: str, agg: str, conds: str) -> str:
    return (f"['start:0', 'select:0', 'agg:' || {agg}, 'col:' || {sel}] || flatten(list_transform({conds}, "
            f"lambda c, i: [CASE WHEN i = 1 THEN 'where:0' ELSE 'and:0' END, 'col:' || c.col, 'op:' || c.op, "
            f"'vst:' || (i - 1), 'ved:' || i])) || ['end:0']")


SQL_POINTER_ROUNDTRIP = "WITH " + _SQL_PAIRS + f""",
pt AS (SELECT qid, {_pointer_sql('g_sel', 'g_agg', 'g_conds')} AS gp, {_pointer_sql('p_sel', 'p_agg', 'p_conds')} AS pp
       FROM pr)
SELECT pt.qid, array_to_string(gp, ',') AS pointers, pr.g_sel AS sel, pr.g_agg AS agg,
       array_to_string(list_transform(pr.g_conds, lambda c, i: c.col || ':' || c.op || ':' || (i - 1) || ':' || i), ',') AS conds,
       FALSE AS malformed, CAST(gp = pp AS INTEGER) AS seq_match
FROM pt JOIN pr ON pr.qid = pt.qid
"""

SQL_VALUE_SPAN_SCORES = "WITH " + _SQL_PAIRS + """,
sp AS (SELECT qid, len(g_conds) = len(p_conds) AS same,
              list_transform(g_sorted, lambda c: [c.col * 7, c.col * 7 + length(c.val)]) AS gold,
              list_transform(p_conds, lambda c: [c.col * 7 + CAST(qid % 11 = 0 AS INTEGER), c.col * 7 + length(c.val) + CAST(qid % 11 = 0 AS INTEGER)]) AS pred
       FROM gs)
SELECT qid, CAST(same AND gold = pred AS INTEGER) AS wvi FROM sp
"""

QUERIES = {"component_scores": component_scores, "component_totals": component_totals,
           "rendered_specs": rendered_specs, "pointer_roundtrip": pointer_roundtrip,
           "value_span_scores": value_span_scores}
ORACLE = {"component_scores": SQL_COMPONENT_SCORES, "component_totals": SQL_COMPONENT_TOTALS,
          "rendered_specs": SQL_RENDERED_SPECS, "pointer_roundtrip": SQL_POINTER_ROUNDTRIP,
          "value_span_scores": SQL_VALUE_SPAN_SCORES}
