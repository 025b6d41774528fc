"""Registered candidate-ranking queries.

best_select: ``embeddings`` vectors give aggregate probabilities (softmax of
the first 6 values) and column probabilities (softmax of all others; the types
of the melted ``orders`` columns repeat).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taskprep.functions import arrays as A
from taskprep.operators import rank
from taskprep.plans.scores import _emb, _softmax_sql
from taskprep.plans.spec_eval import TYPES


def best_select(spark: SparkSession, sf: str) -> DataFrame:
    """R8 + F4 + H3: best legal (select column, aggregate) pair."""
    e = _emb(spark, sf)
    cols = F.slice("v", F.lit(7), F.size("v") - 6)
    types = F.transform(cols, lambda x, i: F.get(F.array(*[F.lit(t) for t in TYPES]), i % len(TYPES)))
    b = rank.best_legal_select(A.softmax(cols), A.softmax(F.slice("v", 1, 6)), types)
    return e.select("vec_id", b.sel.cast("int").alias("sel"), b.agg.cast("int").alias("agg"),
                    F.round(b.prob, 6).alias("prob"), b.legal.alias("legal"))


_T = "['" + "', '".join(TYPES) + "']"
SQL_BEST_SELECT = f"""
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
p AS (SELECT vec_id, {_softmax_sql('v[7:]')} AS pc, {_softmax_sql('v[1:6]')} AS pa FROM e),
r AS (SELECT vec_id, list_sort(flatten(list_transform(range(len(pc)), lambda c: list_transform(range(6), lambda a:
        [-(pc[c + 1] * pa[a + 1]), c, a, CASE WHEN {_T}[c % {len(TYPES)} + 1] = 'text' AND a NOT IN (0, 3) THEN 0 ELSE 1 END]))))
        AS ranked FROM p),
c AS (SELECT vec_id, coalesce(list_filter(ranked, lambda x: x[4] = 1)[1], ranked[len(ranked)]) AS b FROM r)
SELECT vec_id, CAST(b[2] AS INTEGER) AS sel, CAST(b[3] AS INTEGER) AS agg, round(-b[1], 6) AS prob,
       b[4] = 1 AS legal
FROM c
"""

def pruned_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """R10 + U6 + F6: per nation, 7 candidate specs over ``customer`` (one a
    duplicate, some with a value that matches nothing), deduplicated,
    executable ones kept, cut to a beam of 3, padded with junk."""
    from taskprep.plans.structured import catalog
    from taskprep.session import cut_lineage, read_table
    n = read_table(spark, sf, "nation").select("n_nationkey").withColumn(
        "k", F.explode(F.sequence(F.lit(0), F.lit(6))))
    kk = F.when(F.col("k") == 6, 0).otherwise(F.col("k"))
    val = (F.col("n_nationkey") + (kk % 2) * 100).cast("string")
    cands = n.select(
        F.col("n_nationkey").alias("qid"),
        F.concat(F.lit("k"), F.col("n_nationkey").cast("string"), F.lit("_"), F.col("k").cast("string")).alias("spec_id"),
        ((F.col("n_nationkey") * 7 + F.col("k") * 3) % 11).cast("double").alias("score"),
        F.lit("customer").alias("table_id"), F.lit(3).alias("sel"), kk.cast("int").alias("agg"),
        F.array(F.struct(F.lit(2).alias("col"), F.lit(0).alias("op"), val.alias("val"))).alias("conds"))
    cells, meta = catalog(spark, sf, ["customer"])
    return rank.prune_candidates(cut_lineage(cands), cells, meta, beam=3)


SQL_PRUNED_CANDIDATES = """
WITH c AS (SELECT n_nationkey AS qid, 'k' || n_nationkey || '_' || t.k AS spec_id,
                  CAST((n_nationkey * 7 + t.k * 3) % 11 AS DOUBLE) AS score,
                  CASE WHEN t.k = 6 THEN 0 ELSE t.k END AS agg,
                  n_nationkey + ((CASE WHEN t.k = 6 THEN 0 ELSE t.k END) % 2) * 100 AS val
           FROM nation, (SELECT range AS k FROM range(7)) t),
d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, agg, val ORDER BY score DESC, spec_id) AS r FROM c)
      WHERE r = 1),
x AS (SELECT d.* FROM d WHERE d.agg > 0 OR EXISTS (SELECT 1 FROM customer WHERE c_nationkey = d.val)),
k AS (SELECT qid, spec_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, spec_id) AS beam_rank FROM x),
s AS (SELECT q.qid, r.range AS beam_rank FROM (SELECT DISTINCT qid FROM c) q, range(1, 4) r)
SELECT s.qid, CAST(s.beam_rank AS INTEGER) AS beam_rank, k.spec_id, coalesce(k.score, -9999999.0) AS score
FROM s LEFT JOIN k ON k.qid = s.qid AND k.beam_rank = s.beam_rank
"""

BEAM = 4
#: values of a vector: a score a customer column, an operator of each, a count (0 to 4), and starts and ends an operator
N_COL, N_OP, N_COUNT, N_START, N_END = 5, 3, 5, 7, 6


def _question_tokens() -> F.Column:
    """Seven words a vector, some of which occur in ``customer``."""
    v = F.col("vec_id")
    return F.array((v % 25).cast("string"), F.lit("building"), ((v * 37) % 10000).cast("string"), F.lit("machinery"), (v % 150 + 1).cast("string"), F.lit("of"), F.lit("household"))


def _heads(spark: SparkSession, sf: str) -> DataFrame:
    at = iter(range(1, 65))

    def head(n: int) -> F.Column:
        first = [next(at) for _ in range(n)][0]
        return F.slice("v", first, n)

    cols, ops = A.softmax(head(N_COL)), F.array(*[A.softmax(head(N_OP)) for _ in range(N_COL)])
    counts = A.softmax(head(N_COUNT))
    ends = [(head(N_START), head(N_END)) for _ in range(N_OP)]
    return _emb(spark, sf).select(F.col("vec_id").alias("qid"), _question_tokens().alias("words"), cols.alias("p_col"), ops.alias("p_op"), counts.alias("p_n"),
                                  F.array(*[s for s, _ in ends]).alias("starts"), F.array(*[e for _, e in ends]).alias("ends"))


def candidate_conditions(spark: SparkSession, sf: str) -> DataFrame:
    """H3 + R6: per vector the 4 most probable conditions by p(column) p(operator) p(value span)."""
    c = rank.condition_candidates(_heads(spark, sf), "p_col", "p_op", "starts", "ends", "words", BEAM)
    return c.select("qid", F.col("cand_no").cast("int").alias("cand_no"), F.round("prob", 6).alias("prob"),
                    F.col("cond.col").alias("col"), F.col("cond.op").alias("op"), F.col("cond.val").alias("val"))


def chosen_conditions(spark: SparkSession, sf: str) -> DataFrame:
    """R9 (+ H3, F6): the candidate conditions of every vector over ``customer``,
    those that execute, and how many of them p_n (0 to 4) makes most probable."""
    from taskprep.plans.structured import catalog
    from taskprep.session import cut_lineage
    heads = cut_lineage(_heads(spark, sf))
    cands = rank.condition_candidates(heads, "p_col", "p_op", "starts", "ends", "words", BEAM)
    cands = cut_lineage(cands.select("*", F.lit("customer").alias("table_id"), F.lit(3).alias("sel"), F.lit(0).alias("agg")))
    cells, meta = catalog(spark, sf, ["customer"])
    choice, conds = rank.choose_conditions(cands, heads.select("qid", "p_n"), cells, meta)
    listed = conds.groupBy("qid").agg(F.array_join(F.transform(F.sort_array(F.collect_list(
        F.struct("ex_rank", "cand_no"))), lambda x: x.cand_no.cast("string")), ",").alias("conds"))
    return choice.join(listed, "qid", "left").select(
        "qid", F.col("wn").cast("int").alias("wn"), F.round("score", 6).alias("score"),
        F.coalesce("conds", F.lit("")).alias("conds"))


def _heads_sql() -> str:
    at, out = 1, []

    def head(n: int) -> str:
        nonlocal at
        at += n
        return f"v[{at - n}:{at - 1}]"

    out.append(f"{_softmax_sql(head(N_COL))} AS p_col")
    out.append("[" + ", ".join(_softmax_sql(head(N_OP)) for _ in range(N_COL)) + "] AS p_op")
    out.append(f"{_softmax_sql(head(N_COUNT))} AS p_n")
    pairs = [(head(N_START), head(N_END)) for _ in range(N_OP)]
    out.append("[" + ", ".join(_softmax_sql(s) for s, _ in pairs) + "] AS p_st")
    out.append("[" + ", ".join(_softmax_sql(e) for _, e in pairs) + "] AS p_ed")
    return ", ".join(out)


#: the whole product of all factors, ranked; value spans are the 2 best starts with the 2 best ends of an operator
_SQL_CANDIDATES = f"""
e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
h AS (SELECT vec_id AS qid, [CAST(vec_id % 25 AS VARCHAR), 'building', CAST((vec_id * 37) % 10000 AS VARCHAR), 'machinery', CAST(vec_id % 150 + 1 AS VARCHAR), 'of', 'household'] AS words,
             {_heads_sql()} FROM e),
sx AS (SELECT qid, o, i, p, row_number() OVER (PARTITION BY qid, o ORDER BY p DESC, i) AS r
       FROM (SELECT qid, o, unnest(range({N_START})) AS i, unnest(p_st[o + 1]) AS p FROM h, range({N_OP}) t(o))),
ex AS (SELECT qid, o, i, p, row_number() OVER (PARTITION BY qid, o ORDER BY p DESC, i) AS r
       FROM (SELECT qid, o, unnest(range({N_END})) AS i, unnest(p_ed[o + 1]) AS p FROM h, range({N_OP}) t(o))),
sp AS (SELECT s.qid, s.o, s.i AS st, x.i AS ed, s.p * x.p AS p, row_number() OVER (PARTITION BY s.qid, s.o ORDER BY s.p * x.p DESC, s.r, x.r) AS c
       FROM sx s JOIN ex x ON x.qid = s.qid AND x.o = s.o WHERE s.r <= 2 AND x.r <= 2),
full_product AS (SELECT h.qid, a, sp.o AS b, sp.c, sp.st, sp.ed, h.words, h.p_col[a + 1] * h.p_op[a + 1][sp.o + 1] * sp.p AS prob
                 FROM h, range({N_COL}) t(a), sp WHERE sp.qid = h.qid),
cand AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY prob DESC, a, b, c) - 1 AS cand_no FROM full_product) WHERE cand_no < {BEAM}),
val AS (SELECT qid, cand_no, prob, CAST(a AS INTEGER) AS col, CAST(b AS INTEGER) AS op, CASE WHEN ed < st THEN '' ELSE array_to_string(words[st + 1:ed + 1], ' ') END AS val FROM cand)"""

SQL_CANDIDATE_CONDITIONS = "WITH " + _SQL_CANDIDATES + """
SELECT qid, CAST(cand_no AS INTEGER) AS cand_no, round(prob, 6) AS prob, col, op, val FROM val
"""

#: columns of customer as (number, text); the value as a number where the column has numbers: the whole text, else its first number
SQL_CHOSEN_CONDITIONS = "WITH " + _SQL_CANDIDATES + r""",
typed AS (SELECT *, CASE WHEN col IN (0, 2, 3) THEN CAST(nullif(regexp_extract(val, '\d+'), '') AS DOUBLE) END AS num FROM val),
cc AS (SELECT 0 AS col, CAST(c_custkey AS DOUBLE) AS n, NULL AS t FROM customer UNION ALL SELECT 1, NULL, lower(c_name) FROM customer
       UNION ALL SELECT 2, CAST(c_nationkey AS DOUBLE), NULL FROM customer UNION ALL SELECT 3, CAST(c_acctbal AS DOUBLE), NULL FROM customer
       UNION ALL SELECT 4, NULL, lower(c_mktsegment) FROM customer),
hit AS (SELECT DISTINCT qid, cand_no FROM typed JOIN cc ON cc.col = typed.col
        AND CASE op WHEN 0 THEN CASE WHEN num IS NOT NULL THEN n = num ELSE t = val END
                    WHEN 1 THEN CASE WHEN num IS NOT NULL THEN n > num OR t IS NOT NULL ELSE t > val END
                    ELSE CASE WHEN num IS NOT NULL THEN n < num ELSE n IS NOT NULL OR t < val END END),
x AS (SELECT v.*, row_number() OVER (PARTITION BY qid ORDER BY prob DESC, cand_no) AS ex_rank FROM val v SEMI JOIN hit USING (qid, cand_no)),
s AS (SELECT qid, 0 AS k, p_n[1] AS score FROM h UNION ALL SELECT x.qid, ex_rank, h.p_n[ex_rank + 1] * prob FROM x JOIN h ON h.qid = x.qid),
ch AS (SELECT qid, arg_max(k, [score, -k]) AS wn, max(score) AS score FROM s GROUP BY qid),
cl AS (SELECT x.qid, string_agg(CAST(x.cand_no AS VARCHAR), ',' ORDER BY x.ex_rank) AS conds
       FROM x JOIN ch ON ch.qid = x.qid WHERE x.ex_rank <= ch.wn GROUP BY x.qid)
SELECT ch.qid, CAST(ch.wn AS INTEGER) AS wn, round(ch.score, 6) AS score, coalesce(cl.conds, '') AS conds
FROM ch LEFT JOIN cl ON cl.qid = ch.qid
"""


def pruned_prefixes(spark: SparkSession, sf: str) -> DataFrame:
    """Per customer a beam of 4 out of 8 unfinished and finished candidates
    over ``customer``: 0 has named nothing, 1 an aggregate, 2 a column, 3 a
    whole select; 4 and 5 go on with the customer's key, 5 with a balance over
    one it may have; 6 asks for a key that no customer has; 7 repeats 4."""
    from taskprep.plans.structured import catalog
    from taskprep.session import cut_lineage, read_table, spread
    c = spread(read_table(spark, sf, "customer").select("c_custkey")).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(7))))
    key, k = F.col("c_custkey"), F.col("k")
    cond = lambda col, op, val: F.struct(F.lit(col).alias("col"), F.lit(op).alias("op"), val.cast("string").alias("val"))
    own, poor = cond(0, 0, key), cond(3, 1, (key * 13) % 9000)
    conds = (F.when(k.isin(4, 7), F.array(own)).when(k == 5, F.array(own, poor)).when(k == 6, F.array(cond(0, 0, key + 10_000_000)))
             .otherwise(F.array().cast("array<struct<col:int,op:int,val:string>>")))
    cands = c.select(key.alias("qid"), F.concat_ws("_", key, k).alias("spec_id"), ((key * 7 + k * 5) % 23).cast("double").alias("score"), F.lit("customer").alias("table_id"),
                     F.when(~k.isin(0, 1), F.lit(3)).alias("sel"), F.when(~k.isin(0, 2), F.when(k == 3, 3).otherwise(0)).cast("int").alias("agg"), conds.alias("conds"))
    cells, meta = catalog(spark, sf, ["customer"])
    return rank.prune_candidates(cut_lineage(cands), cells, meta, beam=4)


SQL_PRUNED_PREFIXES = """
WITH c AS (SELECT c_custkey AS qid, k, c_custkey || '_' || k AS spec_id, CAST((c_custkey * 7 + k * 5) % 23 AS DOUBLE) AS score, c_acctbal > (c_custkey * 13) % 9000 AS rich
           FROM customer, range(8) t(k)),
d AS (SELECT *, row_number() OVER (PARTITION BY qid, CASE WHEN k = 7 THEN 4 ELSE k END ORDER BY score DESC, spec_id) AS r FROM c),
x AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, spec_id) AS beam_rank FROM d WHERE r = 1 AND k <> 6 AND (k <> 5 OR rich)),
s AS (SELECT c_custkey AS qid, r AS beam_rank FROM customer, range(1, 5) t(r))
SELECT s.qid, CAST(s.beam_rank AS INTEGER) AS beam_rank, x.spec_id, coalesce(x.score, -9999999.0) AS score
FROM s LEFT JOIN x ON x.qid = s.qid AND x.beam_rank = s.beam_rank
"""

QUERIES = {"best_select": best_select, "pruned_candidates": pruned_candidates, "pruned_prefixes": pruned_prefixes,
           "candidate_conditions": candidate_conditions, "chosen_conditions": chosen_conditions}
ORACLE = {"best_select": SQL_BEST_SELECT, "pruned_candidates": SQL_PRUNED_CANDIDATES, "pruned_prefixes": SQL_PRUNED_PREFIXES,
          "candidate_conditions": SQL_CANDIDATE_CONDITIONS, "chosen_conditions": SQL_CHOSEN_CONDITIONS}
