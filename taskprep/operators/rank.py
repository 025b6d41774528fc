"""Candidate ranking for structured-query decoding.

All in-row array work or keyed windows; no driver loops."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from taskprep.functions import arrays as A
from taskprep.functions.arrays import let
from taskprep.operators import specs as SP
from taskprep.session import cut_lineage

JUNK_SCORE = -9999999
#: keys over which the rows of one candidate spec are dealt
SPEC_SALTS = 64


def best_legal_select(col_probs, agg_probs, col_types) -> F.Column:
    """Rank (column, aggregate) pairs by p(col) * p(agg) (ties: lower column,
    then lower aggregate); take the first pair whose aggregate is legal for the
    column type (text: none or COUNT), else the last pair of the ranking. Both
    are a minimum or maximum over the pairs; nothing is sorted."""
    c = lambda x: F.col(x) if isinstance(x, str) else x

    def pairs(r: F.Column) -> F.Column:
        return F.flatten(F.transform(r["pc"], lambda p, i: F.transform(r["pa"], lambda q, a: F.struct(
            (-(p * q)).alias("k"), i.alias("sel"), a.alias("agg"), (p * q).alias("prob"),
            F.when(F.get(r["types"], i) == "text", a.isin(0, 3)).otherwise(F.lit(True)).alias("legal")))))

    best = lambda x: F.coalesce(F.array_min(F.filter(x, lambda y: y["legal"])), F.array_max(x))
    return let(F.struct(c(col_probs).alias("pc"), c(agg_probs).alias("pa"), c(col_types).alias("types")), lambda r: let(pairs(r), best))


def spec_probability(df: DataFrame, sc: str, sa: str, wn: str, wc: str, wo: str, st: str, ed: str) -> DataFrame:
    """p_select, p_where and p_total of a chosen spec.

    ``sc``, ``sa``, ``wn`` are the probabilities of the chosen column,
    aggregate and condition count; ``wc``, ``wo``, ``st`` and ``ed`` arrays with
    the probability of each chosen condition's column, operator, value start
    and value end.
    """
    conds = F.arrays_zip(F.col(wc).alias("c"), F.col(wo).alias("o"), F.col(st).alias("s"), F.col(ed).alias("e"))
    where = F.aggregate(conds, F.col(wn).cast("double"), lambda p, x: p * x.c * x.o * x.s * x.e)
    return (df.withColumn("p_select", F.col(sc) * F.col(sa)).withColumn("p_where", where)
            .withColumn("p_total", F.col("p_select") * F.col("p_where")))


def prune_candidates(candidates: DataFrame, cells: DataFrame, meta: DataFrame, beam: int,
                     key: str = "qid", score: str = "score", pad: bool = True) -> DataFrame:
    """R10 + U6 + F6: per question, drop duplicate candidate specs (keeping the
    best score), keep those that are executable or cannot be tested yet, cut to
    ``beam`` by score; with ``pad`` short beams are filled with junk rows
    scored -9999999.

    candidates: key, spec_id, score, table_id, sel, agg, conds. An unfinished
    candidate, whose decoding has not yet named a column or an aggregate, has a
    null ``sel`` or ``agg``: it has no truth value and stays. Candidates of one beam, and
    of many, share their finished part: every distinct spec is tested once, all
    in one batch."""
    spec = F.to_json(F.struct("table_id", "sel", "agg", "conds"))
    w = Window.partitionBy(key, "__sig").orderBy(F.desc(score), "spec_id")
    dedup = candidates.withColumn("__sig", spec).withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")
    dedup = cut_lineage(dedup)
    testable = F.col("sel").isNotNull() & F.col("agg").isNotNull()
    # a spec that many questions share is one key; its rows meet it over several salts
    own = dedup.filter(testable).withColumn("__salt", F.pmod(F.xxhash64(key), F.lit(SPEC_SALTS)))
    salted = cut_lineage(own.groupBy("__sig", "__salt").agg(*(F.first(c).alias(c) for c in ("table_id", "sel", "agg", "conds"))))
    tested = cut_lineage(salted.groupBy(F.col("__sig").alias("spec_id")).agg(*(F.first(c).alias(c) for c in ("table_id", "sel", "agg", "conds"))))
    held = SP.keep_executable(tested, cells, meta).select(F.col("spec_id").alias("__sig"))
    held = salted.select("__sig", "__salt").join(held, "__sig", "left_semi")
    ok = own.join(held, ["__sig", "__salt"], "left_semi").drop("__salt").unionByName(dedup.filter(~testable)).drop("__sig")
    rw = Window.partitionBy(key).orderBy(F.desc(score), "spec_id")
    kept = ok.withColumn("beam_rank", F.row_number().over(rw)).filter(F.col("beam_rank") <= beam)
    kept = kept.select(key, "spec_id", F.col(score).cast("double").alias(score), "beam_rank")
    if not pad:
        return kept
    slots = candidates.select(key).distinct().withColumn(
        "beam_rank", F.explode(F.sequence(F.lit(1), F.lit(beam))))
    return slots.join(kept, [key, "beam_rank"], "left").select(
        key, "beam_rank", "spec_id", F.coalesce(F.col(score), F.lit(float(JUNK_SCORE))).alias(score))


def condition_candidates(df: DataFrame, p_col: str, p_op: str, starts: str, ends: str, tokens: str, beam: int, key: str = "qid") -> DataFrame:
    """H3 + R6 + R9: the ``beam`` most probable conditions of every row: key, cand_no, prob, cond (col, op, val).

    ``p_col`` has a probability a column, ``p_op`` one an operator for each
    column, ``starts`` and ``ends`` the scores of value starts and ends for each
    operator. The value spans of an operator are the ceil(sqrt(beam)) best
    starts with as many best ends; their tokens, joined by a space, are the
    value (none where the end comes first)."""
    spans = F.transform(F.arrays_zip(F.col(starts).alias("s"), F.col(ends).alias("e")), lambda x: A.pair_beam(x["s"], x["e"], beam))
    rows = df.withColumn("__spans", F.explode(F.array(spans)))
    values = F.transform("__spans", lambda pairs: F.transform(pairs, lambda p: p["prob"]))
    best = A.joint_topk(p_col, p_op, F.transform(F.col(p_op), lambda _: values), beam)
    rows = rows.select(key, tokens, "__spans", F.posexplode(best).alias("cand_no", "x"))
    at = F.get(F.get("__spans", F.col("x.b")), F.col("x.c"))
    val = F.array_join(F.slice(F.col(tokens), at["st"] + 1, F.greatest(at["ed"] - at["st"] + 1, F.lit(0))), " ")
    return rows.select(key, "cand_no", F.col("x.prob").alias("prob"), F.struct(F.col("x.a").alias("col"), F.col("x.b").alias("op"), val.alias("val")).alias("cond"))


def choose_conditions(candidates: DataFrame, p_n: DataFrame, cells: DataFrame, meta: DataFrame,
                      key: str = "qid") -> tuple[DataFrame, DataFrame]:
    """Choose the number of conditions and which ones.

    candidates: key, cand_no, prob, table_id, sel, agg, cond (struct col/op/val);
    p_n: key, p_n (array: probability of 0, 1, 2 ... conditions).
    Every candidate condition is executed alone (one batch); executable ones
    keep their probability order (prob desc, cand_no). The count is the
    argmax over the k that p_n has of p_n[k] * prob(k-th executable) with k = 0 scored p_n[0]
    (ties: fewer conditions). Returns (choice: key, wn, score;
    conditions: key, ex_rank, cand_no, cond)."""
    c = candidates.withColumn("spec_id", F.concat_ws(":", F.col(key).cast("string"), F.col("cand_no").cast("string")))
    specs = c.select("spec_id", "table_id", "sel", "agg", F.array("cond").alias("conds"))
    ex = c.join(SP.keep_executable(specs, cells, meta).select("spec_id"), "spec_id", "left_semi")
    w = Window.partitionBy(key).orderBy(F.desc("prob"), "cand_no")
    ex = ex.withColumn("ex_rank", F.row_number().over(w))
    scored = ex.join(p_n, key).select(key, F.col("ex_rank").alias("k"),
                                      (F.get("p_n", F.col("ex_rank")) * F.col("prob")).alias("score"))
    zero = p_n.select(key, F.lit(0).alias("k"), F.get("p_n", F.lit(0)).alias("score"))
    allk = zero.unionByName(scored).filter(F.col("score").isNotNull())
    choice = allk.groupBy(key).agg(F.max_by(F.struct("k", "score"), F.struct(F.col("score"), -F.col("k"))).alias("b"))
    choice = choice.select(key, F.col("b.k").alias("wn"), F.col("b.score").alias("score"))
    conds = ex.join(choice, key).filter(F.col("ex_rank") <= F.col("wn")).select(key, "ex_rank", "cand_no", "cond")
    return choice, conds
