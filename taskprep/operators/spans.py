"""n-best answer spans from per-window start/end scores (R1, R2, F5, J2, J8,
J9, A20, W2, W3).

features: ``feature_id, example_id, start_logits array, end_logits array,
offsets array<struct<st:int, ed:int>>`` (null outside the context), plus an
optional ``window_no`` giving the window order inside the example (defaults
to ``feature_id``) and an optional ``max_context`` (``mark_max_context``).
examples: ``example_id, context``.

Per-window top-k is an in-row array sort (no shuffle); start x end pairs are
bounded by k*k per window; the per-example cut is ``row_number() <= n``, which
Spark plans with a partial WindowGroupLimit before the exchange, so an
example with very many windows is cut map-side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from taskprep.session import cut_lineage

# Fixed values of the original post-processing.
N_BEST = 20
MAX_ANSWER_TOKENS = 30
PLACEHOLDER = "empty"


def top_indices(arr, k: int) -> F.Column:
    """Indices of the k largest values, largest first; ties: higher index first."""
    a = F.col(arr) if isinstance(arr, str) else arr
    ordered = F.array_sort(F.transform(a, lambda x, i: F.struct((-x).alias("k1"), (-i).alias("k2"), i.alias("i"))))
    return F.transform(F.slice(ordered, 1, k), lambda s: s.i)


def _window_candidates(features: DataFrame, n: int, max_len: int) -> DataFrame:
    f = features
    if "window_no" not in f.columns:
        f = f.withColumn("window_no", F.col("feature_id"))
    starts = top_indices("start_logits", n)
    ends = top_indices("end_logits", n)
    offs = F.col("offsets")
    n_off = F.size(offs)

    flagged = "max_context" in f.columns

    def legal(s, e):
        fits = ((s < n_off) & (e < n_off) & F.element_at(offs, s + 1).isNotNull()
                & F.element_at(offs, e + 1).isNotNull() & (e >= s) & (e - s + 1 <= max_len))
        return fits & F.coalesce(F.get("max_context", s), F.lit(False)) if flagged else fits

    pairs = F.flatten(F.transform(
        starts, lambda s, si: F.transform(
            F.filter(F.transform(ends, lambda e, ei: F.struct(e.alias("e"), ei.alias("ei"))), lambda x: legal(s, x.e)),
            lambda x: F.struct(s.alias("s"), si.alias("si"), x.e.alias("e"), x.ei.alias("ei")))))
    # with the flag, a start also needs the most context (see mark_max_context)
    c = f.select("example_id", "window_no", "start_logits", "end_logits", "offsets", F.explode(pairs).alias("p"))
    sl = F.element_at(F.col("start_logits"), F.col("p.s") + 1).cast("double")
    el = F.element_at(F.col("end_logits"), F.col("p.e") + 1).cast("double")
    return c.select(
        "example_id", "window_no", F.col("p.si").alias("start_rank"), F.col("p.ei").alias("end_rank"),
        F.element_at(offs, F.col("p.s") + 1).st.alias("st"), F.element_at(offs, F.col("p.e") + 1).ed.alias("ed"),
        (sl + el).alias("score"), sl.alias("start_logit"), el.alias("end_logit"), F.lit(False).alias("is_null"))


def mark_max_context(windows: DataFrame, first_token: str = "ctx_start", n_tokens: str = "ctx_len", first_position: str | int = 0,
                     n_positions: str | None = None, example: str = "example_id", window: str = "window_no") -> DataFrame:
    """``max_context``, for each position of a window whether its token has
    more context there than in any other window of the example.

    A window holds the tokens ``first_token`` ... of its example, the first at
    ``first_position``. A token's context in it is the smaller of the tokens to
    its left and right, plus a hundredth of the window's length; of equal ones the
    first window counts. A token is in a few windows only, so the rows grow with
    the tokens; positions that hold no token are false.
    """
    start, size = F.col(first_token), F.col(n_tokens)
    rows = windows.filter(size > 0).select(F.col(example).alias("__e"), F.col(window).alias("__w"), start.alias("__s"), size.alias("__n"), F.explode(F.sequence(start, start + size - 1)).alias("__t"))
    context = F.least(F.col("__t") - F.col("__s"), F.col("__s") + F.col("__n") - 1 - F.col("__t")) + 0.01 * F.col("__n")
    best = rows.groupBy("__e", "__t").agg(F.min_by(F.struct("__w", "__s"), F.struct((-context).alias("c"), F.col("__w").alias("w"))).alias("b"))
    held = best.groupBy("__e", F.col("b.__w").alias("__w")).agg(F.collect_list(F.col("__t") - F.col("b.__s")).alias("__at"))
    at = F.lit(first_position) if isinstance(first_position, int) else F.col(first_position)
    total = F.col(n_positions) if n_positions else at + size
    flags = F.map_from_entries(F.transform("__at", lambda i: F.struct(i.alias("k"), F.lit(True).alias("v"))))
    joined = windows.join(held, (F.col(example) == F.col("__e")) & (F.col(window) == F.col("__w")), "left")
    joined = joined.withColumn("__m", F.explode(F.array(F.when(F.col("__at").isNotNull(), flags))))
    flag = F.transform(F.sequence(F.lit(0), total - 1), lambda p: F.coalesce(F.try_element_at("__m", (p - at).cast("int")), F.lit(False)))
    return joined.withColumn("max_context", F.when(total > 0, flag).otherwise(F.array().cast("array<boolean>"))).drop("__e", "__w", "__at", "__m")


def min_null_scores(features: DataFrame) -> DataFrame:
    """Per example the window with the smallest start[0] + end[0] (first window on ties)."""
    f = features if "window_no" in features.columns else features.withColumn("window_no", F.col("feature_id"))
    s0 = F.element_at("start_logits", 1).cast("double")
    e0 = F.element_at("end_logits", 1).cast("double")
    rec = F.struct((s0 + e0).alias("score"), s0.alias("start_logit"), e0.alias("end_logit"))
    return f.groupBy("example_id").agg(F.min_by(rec, F.struct(s0 + e0, F.col("window_no"))).alias("n")).select(
        "example_id", F.col("n.score").alias("null_score"), F.col("n.start_logit").alias("null_start_logit"),
        F.col("n.end_logit").alias("null_end_logit"))


def nbest_spans(examples: DataFrame, features: DataFrame, n: int = N_BEST, max_len: int = MAX_ANSWER_TOKENS,
                allow_null: bool = False, threshold: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """R1. Returns (nbest, best):

    nbest: example_id, rank, text, start_logit, end_logit, score, probability
    best:  example_id, prediction_text[, score_diff]
    """
    cand = _window_candidates(features, n, max_len)
    nulls = cut_lineage(min_null_scores(features)) if allow_null else None
    order = [F.desc("score"), F.asc("is_null"), F.asc("window_no"), F.asc("start_rank"), F.asc("end_rank")]
    if allow_null:
        null_c = nulls.select("example_id", F.lit(-1).alias("window_no"), F.lit(0).alias("start_rank"),
                              F.lit(0).alias("end_rank"), F.lit(0).alias("st"), F.lit(0).alias("ed"),
                              F.col("null_score").alias("score"), F.col("null_start_logit").alias("start_logit"),
                              F.col("null_end_logit").alias("end_logit"), F.lit(True).alias("is_null"))
        # insertion order puts the null candidate after every window's candidates
        null_c = null_c.withColumn("window_no", F.lit(1 << 62))
        cand = cand.unionByName(null_c)
        order = [F.desc("score"), F.asc("window_no"), F.asc("start_rank"), F.asc("end_rank")]
    w = Window.partitionBy("example_id").orderBy(*order)
    # at most n rows an example from here on: written once, read by what follows
    kept = cut_lineage(cand.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n))
    if allow_null:
        # re-add the null candidate when it was cut
        zero = (F.col("st") == 0) & (F.col("ed") == 0)
        has_zero = kept.groupBy("example_id").agg(F.max(zero.cast("int")).alias("hz"))
        missing = null_c.join(has_zero.filter("hz = 0"), "example_id", "left_semi").withColumn("rank", F.lit(n + 1))
        kept = kept.unionByName(missing)
    ctx = examples.select("example_id", "context")
    texts = cut_lineage(kept.join(ctx, "example_id").withColumn(
        "text", F.expr("substring(context, st + 1, ed - st)")).drop("context"))
    # placeholder when nothing is left, or only one empty text
    stats = texts.groupBy("example_id").agg(F.count(F.lit(1)).alias("k"), F.max(F.col("text") != "").alias("any_text"))
    need = examples.select("example_id").join(stats, "example_id", "left").filter(
        F.col("k").isNull() | ((F.col("k") == 1) & ~F.col("any_text")))
    ph = need.select("example_id", F.lit(0).alias("rank"), F.lit(PLACEHOLDER).alias("text"),
                     F.lit(0.0).alias("start_logit"), F.lit(0.0).alias("end_logit"), F.lit(0.0).alias("score"))
    cols = ["example_id", "rank", "text", "start_logit", "end_logit", "score"]
    nb = texts.select(*cols).unionByName(ph)
    ew = Window.partitionBy("example_id")
    nb = nb.withColumn("probability", F.exp(F.col("score") - F.max("score").over(ew)))
    nb = nb.withColumn("probability", F.col("probability") / F.sum("probability").over(ew))
    nb = nb.withColumn("rank", F.row_number().over(ew.orderBy("rank")) - 1)
    if not allow_null:
        best = nb.filter(F.col("rank") == 0).select("example_id", F.col("text").alias("prediction_text"))
        return nb, best
    non_empty = nb.filter(F.col("text") != "").groupBy("example_id").agg(
        F.min_by(F.struct("text", "start_logit", "end_logit"), "rank").alias("b"))
    best = nb.select("example_id").distinct().join(non_empty, "example_id", "left").join(nulls, "example_id", "left")
    diff = F.col("null_score") - F.col("b.start_logit") - F.col("b.end_logit")
    best = best.select("example_id", F.when(F.col("b").isNull() | (diff > threshold), F.lit(""))
                       .otherwise(F.col("b.text")).alias("prediction_text"), diff.alias("score_diff"))
    return nb, best


def nbest_spans_ranked(examples: DataFrame, features: DataFrame, start_n: int = 5, end_n: int = 5,
                       n: int = N_BEST, max_len: int = MAX_ANSWER_TOKENS) -> tuple[DataFrame, DataFrame]:
    """R2: candidates from pre-ranked starts and per-start ends.

    features carry ``start_log_prob``/``start_index`` (start_n) and
    ``end_log_prob``/``end_index`` (start_n * end_n, end j of start i at
    i * end_n + j) and ``cls_logit``. Empty result -> ``""`` with score -2e-6.
    Returns (nbest, best) where best carries the null score (min cls_logit).
    """
    f = features if "window_no" in features.columns else features.withColumn("window_no", F.col("feature_id"))
    offs = F.col("offsets")
    n_off = F.size(offs)
    idx = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(start_n - 1)), lambda i: F.transform(
        F.sequence(F.lit(0), F.lit(end_n - 1)), lambda j: F.struct(i.alias("i"), j.alias("j")))))
    c = f.select("example_id", "window_no", "offsets", "start_log_prob", "start_index", "end_log_prob", "end_index",
                 F.explode(idx).alias("p"))
    s = F.element_at("start_index", F.col("p.i") + 1)
    k = F.col("p.i") * end_n + F.col("p.j") + 1
    e = F.element_at("end_index", k)
    sl = F.element_at("start_log_prob", F.col("p.i") + 1).cast("double")
    el = F.element_at("end_log_prob", k).cast("double")
    legal = ((s < n_off) & (e < n_off) & F.element_at(offs, s + 1).isNotNull() & F.element_at(offs, e + 1).isNotNull()
             & (e >= s) & (e - s + 1 <= max_len))
    c = c.filter(legal).select("example_id", "window_no", F.col("p.i").alias("si"), F.col("p.j").alias("ej"),
                               F.element_at(offs, s + 1).st.alias("st"), F.element_at(offs, e + 1).ed.alias("ed"),
                               (sl + el).alias("score"), sl.alias("start_log_prob"), el.alias("end_log_prob"))
    w = Window.partitionBy("example_id").orderBy(F.desc("score"), "window_no", "si", "ej")
    kept = c.withColumn("rank", F.row_number().over(w) - 1).filter(F.col("rank") < n)
    texts = kept.join(examples.select("example_id", "context"), "example_id").withColumn(
        "text", F.expr("substring(context, st + 1, ed - st)"))
    cols = ["example_id", "rank", "text", "start_log_prob", "end_log_prob", "score"]
    empty = examples.select("example_id").join(texts.select("example_id"), "example_id", "left_anti").select(
        "example_id", F.lit(0).alias("rank"), F.lit("").alias("text"), F.lit(-1e-6).alias("start_log_prob"),
        F.lit(-1e-6).alias("end_log_prob"), F.lit(-2e-6).alias("score"))
    nb = texts.select(*cols).unionByName(empty)
    ew = Window.partitionBy("example_id")
    nb = nb.withColumn("probability", F.exp(F.col("score") - F.max("score").over(ew)))
    nb = nb.withColumn("probability", F.col("probability") / F.sum("probability").over(ew))
    null = f.groupBy("example_id").agg(F.min(F.col("cls_logit").cast("double")).alias("null_score"))
    best = nb.filter(F.col("rank") == 0).select("example_id", F.col("text").alias("prediction_text")).join(
        null, "example_id", "left")
    return nb, best
