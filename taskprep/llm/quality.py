"""Quality rules by weak supervision: rules vote or abstain, EM weighs them, the posterior decides.

Every rule looks at counts of one document and votes good (1), bad (0) or
abstains (-1). Documents are counted by vote pattern (at most 3 ** rules rows,
whatever the input), and expectation-maximisation over those counts estimates
the share of good documents and each rule's accuracy in either class, rules
being taken as independent given the class. A document's posterior probability of being good
replaces the all-must-pass filter. Built-in functions only, all texts whole.

Defined cases: a null or empty text has no words and fails the base rule; a
null or repeated ``doc_id`` is judged like any other row; an empty table gives
no rows; a text without lines, letters or windows makes the rules on them
abstain; the operator's own columns sit in one struct, so columns of the input
cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taskprep.session import cut_lineage, read_table

WINDOW = 8
MIN_WORDS, MAX_REPEAT_PCT = 20, 30
SYMBOLS = "#*$%&|<>"
ITERATIONS = 40
#: start values of the fit (share of good documents; rate of bad votes by class), and their weight in documents
PRIOR, DOWN, BELIEF = 0.85, {"good": 0.02, "bad": 0.4}, 20.0


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def repeat_words(words: Column) -> Column:
    """Words inside a window of 8 that is found twice or more in the text, the first one included.

    A text whose window hashes are all distinct costs one hash set; else the
    windows are sorted by hash, those equal to a neighbour keep their position,
    and the union of the windows is summed over the sorted positions.
    """
    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(h) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(h, i, WINDOW)))

    def covered(pos: Column) -> Column:
        step = F.zip_with(pos, F.slice(pos, F.lit(2), F.greatest(F.size(pos) - 1, F.lit(0))),
                          lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))))
        return F.aggregate(step, F.lit(0).cast("long"), lambda s, x: s + x)

    def repeated(win: Column) -> Column:
        tagged = F.array_sort(F.transform(win, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twins = lambda s: F.filter(s, lambda x, j: (x["h"] == F.get(s, j - 1)["h"]) | (x["h"] == F.get(s, j + 1)["h"]))
        return let(tagged, lambda s: let(F.array_sort(F.transform(twins(s), lambda x: x["i"])), covered))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    one = lambda win: F.when(F.size(F.array_distinct(win)) == F.size(win), F.lit(0).cast("long")).otherwise(repeated(win))
    return F.when(F.size(words) <= WINDOW, F.lit(0).cast("long")).otherwise(let(hashes, lambda h: let(windows(h), one)))


def text_counts(text: Column) -> Column:
    """Struct of the counts the rules look at."""
    t = F.coalesce(text, F.lit(""))
    bare = F.translate(t, " \t\n\x0b\f\r", "")
    lines = F.filter(F.split(t, "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]"))
    words = F.filter(F.split(t, r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def counts(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(bare).cast("long").alias("word_chars"),
            (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            let(lines, lambda s: F.struct(F.size(s).cast("long").alias("n_lines"),
                                          (F.size(s) - F.size(F.array_distinct(s))).cast("long").alias("n_dup"))).alias("lines"),
            repeat_words(w).alias("n_repeat_words"),
            F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
            F.regexp_count(t, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
            F.regexp_count(t, F.lit(r"\p{L}")).cast("long").alias("n_letters"),
            (F.length(t) - F.length(F.translate(t, "!?", ""))).cast("long").alias("n_marks"))

    return let(words, counts)


def rule_votes(c: Column) -> Column:
    """One vote a rule: (value is good, value is bad) bounds on ratios of the counts."""
    def vote(value: Column, good: Callable[[Column], Column], bad: Callable[[Column], Column]) -> Column:
        return F.when(good(value), F.lit(1)).when(bad(value), F.lit(0)).otherwise(F.lit(-1))

    def low(top: Column, by: Column, good: float, bad: float) -> Column:
        return vote(F.try_divide(top, by), lambda x: x <= good, lambda x: x >= bad)

    n = c["n_words"]
    return F.array(
        vote(n, lambda x: x >= 50, lambda x: x < MIN_WORDS),
        vote(F.try_divide(c["word_chars"], n), lambda x: x.between(3, 10), lambda x: (x < 2) | (x > 14)),
        low(c["n_symbols"], n, 0.02, 0.1),
        low(c["lines"]["n_dup"], F.when(c["lines"]["n_lines"] >= 5, c["lines"]["n_lines"]), 0.1, 0.4),
        low(c["n_repeat_words"], n, 0.1, 0.25),
        low(c["n_upper"], c["n_letters"], 0.2, 0.5),
        low(c["n_marks"], n, 0.05, 0.3),
        vote(F.when(n >= 100, F.try_divide(c["n_letters"], c["word_chars"])), lambda x: x >= 0.92, lambda x: x < 0.88),
        vote(F.try_divide(c["n_distinct"], n), lambda x: (n >= 50) & (x >= 0.3), lambda x: (n >= 50) & (x < 0.15)))


def likelihood(votes: str, down: str) -> str:
    """SQL: probability of the cast votes in a class whose rules vote bad at these rates; an abstention says nothing."""
    one = "CASE v WHEN 1 THEN 1 - d WHEN 0 THEN d ELSE 1D END"
    return f"aggregate(zip_with({votes}, {down}, (v, d) -> {one}), 1D, (p, x) -> p * x)"


def posterior(votes: str, fit: str) -> str:
    """SQL: probability that a document with these votes is good."""
    good, bad = likelihood(votes, f"{fit}.good"), likelihood(votes, f"{fit}.bad")
    return f"({fit}.prior * {good} / ({fit}.prior * {good} + (1 - {fit}.prior) * {bad}))"


def fit_rules(votes: DataFrame) -> DataFrame:
    """One row ``fit`` (prior, good, bad): EM over the counts of vote patterns, as one fold over the iterations.

    ``good`` and ``bad`` hold, for each rule, how often it votes bad when it
    votes on a good or a bad document: one minus its accuracy on the first, its
    accuracy on the second. A rule is never taken for worse than chance: the
    bad class votes bad at least as often. Null for an empty table.
    """
    patterns = votes.groupBy("votes").agg(F.count(F.lit(1)).cast("double").alias("n"))
    table = patterns.agg(F.array_sort(F.collect_list(F.struct("votes", "n"))).alias("pats"))  # <= 3 ** rules entries
    start = {k: f"array_repeat({down}D, coalesce(size(pats[0].votes), 0))" for k, down in DOWN.items()}
    scored = f"transform(pats, p -> struct(p.votes AS votes, p.n AS n, p.n * {posterior('p.votes', 's')} AS g))"

    def total(x: str) -> str:
        return f"aggregate(transform(sc, p -> {x}), 0D, (q, f) -> q + f)"

    def rate(cls: str, of: str) -> str:
        cast, down = (total(f"IF(p.votes[j] {cond}, {of}, 0D)") for cond in (">= 0", "= 0"))
        return f"transform(sequence(0, size(s.{cls}) - 1), j -> ({down} + {DOWN[cls] * BELIEF}D) / ({cast} + {BELIEF}D))"

    prior = f"(({total('p.g')} + {PRIOR * BELIEF}D) / ({total('p.n')} + {BELIEF}D))"
    step = (f"transform(transform(array({scored}), sc -> struct({prior} AS prior, {rate('good', 'p.g')} AS good, {rate('bad', '(p.n - p.g)')} AS bad)), "
            "n -> struct(n.prior AS prior, n.good AS good, zip_with(n.bad, n.good, (x, y) -> greatest(x, y)) AS bad))[0]")
    fit = f"aggregate(sequence(1, {ITERATIONS}), struct({PRIOR}D AS prior, {start['good']} AS good, {start['bad']} AS bad), (s, it) -> {step})"
    return table.select(F.expr(f"CASE WHEN size(pats) > 0 THEN {fit} END").alias("fit"))


def judge_quality(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """``docs`` plus a last column, a struct: counts, votes, base_failed, p_good, kept.

    It is called ``quality``, or ``quality_1`` and so on where the input has
    that name; take it as ``columns[-1]``. The counts are written once beside
    the rows, so texts are read once and every row keeps its own verdict
    whatever its id.
    """
    taken = {c.lower() for c in docs.columns}
    name = next(n for i in range(len(taken) + 1) if (n := f"quality_{i}" if i else "quality") not in taken)
    counted = docs.withColumn(name, text_counts(F.col(text)))
    counted = cut_lineage(counted.withColumn(name, F.col(name).withField("votes", rule_votes(F.col(name)))))
    fit = fit_rules(counted.select(F.col(f"{name}.votes").alias("votes"))).scalar()
    q = F.col(name)
    failed = (q["n_words"] < MIN_WORDS) | (100 * q["n_repeat_words"] > MAX_REPEAT_PCT * q["n_words"])
    held = counted.withColumn(name, q.withField("fit", fit).withField("base_failed", failed))
    held = held.withColumn(name, q.withField("p_good", F.expr(posterior(f"{name}.votes", f"{name}.fit"))))
    return held.withColumn(name, q.withField("kept", ~q["base_failed"] & (q["p_good"] >= 0.5)).dropFields("fit"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("quality")
    return judge_quality(read_table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", q["n_words"].alias("n_words"), q["word_chars"].alias("word_chars"), q["n_symbols"].alias("n_symbols"),
        q["lines"]["n_dup"].alias("n_dup_lines"), q["n_repeat_words"].alias("n_repeat_words"),
        q["base_failed"].alias("base_failed"), q["kept"].alias("kept"), q["p_good"].alias("p_good"))
