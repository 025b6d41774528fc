"""Array column functions over per-row score vectors (R3-R7, R11, H1-H3, A24,
T2, T3, T11, J12). All are higher-order built-ins evaluated in-row."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value, body) -> Column:
    """``body(value)`` with ``value`` computed once a row, however often ``body`` names it."""
    return F.transform(F.array(_c(value)), body)[0]


def as_double(arr) -> Column:
    return F.transform(_c(arr), lambda x: x.cast("double"))


def argmax(arr) -> Column:
    """0-based index of the first maximum."""
    return let(arr, lambda a: (F.array_position(a, F.array_max(a)) - 1).cast("int"))


def topk_indices(arr, k: int, by_index: bool = False) -> Column:
    """Indices of the k largest values (largest first, ties: lower index
    first); ``by_index`` re-sorts the chosen indices ascending."""
    a = _c(arr)
    ordered = F.array_sort(F.transform(a, lambda x, i: F.struct((-x).alias("k"), i.alias("i"))))
    idx = F.transform(F.slice(ordered, 1, k), lambda s: s.i.cast("int"))
    return F.array_sort(idx) if by_index else idx


def softmax(arr) -> Column:
    """H1: max-shifted softmax of an array; maximum, exponentials and their sum are each computed once."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)
    shifted = lambda a: let(F.array_max(a), lambda m: F.transform(a, lambda x: F.exp(x - m)))
    return let(arr, lambda a: let(shifted(a), lambda e: let(total(e), lambda t: F.transform(e, lambda x: x / t))))


def prob_at(arr, idx) -> Column:
    """H1: softmax probability at a 0-based index."""
    return F.element_at(softmax(arr), _c(idx) + 1)


def sigmoid(arr) -> Column:
    """H2: element-wise logistic function."""
    return F.transform(_c(arr), lambda x: 1.0 / (1.0 + F.exp(-x)))


def log_loss(logits, label) -> Column:
    """Cross-entropy = logsumexp(x) - x[label]."""
    lse = lambda a, m: F.log(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + F.exp(x - m))) + m
    return let(logits, lambda a: let(F.array_max(a), lambda m: lse(a, m)) - F.element_at(a, _c(label) + 1))


def binary_log_loss(logits, targets) -> Column:
    """Mean binary cross-entropy with logits over an array."""
    z = F.arrays_zip(_c(logits).alias("x"), _c(targets).alias("t"))
    terms = F.transform(z, lambda p: F.greatest(p.x, F.lit(0.0)) - p.x * p.t + F.log1p(F.exp(-F.abs(p.x))))
    return F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x) / F.size(terms)


def product(arr) -> Column:
    return F.aggregate(_c(arr), F.lit(1.0), lambda acc, x: acc * x)


def topk_nd(arr, rows: int, cols: int, k: int) -> Column:
    """Top-k over a flattened rows x cols score, as (row, col, flat) coordinates."""
    idx = topk_indices(arr, k)
    return F.transform(idx, lambda i: F.struct(F.floor(i / cols).cast("int").alias("r"),
                                               (i % cols).cast("int").alias("c"), i.alias("flat")))


def topk_multi(arr, shape: Sequence[int], k: int, ids: Sequence | None = None) -> Column:
    """The k best cells of a score over any number of dimensions, flattened
    with the last one fastest, as struct(at, score): the coordinates in mixed
    radix, taken through ``ids`` (an id array or None a dimension) where the
    score covers chosen ids only. Ties: lower flat index first."""
    strides = [math.prod(shape[d + 1:]) for d in range(len(shape))]
    ids = ids or [None] * len(shape)

    def place(i: Column, d: int) -> Column:
        at = F.floor(i / strides[d]).cast("int") % shape[d]
        return at if ids[d] is None else F.get(_c(ids[d]), at).cast("int")

    def cells(a: Column) -> Column:
        return F.transform(topk_indices(a, k), lambda i: F.struct(F.array(*[place(i, d) for d in range(len(shape))]).alias("at"), F.get(a, i).alias("score")))

    return let(arr, cells)


def joint_topk(p_first, p_second, p_third, k: int) -> Column:
    """H3: the k largest products p_first[a] * p_second[a][b] * p_third[a][b][c]
    as structs (prob, a, b, c), best first; ties: lower a, then b, then c.

    A threshold scan: the first factor is read from its largest value down, and
    what cannot reach the k-th product found so far is left out before it is
    multiplied: a whole first index by its largest second factor, a second one
    by its own (third factors are 1 at most). Of a list of third factors only
    the k best are looked at. The tensor of all products is never built.
    """
    def by_size(a: Column) -> Column:
        return F.array_sort(F.transform(a, lambda x, i: F.struct((-x).alias("n"), i.alias("i"))))

    def scan(first: Column, second: Column, third: Column) -> Column:
        empty = F.array().cast("array<struct<n:double,a:int,b:int,c:int>>")

        def products(x: Column, kth: Column) -> Column:
            own = F.get(second, x["i"])
            best = lambda b: F.slice(by_size(F.get(F.get(third, x["i"]), b)), 1, k)
            one = lambda y, b: F.when(x["n"] * y > kth, empty).otherwise(
                F.transform(best(b), lambda z: F.struct((x["n"] * y * -z["n"]).alias("n"), x["i"].alias("a"), b.alias("b"), z["i"].alias("c"))))
            return F.flatten(F.transform(own, one))

        def step(top: Column, x: Column) -> Column:
            kth = F.when(F.size(top) >= k, F.get(top, F.lit(k - 1))["n"]).otherwise(F.lit(0.0))
            bound = x["n"] * F.coalesce(F.array_max(F.get(second, x["i"])), F.lit(0.0))
            merged = F.slice(F.array_sort(F.concat(top, products(x, kth))), 1, k)
            return F.when((F.size(top) >= k) & (bound > kth), top).otherwise(merged)

        return F.aggregate(by_size(first), empty, step)

    got = let(F.struct(_c(p_first).alias("f"), _c(p_second).alias("s"), _c(p_third).alias("t")), lambda r: scan(r["f"], r["s"], r["t"]))
    return F.transform(got, lambda x: F.struct((-x["n"]).alias("prob"), x["a"].alias("a"), x["b"].alias("b"), x["c"].alias("c")))


def mean_loss(scores, gold, length=None) -> Column:
    """The mean cross-entropy of the rows of a score matrix, row i against
    class ``gold[i]``; rows beyond the gold list don't count, an empty one gives
    0. ``length`` masks the positions from there on."""
    def loss(g: Column, i: Column) -> Column:
        row = F.get(_c(scores), i)
        return log_loss(row if length is None else F.slice(row, F.lit(1), _c(length) if isinstance(length, (str, Column)) else F.lit(length)), g)

    terms = lambda gold: F.aggregate(F.transform(gold, loss), F.lit(0.0), lambda s, x: s + x) / F.size(gold)
    return let(gold, lambda g: F.when(F.size(g) > 0, terms(g)).otherwise(F.lit(0.0)))


def span_loss(start_scores, end_scores, spans, length=None, average: bool = False) -> Column:
    """Loss of the starts plus loss of the ends (or their mean) of a row's spans (st, ed), over score matrices of one row a span."""
    total = (mean_loss(start_scores, F.transform(_c(spans), lambda s: s["st"]), length)
             + mean_loss(end_scores, F.transform(_c(spans), lambda s: s["ed"]), length))
    return total / 2 if average else total


def pointer_loss(step_scores, pointers, length=None) -> Column:
    """Mean loss of a pointer sequence; the scores of step t are for pointer t + 1."""
    p = _c(pointers)
    return mean_loss(step_scores, F.slice(p, F.lit(2), F.greatest(F.size(p) - 1, F.lit(0))), length)


def slot_argmax(matrix, n) -> Column:
    """Argmax of each slot (inner array), cut to the first n slots."""
    return F.slice(F.transform(_c(matrix), lambda row: argmax(row)), 1, _c(n) if not isinstance(n, int) else F.lit(n))


def pair_beam(start_scores, end_scores, beam: int) -> Column:
    """ceil(sqrt(beam)) best starts x best ends, with probability products,
    ordered by probability (then start rank, end rank)."""
    k = int(math.ceil(math.sqrt(beam)))
    ps, pe = softmax(start_scores), softmax(end_scores)
    si, ei = topk_indices(start_scores, k), topk_indices(end_scores, k)
    pairs = F.flatten(F.transform(si, lambda s, a: F.transform(ei, lambda e, b: F.struct(
        (-(F.element_at(ps, s + 1) * F.element_at(pe, e + 1))).alias("negp"), a.alias("a"), b.alias("b"),
        s.alias("st"), e.alias("ed")))))
    return F.transform(F.array_sort(pairs), lambda p: F.struct(p.st.alias("st"), p.ed.alias("ed"),
                                                             (-p.negp).alias("prob")))


def decode_pointers(step_scores, end_id: int) -> Column:
    """Argmax of each step, cut after the first end position (inclusive)."""
    picks = F.transform(_c(step_scores), lambda s: argmax(s))
    pos = F.array_position(picks, F.lit(end_id))
    return F.when(pos > 0, F.slice(picks, 1, pos)).otherwise(picks)


def pad(arr, n: int, value=0) -> Column:
    """Right-pad with ``value`` to length n; null for a longer array, which
    is an error of the row (cut it before, as ``encode`` does)."""
    a = _c(arr)
    return F.when(F.size(a) <= n, F.concat(a, F.array_repeat(F.lit(value), F.greatest(F.lit(n) - F.size(a), F.lit(0)))))


def attention_mask(arr) -> Column:
    """1 where the id is > 0."""
    return F.transform(_c(arr), lambda x: (x > 0).cast("int"))


def segment_lengths(segments) -> Column:
    """Ed - st of each half-open interval."""
    return F.transform(_c(segments), lambda s: s.ed - s.st)


def find_sublist(needle, haystack) -> Column:
    """Every 0-based position where ``needle`` occurs in ``haystack``
    (overlapping matches included; empty when the needle is longer)."""
    def found(n: Column, h: Column) -> Column:
        last = F.size(h) - F.size(n)
        starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        # a slice is compared only where the first element agrees
        return F.filter(starts, lambda i: ((F.size(n) == 0) | F.get(h, i).eqNullSafe(F.get(n, F.lit(0)))) & (F.slice(h, i + 1, F.size(n)) == n))

    return let(needle, lambda n: let(haystack, lambda h: found(n, h)))


def sequence_match(a, b) -> Column:
    """Pointer lists equal as sequences."""
    return (_c(a) == _c(b)).cast("int")
