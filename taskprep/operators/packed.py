"""Specs as pointers into one packed input.

A packed input is ``[CLS]``, the members of a query vocabulary, the question and
the headers of the table, each followed by ``[SEP]``. Its borders are one sorted
array of (group, member, st, ed), half open, found by binary search. A spec
becomes the list of positions a decoder would point at; such a list, however
damaged, becomes a spec and its query text again.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from taskprep.functions.arrays import let
from taskprep.operators.tokens import detokenize, running_starts

VOCABULARY_GROUP, QUESTION_GROUP, HEADER_GROUP = 0, 1, 2
# The members of the query vocabulary in their order, and what an
# operator is written as.
VOCABULARY = ["none", "max", "min", "count", "sum", "average", "select", "where", "and", "equal", "greater than", "less than", "start", "end"]
OP_TEXT = {"equal": "=", "greater than": ">", "less than": "<"}
AGGS, SELECT, WHERE, AND, FIRST_OP, START, END = 6, 6, 7, 8, 9, 12, 13


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def vocabulary_tokens() -> Column:
    """The vocabulary's members as token lists."""
    return F.array(*[F.array(*[F.lit(t) for t in m.split(" ")]) for m in VOCABULARY])


def _ids(members: Column) -> Column:
    """Segment ids of header or vocabulary members: 1 on their tokens and on the separator after the last one."""
    ones = let(F.size(members) - 1, lambda last: F.transform(members, lambda m, i: F.concat(F.array_repeat(F.lit(1), F.size(m)), F.array((i == last).cast("int")))))
    return F.flatten(ones)


def _borders(members: Column, group: int, offset: Column) -> Column:
    """Borders of consecutive members of a group, the first at ``offset``."""
    def bordered(lens: Column) -> Column:
        return F.transform(running_starts(lens, 1), lambda st, i: F.struct(
            F.lit(group).alias("group"), i.alias("member"), (offset + st).cast("int").alias("st"), (offset + st + F.get(lens, i)).cast("int").alias("ed")))

    return let(F.transform(members, lambda x: F.size(x)), bordered)


def _closed(members: Column) -> Column:
    return F.flatten(F.transform(members, lambda x: F.concat(x, F.array(F.lit("[SEP]")))))


def _literals(vocabulary: list[list[str]], aligned: bool) -> tuple[Column, Column, Column]:
    """Tokens, segment ids and borders up to the end of a vocabulary that the plan knows: literals, not worked out a row."""
    tokens, ids, borders = ["[CLS]"], [], []
    for i, m in enumerate(vocabulary):
        borders.append((i, len(tokens), len(tokens) + len(m)))
        tokens += [*m, "[SEP]"]
        ids += [1] * len(m) + [int(i == len(vocabulary) - 1)]
    ids = [0, *ids] if aligned else [*ids, 0]
    border = lambda i, st, ed: F.struct(F.lit(VOCABULARY_GROUP).alias("group"), F.lit(i).alias("member"), F.lit(st).alias("st"), F.lit(ed).alias("ed"))
    held = F.array(*[border(*x) for x in borders]).cast("array<struct<`group`:int,member:int,st:int,ed:int>>")
    return F.array(*map(F.lit, tokens)), F.array(*map(F.lit, ids)), held


def pack_input(question, headers, vocabulary=None, aligned: bool = False) -> Column:
    """struct(tokens, segment_ids, borders) of a packed input.

    ``question`` is a token list, ``headers`` and ``vocabulary`` are lists of
    those; null counts as empty. A fixed vocabulary may be a Python list.
    Segment ids are 1 on vocabulary and header
    tokens and on the separator after the last of either, else 0. With a
    vocabulary its ids stand one place early, as models trained on this layout
    expect; ``aligned`` puts them on their own tokens.
    """
    lists = "array<array<string>>"
    empty, cls = F.array().cast(lists), F.array(F.lit(0))

    def front(v: Column) -> Column:
        ids = F.concat(cls, _ids(v)) if aligned else F.concat(_ids(v), cls)
        return F.struct(F.concat(F.array(F.lit("[CLS]")), _closed(v)).alias("tokens"), ids.alias("ids"), _borders(v, VOCABULARY_GROUP, F.lit(1)).alias("borders"))

    def packed(s: Column, tokens: Column, ids: Column, borders: Column) -> Column:
        q, h = s["q"], s["h"]

        def places_of(n: Column) -> Column:
            asked = F.struct(F.lit(QUESTION_GROUP).alias("group"), F.lit(0).alias("member"), n.cast("int").alias("st"), (n + F.size(q)).cast("int").alias("ed"))
            return F.concat(borders, F.array(asked), _borders(h, HEADER_GROUP, n + F.size(q) + 1))

        return F.struct(
            F.concat(tokens, q, F.array(F.lit("[SEP]")), _closed(h)).alias("tokens"),
            F.concat(ids, F.array_repeat(F.lit(0), F.size(q) + 1), _ids(h)).alias("segment_ids"), let(F.size(tokens), places_of).alias("borders"))

    own = [F.coalesce(_c(question), F.array().cast("array<string>")).alias("q"), F.coalesce(_c(headers), empty).alias("h")]
    if vocabulary is None or isinstance(vocabulary, list):
        return let(F.struct(*own), lambda s: packed(s, *_literals(vocabulary or [], aligned)))
    known = let(F.coalesce(_c(vocabulary), empty), front)
    return let(F.struct(known.alias("v"), *own), lambda s: packed(s, s["v"]["tokens"], s["v"]["ids"], s["v"]["borders"]))


def locate(point, borders) -> Column:
    """struct(group, member) of the border that holds a position, (-1, -1) where none does; a binary search."""
    p, b = _c(point), _c(borders)
    none = F.struct(F.lit(-1).alias("group"), F.lit(-1).alias("member"))

    def step(s: Column, _: Column) -> Column:
        mid = F.shiftright(s["lo"] + s["hi"], 1)
        right = F.get(b, mid)["st"] <= p
        open_ = s["lo"] < s["hi"]
        return F.struct(F.when(open_ & right, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(open_ & ~right, mid).otherwise(s["hi"]).alias("hi"))

    rounds = F.sequence(F.lit(1), F.ceil(F.log2(F.size(b) + 1)).cast("int"))
    at = F.aggregate(rounds, F.struct(F.lit(0).alias("lo"), F.size(b).alias("hi")), step)["lo"] - 1
    held = let(F.get(b, at), lambda x: F.when((x["st"] <= p) & (p < x["ed"]), F.struct(x["group"].alias("group"), x["member"].alias("member"))).otherwise(none))
    return F.when(p.isNotNull() & (F.size(b) > 0), held).otherwise(none)


def places(borders) -> Column:
    """J7 for every position up to the end of the last border: array of struct(group, member), (-1, -1) between borders; linear."""
    none = F.struct(F.lit(-1).alias("group"), F.lit(-1).alias("member"))

    def spread(b: Column) -> Column:
        following = F.concat(F.transform(F.slice(b, 2, F.size(b)), lambda x: x["st"]), F.array(F.element_at(b, -1)["ed"]))
        held = lambda x, to: F.least(x["ed"], to) - x["st"]
        parts = F.zip_with(b, following, lambda x, to: F.concat(
            F.array_repeat(F.struct(x["group"].alias("group"), x["member"].alias("member")), held(x, to)), F.array_repeat(none, to - x["st"] - held(x, to))))
        return F.concat(F.array_repeat(none, F.element_at(b, 1)["st"]), F.flatten(parts))

    return let(borders, lambda b: F.when(F.size(b) > 0, spread(b)))


def locate_all(points, borders) -> Column:
    """J7 for a list of positions: each one's struct(group, member) as by ``locate``, looked up in ``places`` once a row."""
    none = F.struct(F.lit(-1).alias("group"), F.lit(-1).alias("member"))
    row = F.struct(places(borders).alias("at"), _c(points).alias("points"))
    return let(row, lambda r: F.transform(r["points"], lambda p: F.coalesce(F.get(r["at"], p), none)))


def spec_positions(spec, borders, pool: str = "start") -> Column:
    """The positions of a spec in its packed input:
    start, select, agg, column, (where | and, column, operator, value start, value end)*, end.

    ``spec`` is struct(sel, agg, conds of (col, op, st, ed)) with the first and
    last question token of each value. ``pool`` says where in a member of more
    tokens to point: at its ``start``, its ``end`` (one past the last token), or
    at all of them (``avg``; the result is then a list of position lists).
    """
    s, b = _c(spec), _c(borders)
    nv = F.size(F.filter(b, lambda x: x["group"] == VOCABULARY_GROUP))

    def pointers(n: Column) -> Column:
        at = {"start": lambda x: x["st"], "end": lambda x: x["ed"], "avg": lambda x: F.sequence(x["st"], x["ed"] - 1)}[pool]
        word = lambda i: at(F.get(b, i if isinstance(i, Column) else F.lit(i)))
        head = lambda i: at(F.get(b, n + 1 + i))
        inside = lambda x: (F.get(b, n)["st"] + x).cast("int")
        value = (lambda x: F.array(inside(x))) if pool == "avg" else inside
        conds = F.flatten(F.transform(s["conds"], lambda c, i: F.array(
            word(F.when(i == 0, WHERE).otherwise(AND)), head(c["col"]), word(FIRST_OP + c["op"]), value(c["st"]), value(c["ed"]))))
        return F.concat(F.array(word(START), word(SELECT), word(s["agg"]), head(s["sel"])), conds, F.array(word(END)))

    return let(nv, pointers)


def specs_from_positions(points, tokens, borders, header, words, word_of, question) -> Column:
    """struct(query, sel, agg, conds of (col, op, val)) of a pointer list, read left to right.

    Nothing is assumed of the list. The header after an aggregate is the
    selected column, any other opens a condition; the first operator after it
    and the next pair of question positions complete it, and only complete
    conditions are kept. ``sel`` and ``agg`` are null where they never came. A
    member of more tokens counts by its first one; other positions add their
    token to the query text, separators nothing. ``word_of`` maps question
    tokens to ``words`` (T7); the text of a value is put together from those as it
    stands in ``question`` (P15).
    """
    toks, b, head, wd, of = _c(tokens), _c(borders), _c(header), _c(words), _c(word_of)
    piece_t, cond_t = "array<struct<text:string,st:int,ed:int>>", "array<struct<col:int,op:int,st:int,ed:int>>"
    null = F.lit(None).cast("int")
    start = F.struct(null.alias("sel"), null.alias("agg"), F.lit(False).alias("after_agg"), null.alias("opened"), null.alias("col"), null.alias("op"),
                     F.array().cast(cond_t).alias("conds"), F.array().cast(piece_t).alias("pieces"))
    q_start = F.get(F.filter(b, lambda x: x["group"] == QUESTION_GROUP), F.lit(0))["st"]

    def seen(p: Column, x: Column, q0: Column) -> Column:
        return F.struct(
            x["group"].alias("group"), x["member"].alias("member"), p.alias("p"),
            (F.coalesce(F.get(b, x["member"])["st"], F.lit(-1)) == p).alias("first"), F.get(toks, p).alias("tok"),
            F.get(of, p - q0).alias("word"))

    symbols = F.create_map(*[F.lit(y) for m, t in OP_TEXT.items() for y in (VOCABULARY.index(m), t)])

    def step(a: Column, x: Column) -> Column:
        kept = {c: a[c] for c in ("sel", "agg", "after_agg", "opened", "col", "op", "conds", "pieces")}
        state = lambda **to: F.struct(*[F.coalesce(v, null).alias(c) if c in ("sel", "agg") else v.alias(c) for c, v in {**kept, **to}.items()])
        said = lambda text: F.concat(a["pieces"], F.array(F.struct(text.cast("string").alias("text"), null.alias("st"), null.alias("ed"))))
        m, g = x["member"], x["group"]
        is_op = x["first"] & m.between(FIRST_OP, FIRST_OP + len(OP_TEXT) - 1)
        fresh = a["col"].isNotNull() & a["op"].isNull()
        whole = a["col"].isNotNull() & a["op"].isNotNull()
        value = F.array(F.struct(F.lit(None).cast("string").alias("text"), a["opened"].alias("st"), x["word"].alias("ed")))
        cond = F.array(F.struct(a["col"].alias("col"), a["op"].alias("op"), a["opened"].alias("st"), x["word"].alias("ed")))
        name = F.get(head, m)
        return (F.when((g == VOCABULARY_GROUP) & x["first"] & m.isin(START, END), a)
                .when((g == VOCABULARY_GROUP) & x["first"] & (m < AGGS), state(agg=m, after_agg=F.lit(True)))
                .when((g == VOCABULARY_GROUP) & is_op, state(op=F.when(fresh, m - FIRST_OP).otherwise(a["op"]), pieces=said(F.element_at(symbols, m))))
                .when(g == VOCABULARY_GROUP, state(pieces=said(x["tok"])))
                .when((g == QUESTION_GROUP) & a["opened"].isNull(), state(opened=x["word"]))
                .when(g == QUESTION_GROUP, state(opened=null, pieces=F.concat(a["pieces"], value), conds=F.when(whole, F.concat(a["conds"], cond)).otherwise(a["conds"]),
                                                 col=F.when(whole, null).otherwise(a["col"]), op=F.when(whole, null).otherwise(a["op"])))
                .when((g == HEADER_GROUP) & a["after_agg"], state(sel=m, after_agg=F.lit(False), pieces=said(F.concat(F.lit("("), name, F.lit(")")))))
                .when(g == HEADER_GROUP, state(col=m, op=null, pieces=said(name)))
                .otherwise(a))

    text = lambda x: detokenize(F.slice(wd, x["st"] + 1, F.greatest(x["ed"] - x["st"] + 1, F.lit(0))), _c(question))
    ps = F.coalesce(_c(points), F.array().cast("array<int>"))
    folded = F.aggregate(let(q_start, lambda q0: F.zip_with(ps, locate_all(ps, b), lambda p, x: seen(p, x, q0))), start, step)
    return let(folded, lambda r: F.struct(
        F.array_join(F.transform(r["pieces"], lambda x: F.when(x["text"].isNotNull(), x["text"]).otherwise(text(x))), " ").alias("query"),
        r["sel"].alias("sel"), r["agg"].alias("agg"),
        F.transform(r["conds"], lambda x: F.struct(x["col"].alias("col"), x["op"].alias("op"), text(x).alias("val"))).alias("conds")))
