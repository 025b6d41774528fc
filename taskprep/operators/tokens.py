"""Token, window and sequence operators.

Tokens with character offsets come from ``mapInArrow`` (a regex scan per
text written straight into Arrow arrays: offsets need a left-to-right pass
that built-in array functions can only do in quadratic time). Everything
after that is built-in array work, ``aggregate`` folds or explode/join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taskprep.functions.arrays import let
from taskprep.session import cut_lineage

WORD_PATTERN = r"\S+"
CLS_ID, SEP_ID, UNK_ID, PAD_ID = 1, 2, 0, 0

TOKEN_TYPE = T.ArrayType(T.StructType([T.StructField("tok", T.StringType()), T.StructField("st", T.IntegerType()),
                                       T.StructField("ed", T.IntegerType())]))


# Characters (tokens) of a batch that a task's Python turns into lists at once.
BATCH_ITEMS = 1 << 20


def _portions(batch, sizes, limit: int):
    """Consecutive slices of an Arrow batch of about ``limit`` items (``sizes`` a row), one row at least."""
    import numpy as np

    if not batch.num_rows:
        yield batch
        return
    part = (np.cumsum(sizes) - sizes) // limit
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


def tokenize(df: DataFrame, text: str, out: str = "tokens", pattern: str = WORD_PATTERN,
             lower: bool = False) -> DataFrame:
    """Tokens with [st, ed) character offsets (code points).

    ``mapInArrow``: per Arrow batch one regex scan per text, with the tokens
    and offsets written straight into flat Arrow arrays (no per-token Python
    objects beyond the match). A batch is cut into portions of bounded text, so
    a task's lists don't grow with the rows of a batch."""
    import re

    import pyarrow as pa
    import pyarrow.compute as pc

    schema = T.StructType(df.schema.fields + [T.StructField(out, TOKEN_TYPE)])
    names = df.columns + [out]

    def run(batches):
        rx = re.compile(pattern)
        whole = (p for b in batches for p in _portions(b, pc.fill_null(pc.binary_length(b.column(b.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False).astype("int64"), BATCH_ITEMS))
        for b in whole:
            texts = b.column(b.schema.get_field_index(text)).to_pylist()
            offs, toks, st, ed, nulls = [0], [], [], [], []
            for t in texts:
                if t is None:
                    nulls.append(True)
                    offs.append(len(toks))
                    continue
                for m in rx.finditer(t):
                    toks.append(m.group().lower() if lower else m.group())
                    st.append(m.start())
                    ed.append(m.end())
                offs.append(len(toks))
                nulls.append(False)
            items = pa.StructArray.from_arrays(
                [pa.array(toks, pa.string()), pa.array(st, pa.int32()), pa.array(ed, pa.int32())],
                names=["tok", "st", "ed"])
            lists = pa.ListArray.from_arrays(pa.array(offs, pa.int32()), items, mask=pa.array(nulls))
            yield pa.RecordBatch.from_arrays(list(b.columns) + [lists], names=names)

    return df.mapInArrow(run, schema)


# A token that every row holds is one join key; its rows are dealt over this many.
TOKEN_SALTS = 16


def _looked_up(df: DataFrame, key: str, items: str, table: DataFrame, item: str, value: str, sparse: bool = False) -> DataFrame:
    """(key, list of (item, value)) over the distinct items of each row. The table is
    repeated once a salt, so the rows of a frequent item spread; where the rows may
    ask for a small part of the table (``sparse``), only by the salts that ask for
    the item, so it is moved once."""
    salt = F.pmod(F.xxhash64(key), F.lit(TOKEN_SALTS)).cast("int")
    ex = df.select(key, salt.alias("salt"), F.explode(F.array_distinct(items)).alias(item))
    if sparse:
        ex = cut_lineage(ex)
        names = table.select(item, value).join(ex.select(item, "salt").distinct(), item)
    else:
        names = table.select(F.col(item), F.col(value), F.explode(F.sequence(F.lit(0), F.lit(TOKEN_SALTS - 1))).alias("salt"))
    found = ex.join(names, [item, "salt"])
    return found.groupBy(key).agg(F.collect_list(F.struct(F.col(item).alias("item"), F.col(value).alias("value"))).alias("__m"))


def _lists(column):
    """Lengths (null: 0) and flat values of an Arrow list column."""
    import pyarrow.compute as pc

    return pc.fill_null(column.value_lengths(), 0).to_numpy(zero_copy_only=False).astype("int64"), column.flatten()


def _places(n, items, m):
    """Where each item (``n`` a row, ``items`` flat) stands among the flat entries ``m`` of its row's list, -1 where it doesn't."""
    import numpy as np
    import pyarrow as pa

    n_m, entries = _lists(m)
    held = entries.field("item")
    codes = pa.chunked_array([held.cast(items.type), items]).combine_chunks().dictionary_encode()
    size = len(codes.dictionary) + 1
    code = codes.indices.fill_null(size - 1).to_numpy(zero_copy_only=False).astype(np.int64)
    row = lambda k: np.repeat(np.arange(len(k)), k) * size
    there, asked = row(n_m) + code[: len(held)], row(n) + code[len(held):]
    order = np.argsort(there, kind="stable")
    at = np.searchsorted(there[order], asked)
    if not len(order):
        return np.full(len(asked), -1), entries
    near = order[np.minimum(at, len(order) - 1)]
    return np.where(there[near] == asked, near, -1), entries


def _mapped(df: DataFrame, items: str, out: str, kind: str, default) -> DataFrame:
    """Each row's ``items`` through its list ``__m`` of (item, value), ``default`` where it has none; one sorted lookup a batch, not a scan of the list an item."""
    import numpy as np
    import pyarrow as pa

    schema = T.StructType(df.schema.fields + [T.StructField(out, T.ArrayType(T.DataType.fromDDL(kind)))])
    names = df.columns + [out]

    def run(batches):
        for batch in batches:
            for b in _portions(batch, _lists(batch.column(items))[0], BATCH_ITEMS):
                asked = b.column(items)
                n, flat = _lists(asked)
                at, entries = _places(n, flat, b.column("__m"))
                values = entries.field("value").take(pa.array(at, mask=at < 0)).fill_null(default)
                got = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32)), values, mask=asked.is_null())
                yield pa.RecordBatch.from_arrays([*b.columns, got], names=names)

    return df.mapInArrow(run, schema)


def token_ids(df: DataFrame, tokens: str, vocab: DataFrame, key: str, out: str = "ids") -> DataFrame:
    """Tokens -> vocabulary ids (unknown -> 0), in token order.

    Only a row's distinct tokens are joined to the vocabulary; the row maps its
    own tokens in place.
    """
    held = _looked_up(df, key, tokens, vocab.select("token", F.col("id").cast("int").alias("id")), "token", "id", sparse=True)
    ids = _mapped(df.join(held, key, "left"), tokens, out, "int", UNK_ID)
    return ids.withColumn(out, F.coalesce(out, F.array().cast("array<int>"))).drop("__m")


# The mark of a piece inside a word.
CONTINUATION = "##"


def word_pieces(words: DataFrame, vocab: DataFrame, max_piece: int) -> DataFrame:
    """(word, pieces): each distinct word cut greedily into its longest vocabulary
    prefixes (later pieces are looked up with the continuation mark); a word
    with a place where no piece fits is the one piece ``[UNK]``.

    Every substring of up to ``max_piece`` characters is joined to the
    vocabulary once a distinct word; the cut is a fold over the longest piece
    at each place."""
    w = words.select("word").filter("word <> ''").distinct()
    start = F.explode(F.sequence(F.lit(0), F.length("word") - 1)).alias("st")
    at = w.select("word", start)
    size = F.explode(F.sequence(F.lit(1), F.least(F.lit(max_piece), F.length("word") - F.col("st")))).alias("n")
    at = at.select("word", "st", size)
    token = F.concat(F.when(F.col("st") > 0, F.lit(CONTINUATION)).otherwise(F.lit("")), F.substring("word", F.col("st") + 1, F.col("n")))
    fits = at.withColumn("token", token).join(vocab.select("token"), "token", "left_semi")
    longest = fits.groupBy("word", "st").agg(F.max("n").alias("n"))
    held = longest.groupBy("word").agg(F.map_from_entries(F.collect_list(F.struct("st", "n"))).alias("m"))
    init = F.struct(F.lit(0).alias("pos"), F.array().cast("array<struct<tok:string,st:int,ed:int>>").alias("out"))

    def step(acc, _):
        n = F.try_element_at("m", acc.pos)
        mark = F.when(acc.pos > 0, F.lit(CONTINUATION)).otherwise(F.lit(""))
        piece = F.struct(F.concat(mark, F.substring("word", acc.pos + 1, n)).alias("tok"), acc.pos.alias("st"), (acc.pos + n).alias("ed"))
        more = F.struct((acc.pos + n).alias("pos"), F.concat(acc.out, F.array(piece)).alias("out"))
        return F.when((acc.pos < F.length("word")) & n.isNotNull(), more).otherwise(acc)

    cut = F.aggregate(F.sequence(F.lit(1), F.length("word")), init, step)
    whole = F.array(F.struct(F.lit("[UNK]").alias("tok"), F.lit(0).alias("st"), F.length("word").alias("ed")))
    done = w.join(held, "word", "left").withColumn("cut", F.when(F.col("m").isNotNull(), cut))
    return done.select("word", F.when(F.col("cut.pos") == F.length("word"), F.col("cut.out")).otherwise(whole).alias("pieces"))


#: vocabularies of up to so many tokens are held by every task; words are then cut where their rows are
HELD_PIECES = 1 << 18
#: words whose cut a task keeps; tokens whose pieces are made at once
KEPT_WORDS, CUT_ITEMS = 1 << 15, 1 << 15


def cut_word(word: str, vocab: dict[str, str], max_piece: int) -> list[tuple[str, int, int]]:
    """The pieces (tok, st, ed) of one word, as in ``word_pieces``; ``vocab`` maps each token to itself, so pieces share their text."""
    out, at = [], 0
    while at < len(word):
        mark = CONTINUATION if at else ""
        for end in range(min(at + max_piece, len(word)), at, -1):
            tok = vocab.get(mark + word[at:end])
            if tok is not None:
                break
        else:
            return [("[UNK]", 0, len(word))]
        out.append((tok, at, end))
        at = end
    return out


def subword_tokens(df: DataFrame, tokens: str, key: str, vocab: DataFrame, max_piece: int = 16, out: str = "pieces") -> DataFrame:
    """The sub-tokens of each row's ``tokens`` (struct tok, st, ed), as an
    array of (tok, st, ed, word): character offsets in the text, and the word's
    number. ``key`` names the row; a row without it has none.

    With a vocabulary of up to ``HELD_PIECES`` tokens (of those short enough to
    fit a piece) nothing is shuffled: a task holds it and cuts each word it meets.
    Beyond, distinct words are cut by joins and looked up by row."""
    import numpy as np
    import pyarrow as pa

    fit = vocab.select("token").filter(F.length("token") <= max_piece + len(CONTINUATION)).distinct()
    few = [r[0] for r in fit.limit(HELD_PIECES + 1).collect()]
    local = len(few) <= HELD_PIECES
    if local:
        rows, few = df, {t: t for t in few}
    else:
        few = {}
        words = df.select(key, F.transform(tokens, lambda t: t.tok).alias("__w"))
        cut = word_pieces(words.select(F.explode("__w").alias("word")), vocab, max_piece)
        rows = df.join(_looked_up(words, key, "__w", cut, "word", "pieces"), key, "left")
    piece = T.StructType([*TOKEN_TYPE.elementType.fields, T.StructField("word", T.IntegerType())])
    schema = T.StructType(rows.schema.fields + [T.StructField(out, T.ArrayType(piece))])
    names = rows.columns + [out]

    def run(batches):
        kept = {}

        def cuts_here(b, n, flat):
            """For each token the number of its word (-1: none), and pieces of the words: how many, (tok, st, ed) laid end to end."""
            codes = flat.field("tok").dictionary_encode()
            found = []
            for w in codes.dictionary.to_pylist():
                if w not in kept:
                    if len(kept) >= KEPT_WORDS:
                        kept.clear()
                    kept[w] = cut_word(w, few, max_piece)
                found.append(kept[w])
            at = codes.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            n_cut = np.array([len(x) for x in found], np.int64)
            unnamed = np.repeat(b.column(key).is_null().to_numpy(zero_copy_only=False), n)
            at = np.where((at >= 0) & ~unnamed, at, -1)
            if len(n_cut):
                at = np.where(n_cut[at] > 0, at, -1)
            tok, st, ed = zip(*(p for x in found for p in x)) if n_cut.sum() else ((), (), ())
            return at, n_cut, (pa.array(tok, pa.string()), np.array(st, np.int64), np.array(ed, np.int64))

        def cuts_joined(b, n, flat):
            at, entries = _places(n, flat.field("tok"), b.column("__m"))
            n_cut, cuts = _lists(entries.field("value"))
            return at, n_cut, (cuts.field("tok"), *(cuts.field(c).to_numpy(zero_copy_only=False) for c in ("st", "ed")))

        for batch in batches:
            for b in _portions(batch, _lists(batch.column(tokens))[0], CUT_ITEMS):
                own = b.column(tokens)
                n, flat = _lists(own)
                at, n_cut, (tok, st, ed) = (cuts_here if local else cuts_joined)(b, n, flat)
                first = np.cumsum(n_cut) - n_cut
                size = np.where(at >= 0, n_cut[at], 0) if len(n_cut) else np.zeros(len(at), np.int64)
                token = np.repeat(np.arange(len(at)), size)  # the token of each piece
                which = first[at[token]] + np.arange(len(token)) - (np.cumsum(size) - size)[token] if len(token) else np.empty(0, np.int64)
                start = flat.field("st").to_numpy(zero_copy_only=False)[token]
                place = lambda x: pa.array((x[which] + start).astype(np.int32))
                word = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
                pieces = pa.StructArray.from_arrays([tok.take(pa.array(which)), place(st), place(ed), pa.array(word[token].astype(np.int32))], names=["tok", "st", "ed", "word"])
                ends = np.concatenate(([0], np.cumsum(size)))[np.concatenate(([0], np.cumsum(n)))]
                lost = np.bincount(np.repeat(np.arange(len(n)), n)[at < 0], minlength=len(n)) > 0
                gone = pa.array(own.is_null().to_numpy(zero_copy_only=False) | lost)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pieces, mask=gone)], names=names)
            pa.default_memory_pool().release_unused()

    return rows.mapInArrow(run, schema).drop("__m")


def encode(ids, max_len: int | None, markers: bool = True) -> F.Column:
    """[CLS] + ids + [SEP], truncated to ``max_len`` if given (ids cut, markers kept)."""
    a = F.col(ids) if isinstance(ids, str) else ids
    if max_len is None:
        return F.concat(F.array(F.lit(CLS_ID)), a, F.array(F.lit(SEP_ID))) if markers else a
    if not markers:
        return F.slice(a, 1, max_len)
    return F.concat(F.array(F.lit(CLS_ID)), F.slice(a, 1, max_len - 2), F.array(F.lit(SEP_ID)))


# The names of the reserved ids.
SPECIAL_TOKENS = {0: "[UNK]", 1: "[CLS]", 2: "[SEP]"}


def ids_to_text(df: DataFrame, ids: str, vocab: DataFrame, key: str, out: str = "text") -> DataFrame:
    """Id sequence -> space-joined tokens; a row's distinct ids are joined
    to the vocabulary and mapped back in place."""
    spark = df.sparkSession
    special = spark.createDataFrame(list(SPECIAL_TOKENS.items()), "id int, token string")
    names = vocab.select(F.col("id").cast("int"), "token").unionByName(special)
    held = _looked_up(df, key, ids, names, "id", "token", sparse=True)
    text = _mapped(df.join(held, key, "left"), ids, "__t", "string", SPECIAL_TOKENS[UNK_ID])
    return text.withColumn(out, F.array_join("__t", " ")).drop("__m", "__t")


def window_context(df: DataFrame, q_len: str, n_ctx: str, max_len: int = 384, stride: int = 128,
                   offsets: str | None = None) -> DataFrame:
    """T4: one row per overlapping context window (question + context + 3
    markers <= max_len; consecutive windows share ``stride`` context tokens;
    only the context is cut).

    With ``offsets`` that array column is replaced by the window's own slice, so
    a window never carries its document. A question that leaves no room beyond
    the stride gives one row flagged ``window_error``, without a window.
    """
    room = F.lit(max_len) - F.col(q_len) - 3
    step = room - stride
    n_win = 1 + F.ceil(F.greatest(F.col(n_ctx) - room, F.lit(0)) / step)

    def window(i):
        start = (i * step).cast("int")
        size = F.least(room, F.col(n_ctx) - start).cast("int")
        parts = [i.alias("window_no"), start.alias("ctx_start"), size.alias("ctx_len")]
        return F.struct(*parts, *([F.slice(F.col(offsets), start + 1, size).alias(offsets)] if offsets else []))

    wins = F.when(step > 0, F.transform(F.sequence(F.lit(0), (n_win - 1).cast("int")), window))
    kept = [c for c in df.columns if c != offsets]
    out = df.select(*kept, (step <= 0).alias("window_error"), F.explode_outer(wins).alias("__w"))
    names = ["window_no", "ctx_start", "ctx_len", *([offsets] if offsets else [])]
    return out.select(*kept, "window_error", *(F.col("__w")[c].alias(c) for c in names))


def label_spans(df: DataFrame, offsets: str, q_len: str, start_char: str, end_char: str) -> DataFrame:
    """T5: answer token positions inside each window (first answer only), from
    the window's own ``offsets``; CLS position 0 when there is no answer or it
    is not wholly in the window. An answer may begin or end inside a token."""
    offs = F.col(offsets)
    base = F.col(q_len) + 2
    sc, ec = F.col(start_char), F.col(end_char)
    inside = (sc.isNotNull() & (F.get(offs, F.lit(0)).st <= sc) & (F.get(offs, F.size(offs) - 1).ed >= ec))
    n_before = F.size(F.filter(offs, lambda o: o.st <= sc))
    first_end = F.array_position(F.transform(offs, lambda o: o.ed >= ec), F.lit(True))
    return (df.withColumn("start_position", F.when(inside, base + n_before - 1).otherwise(F.lit(0)).cast("int"))
            .withColumn("end_position", F.when(inside, base + first_end - 1).otherwise(F.lit(0)).cast("int")))


def mask_offsets(df: DataFrame, offsets: str, q_len: str, out: str = "window_offsets") -> DataFrame:
    """Window offsets for [CLS] q [SEP] ctx [SEP]; null outside the context."""
    n = F.col(q_len) + F.col("ctx_len") + 3
    return df.withColumn(out, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(F.col(offsets), i - F.col(q_len) - 2)))


def running_starts(lens, sep: int = 0) -> F.Column:
    """Start of each of consecutive segments with ``sep`` places between them.

    Linear: every place of the row is labelled by whether a segment starts there.
    Each is given a place more than it has, so that empty ones have a start too.
    """
    n = F.col(lens) if isinstance(lens, str) else lens
    opens = F.flatten(F.transform(n, lambda x: F.concat(F.array(F.lit(True)), F.array_repeat(F.lit(False), x.cast("int")))))
    found = lambda o: F.filter(F.sequence(F.lit(0), F.size(o) - 1), lambda p: F.get(o, p))
    starts = let(opens, lambda o: F.when(F.size(o) > 0, found(o)).otherwise(F.array().cast("array<int>")))
    return F.transform(starts, lambda p, i: (p + i * (sep - 1)).cast("int"))


def pack_segments(segments, sep_len: int = 1) -> F.Column:
    """Half-open intervals of consecutive segments separated by ``sep_len``
    separator positions (segment i starts after the previous end + sep)."""
    lens = F.transform(F.col(segments) if isinstance(segments, str) else segments, lambda s: F.size(s))
    return F.zip_with(running_starts(lens, sep_len), lens, lambda st, n: F.struct(st.alias("st"), (st + n).alias("ed")))


def locate_segment(point, intervals) -> F.Column:
    """J7 (one group): index of the last interval with st <= p < ed, -1 if none."""
    p = F.col(point) if isinstance(point, str) else point
    hits = F.filter(F.transform(F.col(intervals) if isinstance(intervals, str) else intervals,
                                lambda s, i: F.when((s.st <= p) & (p < s.ed), i)), lambda x: x.isNotNull())
    return F.coalesce(F.array_max(hits), F.lit(-1))


def subtoken_index(subtokens) -> F.Column:
    """For a list of words' sub-token lists, the first sub-token position of
    each word and the word of each sub-token."""
    s = F.col(subtokens) if isinstance(subtokens, str) else subtokens
    lens = F.transform(s, lambda w: F.size(w))
    starts = running_starts(lens)
    word_of = F.flatten(F.transform(lens, lambda n, i: F.array_repeat(i, n)))
    return F.struct(starts.alias("word_start"), word_of.alias("word_of"))


def map_spans(spans, word_start, word_of=None, to_sub: bool = True) -> F.Column:
    """Word spans -> sub-token spans (or back with ``to_sub=False``)."""
    sp = F.col(spans) if isinstance(spans, str) else spans
    if to_sub:
        ws = F.col(word_start) if isinstance(word_start, str) else word_start
        return F.transform(sp, lambda s: F.struct(F.element_at(ws, s.st + 1).alias("st"),
                                                  F.element_at(ws, s.ed + 1).alias("ed")))
    wo = F.col(word_of) if isinstance(word_of, str) else word_of
    return F.transform(sp, lambda s: F.struct(F.element_at(wo, s.st + 1).alias("st"),
                                              F.element_at(wo, s.ed + 1).alias("ed")))


def spec_to_pointers(spec, n_vocab_ops: int = 0) -> F.Column:
    """Spec -> pointer/class sequence
    [start, select, agg, col, (where, col, op, vst, ved, and...)*, end] as
    (kind, value) pairs."""
    s = F.col(spec) if isinstance(spec, str) else spec

    def tok(kind, value):
        return F.struct(F.lit(kind).alias("kind"), value.cast("int").alias("value"))

    head = F.array(tok("start", F.lit(0)), tok("select", F.lit(0)), tok("agg", s.agg), tok("col", s.sel))
    conds = F.flatten(F.transform(s.conds, lambda c, i: F.concat(
        F.array(F.when(i == 0, tok("where", F.lit(0))).otherwise(tok("and", F.lit(0))),
                tok("col", c.col), tok("op", c.op)),
        F.array(tok("vst", c.st), tok("ved", c.ed)))))
    return F.concat(head, conds, F.array(tok("end", F.lit(0))))


def pointers_to_spec(pointers) -> F.Column:
    """Pointer sequence -> spec (a left-to-right scan as an ``aggregate``
    with a struct accumulator). ``malformed`` marks a list that names a part of
    a condition before any condition; that part is skipped."""
    p = F.col(pointers) if isinstance(pointers, str) else pointers
    cond_t = "array<struct<col:int,op:int,st:int,ed:int>>"
    init = F.struct(F.lit(-1).alias("sel"), F.lit(0).alias("agg"), F.array().cast(cond_t).alias("conds"),
                    F.lit("").alias("state"), F.lit(False).alias("malformed"))

    def step(acc, x):
        k, v = x.kind, x.value
        conds = acc.conds
        last = F.get(conds, F.size(conds) - 1)
        none = F.size(conds) == 0
        upd = lambda field: F.concat(F.slice(conds, 1, F.greatest(F.size(conds) - 1, F.lit(0))),
                                     F.array(last.withField(field, v)))
        return (F.when(k == "agg", acc.withField("agg", v))
                .when((k == "col") & (acc.state == ""), acc.withField("sel", v))
                .when(k.isin("where", "and"), acc.withField("conds", F.concat(conds, F.array(F.struct(
                    F.lit(-1).alias("col"), F.lit(-1).alias("op"), F.lit(-1).alias("st"), F.lit(-1).alias("ed")))))
                      .withField("state", F.lit("w")))
                .when(k.isin("op", "vst", "ved") & none, acc.withField("malformed", F.lit(True)))
                .when((k == "col") & (acc.state == "w"), acc.withField("conds", upd("col")))
                .when(k == "op", acc.withField("conds", upd("op")))
                .when(k == "vst", acc.withField("conds", upd("st")))
                .when(k == "ved", acc.withField("conds", upd("ed")))
                .otherwise(acc))

    r = F.aggregate(p, init, step)
    return F.struct(r.sel.alias("sel"), r.agg.alias("agg"), r.conds.alias("conds"), r.malformed.alias("malformed"))


def condition_values(query_tokens, question_tokens) -> F.Column:
    """From a tokenised query ``... WHERE col OP value AND col OP value``,
    each condition's (op, value tokens, first position of the value in the
    question or -1). The operator is the first ``EQL`` of the condition, else
    its first ``LT``, else its first ``GT``, so a value may hold another one; a
    condition without an operator has a null one and no value."""
    q = F.col(query_tokens) if isinstance(query_tokens, str) else query_tokens
    qs = F.col(question_tokens) if isinstance(question_tokens, str) else question_tokens
    ops = ("EQL", "LT", "GT")
    w = F.array_position(q, F.lit("WHERE")).cast("int")
    tail = F.when(w > 0, F.slice(q, w + 1, F.size(q))).otherwise(F.array().cast("array<string>"))

    def split(tail):
        # AND positions split the tail into conditions
        cuts = F.filter(F.transform(tail, lambda t, i: F.when(t == "AND", i)), lambda x: x.isNotNull())
        bounds = F.concat(F.array(F.lit(-1)), cuts, F.array(F.size(tail)))
        return let(bounds, lambda b: F.zip_with(F.slice(b, 1, F.size(b) - 1), F.slice(b, 2, F.size(b)), lambda st, ed: F.slice(tail, st + 2, ed - st - 1)))

    from taskprep.functions.arrays import find_sublist

    def one(piece):
        places = [F.array_position(piece, F.lit(o)).cast("int") for o in ops]
        return let(F.coalesce(*[F.when(p > 0, p) for p in places]), lambda at: valued(piece, at))

    def valued(piece, at):
        val = F.when(at.isNotNull(), F.slice(piece, F.coalesce(at, F.lit(0)) + 1, F.size(piece))).otherwise(F.array().cast("array<string>"))
        pos = lambda v: F.when(at.isNotNull(), F.element_at(F.concat(find_sublist(v, qs), F.array(F.lit(-1))), 1)).otherwise(F.lit(-1))
        return let(val, lambda v: F.struct(F.get(piece, at - 1).alias("op"), v.alias("value"), pos(v).alias("pos")))

    return F.when(w > 0, F.transform(F.filter(let(tail, split), lambda p: F.size(p) > 0), one))


# Token spellings mapped back to characters, the characters a
# token may start with to get a space, and the characters after which no
# space is inserted.
DETOKEN_MAP = {"-LRB-": "(", "-RRB-": ")", "-LSB-": "[", "-RSB-": "]", "``": '"', "''": '"'}
SPACE_ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789$"
NO_SPACE_AFTER = ["(", "/", "\u2013", "#", "$", "&"]


def detokenize(tokens, question) -> F.Column:
    """Join value tokens back as they are written in the question.

    Tokens and question are lower-cased (so only the quote spellings of the
    map can apply). A space goes before a token when the text so far plus a
    space plus the token occurs in the question; none when the text plus the
    token occurs; otherwise a closing double quote gets one, a token not
    starting with a letter, digit or ``$`` gets none, and any other token gets
    one unless the previous character is an opening symbol or an opening
    quote. A fold (``aggregate``) with a (text, quote parity) state."""
    toks = F.filter(F.transform(F.col(tokens) if isinstance(tokens, str) else tokens, lambda t: F.lower(t)),
                    lambda t: t.isNotNull() & (t != ""))
    mapping = F.create_map(*[x for kv in DETOKEN_MAP.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    mapped = F.transform(toks, lambda t: F.coalesce(F.element_at(mapping, t), t))
    init = F.struct(F.lit("").alias("ret"), F.lit(0).alias("par"))

    def step(q, acc, w):
        par = F.when(w == '"', 1 - acc.par).otherwise(acc.par)
        ret = acc.ret
        last = F.substring(ret, -1, 1)
        pad = (F.when(F.length(ret) == 0, F.lit(False))
               .when(F.position(F.concat(ret, F.lit(" "), w), q) > 0, F.lit(True))
               .when(F.position(F.concat(ret, w), q) > 0, F.lit(False))
               .when(w == '"', par == 1)
               .when(~F.substring(w, 1, 1).isin(*list(SPACE_ALPHABET)), F.lit(False))
               .otherwise(~last.isin(*NO_SPACE_AFTER) & ((last != '"') | (par == 0))))
        return F.struct(F.concat(ret, F.when(pad, F.lit(" ")).otherwise(F.lit("")), w).alias("ret"),
                        par.alias("par"))

    ret = let(F.lower(F.col(question) if isinstance(question, str) else question), lambda q: F.aggregate(mapped, init, lambda acc, w: step(q, acc, w)).ret)
    return F.regexp_replace(ret, r"(?U)^\s+|\s+$", "")
