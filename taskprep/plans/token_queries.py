"""Registered token/vocabulary/window queries on ``documents`` and ``benchmark``.

Words are whitespace tokens, lower-cased. The words of labelled documents stand
in for the tokens that have an embedding. Each document is paired with the
benchmark item ``doc_id mod (number of items)`` (its question).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taskprep.functions import arrays as A
from taskprep.operators import tokens as TK
from taskprep.operators import vocab as V
from taskprep.session import cut_lineage, read_table, spread

MAX_LEN = 32
WIN_LEN, WIN_STRIDE = 96, 24
ANSWER = (10, 13)


def _words(c):
    return F.filter(F.split(F.lower(c), r"(?U)\s+"), lambda t: t != "")


def _token_rows(spark: SparkSession, sf: str) -> DataFrame:
    d = spread(read_table(spark, sf, "documents").select("doc_id", "text")).select(
        F.lit(0).alias("source_no"), F.col("doc_id").alias("row_id"), _words(F.col("text")).alias("w"))
    b = read_table(spark, sf, "benchmark").select(F.lit(1).alias("source_no"), F.col("item_id").alias("row_id"),
                                                  _words(F.col("text")).alias("w"))
    return d.unionByName(b).select("source_no", "row_id", F.posexplode("w").alias("pos", "token"))


def _vocab(spark: SparkSession, sf: str) -> DataFrame:
    labelled = read_table(spark, sf, "documents").join(read_table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")
    embedded = labelled.select(F.explode(_words(F.col("text"))).alias("token"))
    return cut_lineage(V.build_vocab(_token_rows(spark, sf), embedded))


def vocab_build(spark: SparkSession, sf: str) -> DataFrame:
    """A7 + J5: first-occurrence vocabulary of the tokens that have an embedding."""
    return _vocab(spark, sf).select("token", "id", F.col("n").cast("long").alias("n"))


_SQL_VOCAB = """
tk AS (SELECT 0 AS source_no, doc_id AS row_id, unnest(w) AS token, generate_subscripts(w, 1) - 1 AS pos
       FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda t: t <> '') AS w FROM documents)
       UNION ALL
       SELECT 1, item_id, unnest(w), generate_subscripts(w, 1) - 1
       FROM (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda t: t <> '') AS w FROM benchmark)),
emb AS (SELECT DISTINCT token FROM tk WHERE source_no = 0 AND row_id IN (SELECT doc_id FROM labels)),
fo AS (SELECT token, min([source_no, row_id, pos]) AS first, count(*) AS n FROM tk WHERE token IN (SELECT token FROM emb) GROUP BY token),
vocab AS (SELECT token, CAST(row_number() OVER (ORDER BY first) + 2 AS INTEGER) AS id, n FROM fo)"""

SQL_VOCAB_BUILD = "WITH " + _SQL_VOCAB + "\nSELECT token, id, CAST(n AS BIGINT) AS n FROM vocab"


def token_id_rows(spark: SparkSession, sf: str) -> DataFrame:
    """J4 + T1 + T2 + T3: benchmark texts -> ids (unknown 0) -> [1] ids [2]
    truncated to 32 -> padded with 0 -> attention mask."""
    b = read_table(spark, sf, "benchmark").select("item_id", _words(F.col("text")).alias("w"))
    ids = TK.token_ids(b, "w", _vocab(spark, sf), "item_id")
    enc = A.pad(TK.encode("ids", MAX_LEN), MAX_LEN)
    out = ids.select("item_id", enc.alias("input_ids"))
    mask = A.attention_mask("input_ids")
    return out.select("item_id", F.array_join("input_ids", ",").alias("input_ids"),
                      F.aggregate(mask, F.lit(0), lambda a, x: a + x).alias("n_real"))


SQL_TOKEN_ID_ROWS = "WITH " + _SQL_VOCAB + f""",
bt AS (SELECT item_id, unnest(w) AS token, generate_subscripts(w, 1) - 1 AS pos
       FROM (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda t: t <> '') AS w FROM benchmark)),
ids AS (SELECT b.item_id, list(coalesce(v.id, 0) ORDER BY b.pos) AS ids
        FROM (SELECT * FROM bt WHERE pos < {MAX_LEN - 2}) b LEFT JOIN vocab v ON v.token = b.token GROUP BY b.item_id),
enc AS (SELECT bm.item_id, list_concat([1], coalesce(ids.ids, []), [2]) AS e
        FROM benchmark bm LEFT JOIN ids ON ids.item_id = bm.item_id),
padded AS (SELECT item_id, list_concat(e, list_transform(range({MAX_LEN} - len(e)), lambda x: 0)) AS p FROM enc)
SELECT item_id, array_to_string(p, ',') AS input_ids,
       CAST(len(list_filter(p, lambda x: x > 0)) AS INTEGER) AS n_real FROM padded
"""


def qa_windows(spark: SparkSession, sf: str) -> DataFrame:
    """T10 + T4 + T5 + T6: documents tokenised with offsets, cut into
    overlapping windows after the whole question, answer (from inside token 10
    to inside token 12) labelled per window, offsets masked outside the
    context; a question too long for the window is flagged."""
    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    bench = read_table(spark, sf, "benchmark").select("item_id", "text")
    n_items = bench.agg(F.count(F.lit(1)).alias("n_items")).scalar()
    q = bench.select("item_id", F.size(_words(F.col("text"))).alias("q_len"))
    d = TK.tokenize(spread(docs), "text", "tokens")
    d = d.select("doc_id", "tokens", (F.col("doc_id") % n_items).alias("item_id")).join(q, "item_id")
    d = d.withColumn("n_ctx", F.size("tokens"))
    a0, a1 = ANSWER
    has = F.col("n_ctx") >= a1
    first, last = F.get("tokens", F.lit(a0)), F.get("tokens", F.lit(a1 - 1))
    part = lambda t: F.when(t.ed - t.st > 1, F.lit(1)).otherwise(F.lit(0))  # noqa: E731 - one character into the token
    d = d.withColumn("start_char", F.when(has, first.st + part(first))).withColumn("end_char", F.when(has, last.ed - part(last)))
    w = TK.window_context(d, "q_len", "n_ctx", WIN_LEN, WIN_STRIDE, "tokens")
    w = TK.label_spans(w, "tokens", "q_len", "start_char", "end_char")
    w = TK.mask_offsets(w, "tokens", "q_len")
    return w.select("doc_id", F.col("window_no").cast("int").alias("window_no"), "ctx_start", "ctx_len",
                    "start_position", "end_position", "window_error",
                    F.coalesce(F.size(F.filter("window_offsets", lambda o: o.isNotNull())), F.lit(0)).alias("n_offsets"))


SQL_QA_WINDOWS = f"""
WITH bi AS (SELECT item_id, len(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda t: t <> '')) AS q_len FROM benchmark),
ni AS (SELECT count(*) AS n FROM benchmark),
d AS (SELECT doc_id, len(regexp_extract_all(text, '\\S+')) AS n_ctx, bi.q_len, {WIN_LEN} - bi.q_len - 3 AS room
      FROM documents, ni JOIN bi ON bi.item_id = documents.doc_id % ni.n),
w AS (SELECT doc_id, n_ctx, q_len, room, unnest(range(CAST(1 + ceil(greatest(n_ctx - room, 0) / (room - {WIN_STRIDE}))
                                                        AS BIGINT))) AS window_no FROM d WHERE room > {WIN_STRIDE}),
w2 AS (SELECT *, CAST(window_no * (room - {WIN_STRIDE}) AS INTEGER) AS ctx_start FROM w),
w3 AS (SELECT *, CAST(least(room, n_ctx - ctx_start) AS INTEGER) AS ctx_len FROM w2)
SELECT doc_id, CAST(window_no AS INTEGER) AS window_no, ctx_start, ctx_len,
       CAST(CASE WHEN n_ctx >= {ANSWER[1]} AND ctx_start <= {ANSWER[0]} AND ctx_start + ctx_len - 1 >= {ANSWER[1] - 1}
                 THEN q_len + 2 + {ANSWER[0]} - ctx_start ELSE 0 END AS INTEGER) AS start_position,
       CAST(CASE WHEN n_ctx >= {ANSWER[1]} AND ctx_start <= {ANSWER[0]} AND ctx_start + ctx_len - 1 >= {ANSWER[1] - 1}
                 THEN q_len + 2 + {ANSWER[1] - 1} - ctx_start ELSE 0 END AS INTEGER) AS end_position,
       FALSE AS window_error, ctx_len AS n_offsets
FROM w3
UNION ALL
SELECT doc_id, NULL, NULL, NULL, 0, 0, TRUE, 0 FROM d WHERE room <= {WIN_STRIDE}
"""


MAX_PIECE = 4


def subword_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """T10 + T7: the documents' words cut into sub-tokens. The vocabulary holds
    every beginning of up to four characters, and every inner piece of up to
    two, of the words of ``conversations``."""
    conv = read_table(spark, sf, "conversations").select(F.explode(_words(F.col("text"))).alias("w")).distinct()
    head = conv.select(F.explode(F.transform(F.sequence(F.lit(1), F.least(F.lit(MAX_PIECE), F.length("w"))), lambda n: F.substring(F.col("w"), F.lit(1), n))).alias("token"))
    inner = conv.filter(F.length("w") > 1).select("w", F.explode(F.sequence(F.lit(2), F.length("w"))).alias("p"))
    inner = inner.select("w", "p", F.explode(F.array(F.lit(1), F.lit(2))).alias("n"))
    inner = inner.filter("p + n - 1 <= length(w)").select(F.concat(F.lit(TK.CONTINUATION), F.substring("w", F.col("p"), F.col("n"))).alias("token"))
    vocab = head.union(inner).distinct()
    docs = TK.tokenize(spread(read_table(spark, sf, "documents").select("doc_id", "text")), "text", "tokens", lower=True)
    out = TK.subword_tokens(docs.select("doc_id", "tokens"), "tokens", "doc_id", vocab, MAX_PIECE)
    return out.select("doc_id", F.size("pieces").alias("n_pieces"), F.size(F.filter("pieces", lambda p: p.tok == "[UNK]")).alias("n_unknown"),
                      F.md5(F.array_join(F.transform("pieces", lambda p: p.tok), " ")).alias("pieces_md5"),
                      F.md5(F.array_join(F.transform("pieces", lambda p: F.concat_ws("-", p.st.cast("string"), p.ed.cast("string"))), ",")).alias("offsets_md5"))


def segments(spark: SparkSession, sf: str) -> DataFrame:
    """T9 + T11 + J7: benchmark words in 5-word segments packed with one
    separator; intervals, lengths, and the segment of every position (-1 on
    separators)."""
    b = read_table(spark, sf, "benchmark").select("item_id", _words(F.col("text")).alias("w"))
    n_seg = F.ceil(F.size("w") / 5).cast("int")
    segs = F.transform(F.sequence(F.lit(0), n_seg - 1), lambda i: F.slice("w", i * 5 + 1, 5))
    b = b.withColumn("segs", F.when(n_seg > 0, segs).otherwise(F.array().cast("array<array<string>>")))
    b = b.withColumn("iv", TK.pack_segments("segs"))
    total = F.coalesce(F.element_at("iv", -1).ed, F.lit(0))
    located = F.transform(F.sequence(F.lit(0), total - 1), lambda p: TK.locate_segment(p, "iv"))
    return b.select("item_id",
                    F.array_join(F.transform("iv", lambda s: F.concat_ws("-", s.st.cast("string"), s.ed.cast("string"))),
                                 ",").alias("intervals"),
                    F.array_join(A.segment_lengths("iv"), ",").alias("lengths"),
                    F.array_join(F.when(total > 0, located).otherwise(F.array().cast("array<int>")), ",")
                    .alias("located"))


SQL_SUBWORD_TOKENS = f"""
WITH RECURSIVE cw AS (SELECT DISTINCT unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda t: t <> '')) AS w FROM conversations),
vocab AS (SELECT substr(w, 1, n) AS token FROM (SELECT w, unnest(range(1, least({MAX_PIECE}, length(w)) + 1)) AS n FROM cw)
          UNION SELECT '##' || substr(w, p, n) FROM (SELECT w, p, unnest([1, 2]) AS n FROM (SELECT w, unnest(range(2, length(w) + 1)) AS p FROM cw))
          WHERE p + n - 1 <= length(w)),
dw AS (SELECT doc_id, unnest(regexp_extract_all(text, '\\S+')) AS raw, generate_subscripts(regexp_extract_all(text, '\\S+'), 1) AS i FROM documents),
gap AS (SELECT doc_id, unnest(string_split_regex(text, '\\S+')) AS sp, generate_subscripts(string_split_regex(text, '\\S+'), 1) AS i FROM documents),
pl AS (SELECT dw.doc_id, dw.i, lower(raw) AS word,
              sum(length(sp) + length(raw)) OVER (PARTITION BY dw.doc_id ORDER BY dw.i) - length(raw) AS st
       FROM dw JOIN gap ON gap.doc_id = dw.doc_id AND gap.i = dw.i),
ds AS (SELECT DISTINCT word FROM pl),
fit AS (SELECT word, p, max(n) AS n FROM (SELECT word, p, unnest(range(1, least({MAX_PIECE}, length(word) - p) + 1)) AS n
        FROM (SELECT word, unnest(range(length(word))) AS p FROM ds)) c
        JOIN vocab v ON v.token = CASE WHEN p > 0 THEN '##' ELSE '' END || substr(word, p + 1, n) GROUP BY word, p),
cut AS (SELECT word, 0::BIGINT AS p, 0::BIGINT AS e FROM ds
        UNION ALL SELECT c.word, c.e, c.e + f.n FROM cut c JOIN fit f ON f.word = c.word AND f.p = c.e),
ok AS (SELECT word FROM cut GROUP BY word, length(word) HAVING max(e) = length(word)),
pc AS (SELECT word, p, e, CASE WHEN p > 0 THEN '##' ELSE '' END || substr(word, p + 1, e - p) AS tok FROM cut WHERE e > 0 AND word IN (SELECT word FROM ok)
       UNION ALL SELECT word, 0, length(word), '[UNK]' FROM ds WHERE word NOT IN (SELECT word FROM ok)),
a AS (SELECT pl.doc_id, pl.i, pc.p, pc.tok, CAST(pl.st + pc.p AS BIGINT) AS st, CAST(pl.st + pc.e AS BIGINT) AS ed FROM pl JOIN pc ON pc.word = pl.word)
SELECT doc_id, CAST(count(*) AS INTEGER) AS n_pieces, CAST(count(*) FILTER (tok = '[UNK]') AS INTEGER) AS n_unknown,
       md5(string_agg(tok, ' ' ORDER BY i, p)) AS pieces_md5, md5(string_agg(st || '-' || ed, ',' ORDER BY i, p)) AS offsets_md5
FROM a GROUP BY doc_id
"""


SQL_SEGMENTS = """
WITH b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda t: t <> '') AS w FROM benchmark),
s AS (SELECT item_id, list_transform(range(CAST(ceil(len(w) / 5) AS BIGINT)), lambda i: len(w[i * 5 + 1: i * 5 + 5])) AS lens
      FROM b),
iv AS (SELECT item_id, lens, list_transform(range(len(lens)), lambda i:
          {'st': list_sum(list_transform(lens[1:i], lambda x: x + 1)), 'n': lens[i + 1]}) AS raw FROM s),
iv2 AS (SELECT item_id, lens, list_transform(raw, lambda r: {'st': coalesce(r.st, 0), 'ed': coalesce(r.st, 0) + r.n}) AS iv
        FROM iv),
tot AS (SELECT *, CAST(coalesce(iv[len(iv)].ed, 0) AS BIGINT) AS total FROM iv2)
SELECT item_id,
       array_to_string(list_transform(iv, lambda s: CAST(s.st AS VARCHAR) || '-' || CAST(s.ed AS VARCHAR)), ',') AS intervals,
       array_to_string(lens, ',') AS lengths,
       array_to_string(list_transform(range(total), lambda p: coalesce(list_max(list_filter(
           list_transform(range(len(iv)), lambda i: CASE WHEN iv[i + 1].st <= p AND p < iv[i + 1].ed THEN i END),
           lambda x: x IS NOT NULL)), -1)), ',') AS located
FROM tot
"""


def sublist_matches(spark: SparkSession, sf: str) -> DataFrame:
    """Every position of the words of a document's last line inside its words."""
    docs = spread(read_table(spark, sf, "documents").select("doc_id", "text")).select(
        "doc_id", _words(F.col("text")).alias("h"), _words(F.element_at(F.split("text", "\n"), -1)).alias("needle"))
    return docs.select("doc_id", F.size("needle").alias("n_needle"), F.array_join(A.find_sublist("needle", "h"), ",").alias("positions"))


SQL_SUBLIST_MATCHES = """
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda t: t <> '') AS h,
                  list_filter(regexp_split_to_array(lower(string_split(text, chr(10))[-1]), '\\s+'), lambda t: t <> '') AS needle
           FROM documents)
SELECT doc_id, CAST(len(needle) AS INTEGER) AS n_needle,
       array_to_string(list_filter(range(greatest(len(h) - len(needle) + 1, 0)), lambda i: h[i + 1: i + len(needle)] = needle), ',') AS positions
FROM d
"""


def decoded_ids(spark: SparkSession, sf: str) -> DataFrame:
    """The encoded benchmark rows (J4 + T1, uncut) turned back into token text."""
    b = read_table(spark, sf, "benchmark").select("item_id", _words(F.col("text")).alias("w"))
    vocab = _vocab(spark, sf)
    ids = TK.token_ids(b, "w", vocab, "item_id")
    enc = ids.select("item_id", TK.encode("ids", None).alias("input_ids"))
    return TK.ids_to_text(enc, "input_ids", vocab, "item_id").select("item_id", "text")


SQL_DECODED_IDS = "WITH " + _SQL_VOCAB + """,
bt AS (SELECT item_id, unnest(w) AS token, generate_subscripts(w, 1) - 1 AS pos
       FROM (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda t: t <> '') AS w FROM benchmark)),
dec AS (SELECT b.item_id, list(coalesce(v.token, '[UNK]') ORDER BY b.pos) AS toks
        FROM bt b LEFT JOIN vocab v ON v.token = b.token GROUP BY b.item_id)
SELECT bm.item_id, array_to_string(list_concat(['[CLS]'], coalesce(dec.toks, []), ['[SEP]']), ' ') AS text
FROM benchmark bm LEFT JOIN dec ON dec.item_id = bm.item_id
"""


def subtoken_spans(spark: SparkSession, sf: str) -> DataFrame:
    """T7 + T8: words cut into 3-character pieces (a rule-based stand-in for
    sub-tokens); first piece of each word, word of each piece, and the word
    span (1, 3) mapped to pieces and back."""
    b = read_table(spark, sf, "benchmark").select("item_id", _words(F.col("text")).alias("w"))
    pieces = F.transform("w", lambda t: F.transform(
        F.sequence(F.lit(0), (F.ceil(F.length(t) / 3) - 1).cast("int")), lambda i: F.substring(t, i * 3 + 1, 3)))
    b = b.withColumn("sub", pieces).withColumn("ix", TK.subtoken_index("sub"))
    span = F.array(F.struct(F.lit(1).alias("st"), F.lit(3).alias("ed")))
    b = b.withColumn("sp", F.when(F.size("w") > 3, TK.map_spans(span, "ix.word_start")))
    b = b.withColumn("back", F.when(F.size("w") > 3, TK.map_spans("sp", None, "ix.word_of", to_sub=False)))
    return b.select("item_id", F.array_join("ix.word_start", ",").alias("word_start"),
                    F.array_join("ix.word_of", ",").alias("word_of"),
                    F.concat_ws("-", F.element_at("sp", 1).st.cast("string"), F.element_at("sp", 1).ed.cast("string"))
                    .alias("sub_span"),
                    F.concat_ws("-", F.element_at("back", 1).st.cast("string"),
                                F.element_at("back", 1).ed.cast("string")).alias("word_span"))


SQL_SUBTOKEN_SPANS = """
WITH b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda t: t <> '') AS w FROM benchmark),
c AS (SELECT item_id, w, list_transform(w, lambda t: CAST(ceil(length(t) / 3) AS BIGINT)) AS cnt FROM b),
ix AS (SELECT item_id, w, list_transform(range(len(cnt)), lambda i: CAST(coalesce(list_sum(cnt[1:i]), 0) AS BIGINT)) AS ws,
              flatten(list_transform(range(len(cnt)), lambda i: list_transform(range(cnt[i + 1]), lambda x: i))) AS wo
       FROM c)
SELECT item_id, array_to_string(ws, ',') AS word_start, array_to_string(wo, ',') AS word_of,
       CASE WHEN len(w) > 3 THEN CAST(ws[2] AS VARCHAR) || '-' || CAST(ws[4] AS VARCHAR) ELSE '' END AS sub_span,
       CASE WHEN len(w) > 3 THEN CAST(wo[ws[2] + 1] AS VARCHAR) || '-' || CAST(wo[ws[4] + 1] AS VARCHAR) ELSE '' END
         AS word_span
FROM ix
"""


QUERIES = {"subword_tokens": subword_tokens, "decoded_ids": decoded_ids, "subtoken_spans": subtoken_spans, "vocab_build": vocab_build, "token_id_rows": token_id_rows, "qa_windows": qa_windows,
           "segments": segments, "sublist_matches": sublist_matches}
ORACLE = {"subword_tokens": SQL_SUBWORD_TOKENS, "decoded_ids": SQL_DECODED_IDS, "subtoken_spans": SQL_SUBTOKEN_SPANS, "vocab_build": SQL_VOCAB_BUILD, "token_id_rows": SQL_TOKEN_ID_ROWS, "qa_windows": SQL_QA_WINDOWS,
          "segments": SQL_SEGMENTS, "sublist_matches": SQL_SUBLIST_MATCHES}
