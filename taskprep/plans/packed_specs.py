"""Registered queries over packed inputs: one question an ``orders`` row.

The gold spec of ``spec_eval`` is asked in words: ``show <column>`` and, for each
condition, ``with <column> near <value> ( <col> )``, where the value is the four
words after ``near``, written ``v12 (3)`` in the question. Question and headers
are cut into pieces of three characters; the vocabulary's words are its tokens.

The pointer list of a spec is damaged by ``qid % 7``: 1 loses the first
condition's operator, 2 ends after the first value's start, 3 loses the
aggregate, 4 names the next operator too, 5 points at ``[CLS]``, past the end
and at a value outside any condition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taskprep.operators import packed as PK
from taskprep.operators import tokens as TK
from taskprep.plans.spec_eval import _SQL_PAIRS, HEADERS, pairs

PIECE = 3
PER_COND = 7


def _pieces(words) -> F.Column:
    return F.transform(words, lambda t: F.transform(F.sequence(F.lit(0), (F.ceil(F.length(t) / PIECE) - 1).cast("int")), lambda i: F.substring(t, i * PIECE + 1, PIECE)))


def questions(spark: SparkSession, sf: str) -> DataFrame:
    """qid, g (gold spec), header, words, question, word_start, word_of, and the packed input."""
    header = F.array(*[F.lit(h) for h in HEADERS])
    named = lambda i: F.get(F.col("header"), i)
    conds = F.transform("g.conds", lambda c: F.array(F.lit("with"), named(c.col), F.lit("near"), c.val, F.lit("("), c.col.cast("string"), F.lit(")")))
    said = F.transform("g.conds", lambda c: F.concat(F.lit(" with "), named(c.col), F.lit(" near "), c.val, F.lit(" ("), c.col.cast("string"), F.lit(")")))
    q = pairs(spark, sf).select("qid", "g").withColumn("header", header)
    q = q.withColumn("words", F.concat(F.array(F.lit("show"), named(F.col("g.sel"))), F.flatten(conds)))
    q = q.withColumn("question", F.concat(F.lit("show "), named(F.col("g.sel")), F.array_join(said, "")))
    # the cut words and the packed input are computed once a row, behind a generator
    q = q.withColumn("cut", F.explode(F.array(_pieces("words")))).withColumn("ix", F.explode(F.array(TK.subtoken_index("cut"))))
    q = q.withColumn("packed", F.explode(F.array(PK.pack_input(F.flatten("cut"), _pieces("header"), [m.split(" ") for m in PK.VOCABULARY]))))
    return q.select("qid", "g", "header", "words", "question", "ix.word_start", "ix.word_of", "packed.*")


def packed_inputs(spark: SparkSession, sf: str) -> DataFrame:
    """T9 + J7: tokens, segment ids, and the member that holds each position."""
    at = PK.locate_all(F.sequence(F.lit(0), F.size("tokens") - 1), "borders")
    return questions(spark, sf).select(
        "qid", F.md5(F.array_join("tokens", " ")).alias("tokens_md5"), F.array_join("segment_ids", "").alias("segment_ids"),
        F.md5(F.array_join(F.transform(at, lambda x: F.concat_ws(":", x.group, x.member)), ",")).alias("members_md5"))


def _damaged(p, qid, size) -> F.Column:
    """The pointer list as ``qid % 7`` leaves it."""
    gone = lambda i: F.concat(F.slice(p, F.lit(1), F.lit(i)), F.slice(p, F.lit(i + 2), F.size(p)))
    op = F.get(p, F.lit(6))
    q0 = F.get(F.filter("borders", lambda b: b["group"] == PK.QUESTION_GROUP), F.lit(0))["st"]
    other = F.get(F.col("borders"), PK.FIRST_OP + (F.get(F.col("g.conds"), F.lit(0)).op + 1) % 3)["st"]
    stray = F.array(F.lit(0), q0, q0 + 1, F.size("tokens"), F.lit(-1))
    m = qid % 7
    return (F.when((m == 1) & (size > 0), gone(6)).when((m == 2) & (size > 0), F.slice(p, 1, 8)).when(m == 3, gone(2))
            .when((m == 4) & (size > 0), F.concat(F.slice(p, 1, 7), F.array(other), F.slice(p, F.lit(8), F.size(p))))
            .when(m == 5, F.concat(F.slice(p, 1, 4), stray, F.slice(p, F.lit(5), F.size(p)))).otherwise(p))


def packed_pointers(spark: SparkSession, sf: str) -> DataFrame:
    """T13 + J7 + T14 + T8 + P15: the gold spec's positions, damaged for most rows, where they lie, and the spec and query text read back."""
    q = questions(spark, sf)
    first = lambda i: 5 + PER_COND * i
    spans = F.transform("g.conds", lambda c, i: F.struct(c.col.alias("col"), c.op.alias("op"), F.get(F.col("word_start"), first(i)).alias("st"), F.get(F.col("word_start"), first(i) + 3).alias("ed")))
    spec = F.struct(F.col("g.sel").alias("sel"), F.col("g.agg").alias("agg"), spans.alias("conds"))
    q = q.withColumn("whole", F.explode(F.array(PK.spec_positions(spec, "borders"))))
    q = q.withColumn("points", F.explode(F.array(_damaged(F.col("whole"), F.col("qid"), F.size("g.conds")))))
    q = q.withColumn("back", F.explode(F.array(PK.specs_from_positions("points", "tokens", "borders", "header", "words", "word_of", "question"))))
    at = PK.locate_all("points", "borders")
    return q.select("qid", F.array_join("points", ",").alias("points"), F.array_join(F.transform(at, lambda x: F.concat_ws(":", x.group, x.member)), ",").alias("members"),
                    F.col("back.sel").alias("sel"), F.col("back.agg").alias("agg"),
                    F.array_join(F.transform("back.conds", lambda c: F.concat_ws("|", c.col, c.op, c.val)), ";").alias("conds"), F.col("back.query").alias("query"))


_VOCAB = "['" + "', '".join(PK.VOCABULARY) + "']"
_HEADERS = "['" + "', '".join(HEADERS) + "']"
#: every token of every packed input with its member; a member's place is a running count of tokens
_SQL_TOKENS = "WITH " + _SQL_PAIRS.rsplit("fl AS", 1)[0].rstrip().rstrip(",") + f""",
wd AS (SELECT qid, g_conds, ['show', {_HEADERS}[g_sel + 1]] || flatten(list_transform(g_conds, lambda c: ['with', {_HEADERS}[c.col + 1], 'near', c.val, '(', CAST(c.col AS VARCHAR), ')'])) AS words FROM pr),
mem AS (
  SELECT qid, 0 AS grp, m - 1 AS member, string_split({_VOCAB}[m], ' ') AS cut, m = len({_VOCAB}) AS last FROM wd, range(1, len({_VOCAB}) + 1) t(m)
  UNION ALL SELECT qid, 1, 0, flatten(list_transform(words, lambda w: regexp_extract_all(w, '.{{1,{PIECE}}}'))), FALSE FROM wd
  UNION ALL SELECT qid, 2, m - 1, regexp_extract_all({_HEADERS}[m], '.{{1,{PIECE}}}'), m = len({_HEADERS}) FROM wd, range(1, len({_HEADERS}) + 1) t(m)),
tk AS (
  SELECT qid, -1 AS grp, -1 AS member, -1 AS k, '[CLS]' AS tok, 0 AS seg FROM wd
  UNION ALL SELECT qid, grp, member, unnest(range(len(cut))), unnest(cut), CAST(grp <> 1 AS INTEGER) FROM mem
  UNION ALL SELECT qid, grp, member, len(cut), '[SEP]', CAST(last AS INTEGER) FROM mem),
pos AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY grp, member, k) - 1 AS p,
               lead(CASE WHEN grp = 0 THEN seg ELSE 0 END, 1, 0) OVER (PARTITION BY qid ORDER BY grp, member, k) AS early FROM tk)"""

SQL_PACKED_INPUTS = _SQL_TOKENS + """
SELECT qid, md5(string_agg(tok, ' ' ORDER BY p)) AS tokens_md5,
       string_agg(CASE WHEN grp < 1 THEN early ELSE seg END, '' ORDER BY p) AS segment_ids,
       md5(string_agg(CASE WHEN tok IN ('[CLS]', '[SEP]') THEN '-1:-1' ELSE grp || ':' || member END, ',' ORDER BY p)) AS members_md5
FROM pos GROUP BY qid
"""

#: a spec's parts as rows: the member pointed at, the place in it and what is written for it; damage adds and removes rows
SQL_PACKED_POINTERS = _SQL_TOKENS + f""",
st AS (SELECT qid, grp, member, min(p) AS st, max(p) AS sep FROM pos WHERE grp >= 0 GROUP BY qid, grp, member),
total AS (SELECT qid, max(p) + 1 AS size FROM pos GROUP BY qid),
cuts AS (SELECT qid, i, sum(n) OVER (PARTITION BY qid ORDER BY i) - n AS ws
         FROM (SELECT qid, unnest(range(len(words))) AS i, unnest(list_transform(words, lambda w: (length(w) + {PIECE} - 1) // {PIECE})) AS n FROM wd)),
cd AS (SELECT qid, unnest(range(len(g_conds))) AS i, unnest(g_conds) AS c FROM pr),
parts AS (
  SELECT qid, 0.0 AS ord, 0 AS grp, 12 AS member, 0 AS off, NULL AS txt FROM pr
  UNION ALL SELECT qid, 1, 0, 6, 0, 'select' FROM pr
  UNION ALL SELECT qid, 2, 0, g_agg, 0, NULL FROM pr WHERE qid % 7 <> 3
  UNION ALL SELECT qid, 3, 2, g_sel, 0, CASE WHEN qid % 7 = 3 THEN {_HEADERS}[g_sel + 1] ELSE '(' || {_HEADERS}[g_sel + 1] || ')' END FROM pr
  UNION ALL SELECT qid, 3.1, -1, 0, 0, NULL FROM pr WHERE qid % 7 = 5
  UNION ALL SELECT qid, 3.2, 1, 0, 0, NULL FROM pr WHERE qid % 7 = 5
  UNION ALL SELECT qid, 3.3, 1, 0, 1, 'show' FROM pr WHERE qid % 7 = 5
  UNION ALL SELECT qid, 3.4, -2, 0, 0, NULL FROM pr WHERE qid % 7 = 5
  UNION ALL SELECT qid, 3.5, -3, 0, 0, NULL FROM pr WHERE qid % 7 = 5
  UNION ALL SELECT qid, 10 + 10 * i, 0, CASE WHEN i = 0 THEN 7 ELSE 8 END, 0, CASE WHEN i = 0 THEN 'where' ELSE 'and' END FROM cd
  UNION ALL SELECT qid, 11 + 10 * i, 2, c.col, 0, {_HEADERS}[c.col + 1] FROM cd
  UNION ALL SELECT qid, 12 + 10 * i, 0, 9 + c.op, 0, ['=', '>', '<'][c.op + 1] FROM cd WHERE NOT (qid % 7 = 1 AND i = 0)
  UNION ALL SELECT qid, 12.5, 0, 9 + (c.op + 1) % 3, 0, ['=', '>', '<'][(c.op + 1) % 3 + 1] FROM cd WHERE qid % 7 = 4 AND i = 0
  UNION ALL SELECT qid, 13 + 10 * cd.i, 1, 0, ws, NULL FROM cd JOIN cuts USING (qid) WHERE cuts.i = 5 + {PER_COND} * cd.i
  UNION ALL SELECT qid, 14 + 10 * i, 1, 0, ws, c.val || ' (' || c.col || ')' FROM (SELECT cd.qid, cd.i, cd.c, cuts.ws FROM cd JOIN cuts ON cuts.qid = cd.qid AND cuts.i = 8 + {PER_COND} * cd.i)
  UNION ALL SELECT qid, 1000, 0, 13, 0, NULL FROM pr),
kept AS (SELECT * FROM parts WHERE NOT (qid % 7 = 2 AND ord > 13 AND qid IN (SELECT qid FROM cd))),
pts AS (SELECT k.qid, k.ord, k.txt, CASE k.grp WHEN -1 THEN 0 WHEN -2 THEN t.size WHEN -3 THEN -1 ELSE s.st + k.off END AS p
        FROM kept k JOIN total t ON t.qid = k.qid LEFT JOIN st s ON s.qid = k.qid AND s.grp = k.grp AND s.member = k.member),
loc AS (SELECT pts.*, s.grp, s.member FROM pts LEFT JOIN st s ON s.qid = pts.qid AND s.st <= pts.p AND pts.p < s.sep),
list AS (SELECT qid, string_agg(CAST(p AS VARCHAR), ',' ORDER BY ord) AS points, string_agg(coalesce(grp, -1) || ':' || coalesce(member, -1), ',' ORDER BY ord) AS members,
                string_agg(txt, ' ' ORDER BY ord) AS query FROM loc GROUP BY qid),
cl AS (SELECT qid, string_agg(c.col || '|' || c.op || '|' || c.val || ' (' || c.col || ')', ';' ORDER BY i) AS conds
       FROM cd WHERE qid % 7 <> 2 AND NOT (qid % 7 = 1 AND i = 0) GROUP BY qid)
SELECT pr.qid, points, members, CASE WHEN pr.qid % 7 <> 3 THEN g_sel END AS sel, CASE WHEN pr.qid % 7 <> 3 THEN g_agg END AS agg,
       coalesce(conds, '') AS conds, query
FROM pr JOIN list ON list.qid = pr.qid LEFT JOIN cl ON cl.qid = pr.qid
"""

QUERIES = {"packed_inputs": packed_inputs, "packed_pointers": packed_pointers}
ORACLE = {"packed_inputs": SQL_PACKED_INPUTS, "packed_pointers": SQL_PACKED_POINTERS}
