"""Katz backoff bigram model: Good-Turing discounts, exactly normalised backoff, scored in Spark.

Model. The vocabulary holds every word of the training texts; others are of the
class <unk>. (With a ``VOCAB_SHARE`` above 0 words of a smaller share of all
training tokens are of that class too, and are drawn from it by their add-one
share among the rare words; no query does so.) With C(h) the training count of a history (a word, <unk>
or the start of a text), c the count of a bigram and d_r the Good-Turing
discount of a count r <= ``CUT`` (1 above):

    p(w | h) = d_c c / (C(h) + 1)      where the bigram was seen
             = alpha(h) p1(w)          elsewhere (p1: discounted unigrams)
    alpha(h) = (1 - sum of seen p(w | h)) / (1 - sum of their p1(w))

The 1 beside C(h) is one unseen event a history, so that mass is left also
where no count is small; both levels sum to 1 exactly.

How it runs. Unigrams are counted with map-side sums. Bigrams of the ``DENSE``
most frequent words are counted in one small matrix a task and scored from the
matrix, so they never travel. Every other (bigram, document) pair is shuffled
by bigram once; a group is at most 1 / DENSE of all tokens. A sorted stream a
partition counts each bigram and gives documents the logarithm of the count
and the count's class; discounts, known only when all bigrams are counted,
enter by class sums at the end, as do backoff weights for unseen bigrams. Tasks
hold the most frequent words, at most ``HELD``. The others travel in the same
stream, under keys of their own; bigrams with one of them travel by word hashes,
to the second word where that is one (its rows then give its count too), else
to the first, and the weights of such histories stay in Spark. Tables are written
as they are made: unigrams, dense counts, and the sums by document and history.

Defined cases: a null text is empty and is scored as its end token alone; a
null id counts as the empty text for the fold; repeated rows are counted each
and get equal results; without training rows every word is unseen and the
model knows <unk> and the end, at one half each; an empty table gives no
rows; other columns are ignored; texts are whole, however long.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from taskprep.llm import arrow_text as at
from taskprep.llm.langid import held_out
from taskprep.session import cut_lineage, read_table

VOCAB_SHARE, DENSE, CUT = 0.0, 1000, 5
#: words that every task holds, the most frequent ones
HELD = 1 << 18
#: class numbers before the vocabulary's words; START is a history only
UNK, END, START, WORDS = 0, 1, 2, 3
SHIFT = 21
TABLE = at.byte_values(at.WHITE)
#: rows that a task gathers before it sums them
FLUSH = 2_000_000
#: tokens (or bigrams) by their count, 1 .. CUT + 1
KINDS = [f"m{r}" for r in range(1, CUT + 2)]
#: keys of rare words in the stream of bigrams
RARE = 1 << 62
#: END and START among word hashes
END_HASH, START_HASH = 1, 2


def runs(keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys starts."""
    return np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)


def unigrams(docs: DataFrame) -> DataFrame:
    """(w, c): training counts of words by hash, summed in the task first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(parts: list[np.ndarray]) -> pa.RecordBatch:
            w, c = np.unique(np.concatenate(parts), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(c)], ["w", "c"])

        parts, n = [], 0
        for _, buf, offs in at.chunks(batches, "text"):
            parts.append(at.find_words(buf, offs, TABLE)[0])
            if (n := n + len(parts[-1])) >= FLUSH:
                yield out(parts)
                parts, n = [], 0
        if n:
            yield out(parts)

    return docs.filter("NOT held_out").select("text").mapInArrow(run, "w long, c long").groupBy("w").agg(F.sum("c").alias("c"))


def good_turing(n: list[int]) -> np.ndarray:
    """Discounts of counts 0 .. CUT + 1 (the last 1) from counts of counts 1 .. CUT + 1; (r - 1/2) / r where those give none in (0, 1)."""
    d = np.ones(CUT + 2)
    for r in range(1, CUT + 1):
        x = 0.0
        if n[0] and n[r - 1]:
            rest = (CUT + 1) * n[CUT] / n[0]
            x = ((r + 1) * n[r] / (r * n[r - 1]) - rest) / (1 - rest) if rest < 1 else 0.0
        d[r] = x if 0 < x < 1 else (r - 0.5) / r
    return d


class Vocabulary:
    """What every task needs: at most ``HELD`` words (1 / VOCAB_SHARE where that is above 0).

    With ``unk``, the probability of unseen words, the words that are not held
    are of the vocabulary too: their bigrams travel by hashes.
    """

    def __init__(self, words: np.ndarray, counts: np.ndarray, n_docs: int, rare: int, rare_types: int, n: int, d: np.ndarray, unk: float | None = None):
        self.by_hash = unk is not None
        self.n_docs, self.rare, self.rare_types = n_docs, rare, rare_types
        order = np.argsort(words)
        self.words, c = words[order], counts[order]
        self.count = np.concatenate(([rare, n_docs, n_docs], c)).astype(np.float64)  # C as history; END is none
        p1 = d[np.minimum(self.count, CUT + 1).astype(int)] * self.count / (n + 1)
        p1[END] = p1[END] if n_docs else 0.5
        p1[UNK] = p1[START] = 0
        p1[UNK] = unk if self.by_hash else 1 - p1.sum()  # the rare and the unseen words, and what the discounts leave
        self.p1 = p1
        top = np.argsort(-c, kind="stable")[: DENSE - WORDS] + WORDS
        self.dense = np.concatenate(([END, START] if self.by_hash else [UNK, END, START], top)).astype(np.int64)
        self.slot = np.full(len(self.count), -1, np.int32)  # place in the dense matrix
        self.slot[self.dense] = np.arange(len(self.dense))

    def classes(self, h: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.full(len(h), UNK, np.int64)
        i = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        return np.where(self.words[i] == h, i + WORDS, UNK).astype(np.int64)


def bigrams(h: np.ndarray, first: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """History and word class of every token of a chunk, its document, and the words' classes."""
    w = v.classes(h)
    n = np.diff(first)
    ends = np.cumsum(n + 1) - 1
    cur = np.empty(len(h) + len(n), np.int64)
    cur[ends] = END
    inner = np.ones(len(cur), bool)
    inner[ends] = False
    cur[inner] = w
    prev = np.empty_like(cur)
    prev[1:] = cur[:-1]
    prev[ends - n] = START
    return prev, cur, np.repeat(np.arange(len(n)), n + 1), w


def dense_counts(docs: DataFrame, vocab) -> np.ndarray:
    """Training counts of bigrams among the most frequent words: a matrix of at most DENSE squared cells."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocab.value
        m = len(v.dense)
        cells = np.zeros(m * m, np.int64)
        for _, buf, offs in at.chunks(batches, "text"):
            h, _, _, first = at.find_words(buf, offs, TABLE)
            prev, cur, _, _ = bigrams(h, first, v)
            a, b = v.slot[prev].astype(np.int64), v.slot[cur].astype(np.int64)
            cells += np.bincount((a * m + b)[(a >= 0) & (b >= 0)], minlength=m * m)
        i = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(cells[i])], ["cell", "c"])

    m = len(vocab.value.dense)
    out = np.zeros(m * m, np.int64)
    counts = docs.filter("NOT held_out").select("text").mapInArrow(run, "cell long, c long").groupBy("cell").agg(F.sum("c").alias("c"))
    got = cut_lineage(counts).toArrow()  # at most DENSE squared rows
    out[got["cell"].to_numpy()] = got["c"].to_numpy()
    return out


def pairs(key: np.ndarray, doc: np.ndarray, nd: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (key, document) of a chunk and how often each occurs, sorted by (key, document)."""
    order = np.lexsort((doc, key))
    k, o = key[order], doc[order]
    new = np.union1d(runs(k), runs(o)) if len(k) else runs(k)
    return k[new], o[new], np.diff(np.append(new, len(k)))


def logs(v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """log10 (C + 1) and log10 p1 by class."""
    with np.errstate(divide="ignore"):
        return np.log10(v.count + 1), np.log10(v.p1)


def document_terms(docs: DataFrame, vocab, dense) -> DataFrame:
    """What a task knows of its documents: kind 0, a row a document; kind 3, unseen dense bigrams by history and document.

    ``words``, ``known`` and ``base`` count vocabulary words; ``val`` sums
    -log10 (C(h) + 1) of all tokens and the log10 counts of dense bigrams,
    whose classes are in m1.. For kind 3 ``val`` takes the first back and puts
    log10 p1 in; ``cnt`` weighs the backoff weight to come.
    """
    names = ["kind", "key", "dk", "cnt", "known", "base", "val", *KINDS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, cells = vocab.value, dense.value
        log_c, log_p1 = logs(v)
        m = len(v.dense)
        for part, buf, offs in at.chunks(batches, "text"):
            h, _, _, first = at.find_words(buf, offs, TABLE)
            prev, cur, doc, _ = bigrams(h, first, v)
            nd, dk = part.num_rows, part.column("dk").to_numpy()
            sums = lambda mask, w=None: np.bincount(doc[mask], None if w is None else w[mask], minlength=nd)
            a, b = v.slot[prev].astype(np.int64), v.slot[cur].astype(np.int64)
            hot = (a >= 0) & (b >= 0)
            c = np.zeros(len(cur), np.int64)
            c[hot] = cells[a[hot] * m + b[hot]]
            val = -log_c[prev]
            val[c > 0] += np.log10(c[c > 0])
            known = (cur >= WORDS) | ((cur == END) & (v.n_docs > 0))
            zeros = np.zeros(nd, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (zeros.astype(np.int32), zeros, dk, np.diff(first), sums(known), sums(known, log_c[cur]).astype(float), np.bincount(doc, val, minlength=nd), *(sums(c == r) for r in range(1, CUT + 2)))], names)
            lost = hot & (c == 0)
            if lost.any():
                order = np.lexsort((doc[lost], prev[lost]))
                k, o, x = prev[lost][order], doc[lost][order], (log_c[prev] + log_p1[cur])[lost][order]
                new = runs(k * nd + o)
                zeros = np.zeros(len(new), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(y) for y in (np.full(len(new), 3, np.int32), k[new], dk[o[new]], np.diff(np.append(new, len(k))), zeros, zeros.astype(float), np.add.reduceat(x, new), *[zeros] * (CUT + 1))], names)

    return docs.select("dk", "text").mapInArrow(run, TERMS)


TERMS = "kind int, key long, dk long, cnt long, known long, base double, val double, " + ", ".join(f"{m} long" for m in KINDS)


def travelling_pairs(docs: DataFrame, vocab) -> DataFrame:
    """(key, dk, cnt): bigrams outside the dense matrix, and rare words, by document; cnt < 0: held out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocab.value
        for part, buf, offs in at.chunks(batches, "text"):
            h, _, _, first = at.find_words(buf, offs, TABLE)
            prev, cur, doc, w = bigrams(h, first, v)
            nd, dk = part.num_rows, part.column("dk").to_numpy()
            held = part.column("held_out").to_numpy(zero_copy_only=False)
            far = (v.slot[prev] < 0) | (v.slot[cur] < 0)
            if v.by_hash:
                far &= (prev != UNK) & (cur != UNK)
            rare = w == UNK
            word = (h[rare] >> at.U64(2)).view(np.int64) | np.int64(RARE)
            for key, d in ((prev[far] << SHIFT | cur[far], doc[far]), (word, np.repeat(np.arange(nd), np.diff(first))[rare])):
                key, d, n = pairs(key, d, nd)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(dk[d]), pa.array(np.where(held[d], -n, n))], ["key", "dk", "cnt"])

    return docs.select("dk", "held_out", "text").mapInArrow(run, "key long, dk long, cnt long")


def counted(rows: DataFrame, vocab) -> DataFrame:
    """Counts every travelling key over the sorted stream of its partition, and sums what follows from the counts.

    kind 0: by document, from seen bigrams and from rare words; kind 3: unseen
    bigrams by history and document; kind 5: by history, how many seen bigrams
    have count r <= CUT + 1, the sum of the counts above (``cnt``) and of the
    p1 of all (``val``). A key's rows are buffered whole: at most 1 / DENSE of
    the tokens.
    """
    names = ["kind", "key", "dk", "cnt", "known", "base", "val", *KINDS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocab.value
        log_c, log_p1 = logs(v)
        ones: list[tuple] = []  # (dk, n, count, rare) of rows that give to documents
        types: list[tuple] = []  # (history, word, count) of seen bigrams
        gathered = 0

        def batch_of(kind: int, key, dk, cnt, known, base, val, kinds) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int32)), *map(pa.array, (key, dk, cnt, known, base, val, *kinds))], names)

        def flush() -> Iterator[pa.RecordBatch]:
            if ones:
                dk, n, c, rare = (np.concatenate(x) for x in zip(*ones))
                order = np.argsort(dk, kind="stable")
                dk, n, c, rare = dk[order], n[order], c[order], rare[order]
                new = runs(dk)
                zeros = np.zeros(len(new), np.int64)
                add = lambda x: np.add.reduceat(x, new)
                # a word that is not held is a history once an occurrence; one of a class is drawn from it
                own = -np.log10(c + 1) if v.by_hash else np.log10((c + 1) / (v.rare + v.rare_types + 1))
                val = n * np.where(rare, own, np.log10(np.maximum(c, 1)))
                yield batch_of(0, zeros, dk[new], zeros, add(np.where(rare & (c > 0), n, 0)), add(np.where(rare, n * np.log10(c + 1), 0.0)), add(val),
                               [add(np.where(~rare & (c == r), n, 0)) for r in range(1, CUT + 2)])
            if types:
                hist, word, c = (np.concatenate(x) for x in zip(*types))
                order = np.argsort(hist, kind="stable")
                hist, word, c = hist[order], word[order], c[order]
                new = runs(hist)
                zeros = np.zeros(len(new), np.int64)
                add = lambda x: np.add.reduceat(x, new)
                yield batch_of(5, hist[new], zeros, add(np.where(c > CUT + 1, c, 0)), zeros, zeros.astype(float), add(v.p1[word]),
                               [add((c == r).astype(np.int64)) for r in range(1, CUT + 2)])
            ones.clear()
            types.clear()

        def take(key: np.ndarray, dk: np.ndarray, cnt: np.ndarray) -> Iterator[pa.RecordBatch]:
            start = runs(key)
            c = np.add.reduceat(np.maximum(cnt, 0), start)
            each, n = np.repeat(c, np.diff(np.append(start, len(key)))), np.abs(cnt)
            rare = key >= RARE
            give = rare | (each > 0)
            ones.append((dk[give], n[give], each[give], rare[give]))
            s = start[(c > 0) & ~rare[start]]
            if len(s):
                types.append((key[s] >> SHIFT, key[s] & ((1 << SHIFT) - 1), each[s]))
            if not give.all():
                hist, word, lost = key[~give] >> SHIFT, key[~give] & ((1 << SHIFT) - 1), n[~give]
                zeros = np.zeros(len(lost), np.int64)
                yield batch_of(3, hist, dk[~give], lost, zeros, zeros.astype(float), lost * (log_c[hist] + log_p1[word]), [zeros] * (CUT + 1))

        wait: list[tuple] = []
        waiting = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            wait.append(tuple(batch.column(x).to_numpy() for x in ("key", "dk", "cnt")))
            waiting += batch.num_rows
            if waiting < FLUSH // 8 or wait[-1][0][-1] == wait[0][0][0]:
                continue
            key, dk, cnt = (np.concatenate(x) for x in zip(*wait))
            cut = int(np.searchsorted(key, key[-1]))
            yield from take(key[:cut], dk[:cut], cnt[:cut])
            wait, waiting = [(key[cut:], dk[cut:], cnt[cut:])], len(key) - cut
            if (gathered := gathered + cut) >= FLUSH:
                yield from flush()
                gathered = 0
        if waiting:
            yield from take(*(np.concatenate(x) for x in zip(*wait)))
        yield from flush()

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, TERMS)


def hashed_pairs(docs: DataFrame, vocab) -> DataFrame:
    """(h, w, p, dk, cnt): every bigram with a word that is not held, by hashes; p: log10 p1 of a held second word, else null; cnt: 1, -1 if held out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocab.value
        _, log_p1 = logs(v)
        for part, buf, offs in at.chunks(batches, "text"):
            h, _, _, first = at.find_words(buf, offs, TABLE)
            prev, cur, doc, _ = bigrams(h, first, v)
            word = np.full(len(cur), END_HASH, np.int64)
            word[cur != END] = h.view(np.int64)
            hist = np.full(len(cur), START_HASH, np.int64)
            hist[1:][prev[1:] != START] = word[:-1][prev[1:] != START]
            far = (prev == UNK) | (cur == UNK)
            doc, cur = doc[far], cur[far]
            n = np.where(part.column("held_out").to_numpy(zero_copy_only=False)[doc], -1, 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(hist[far]), pa.array(word[far]), pa.array(log_p1[cur], mask=cur == UNK), pa.array(part.column("dk").to_numpy()[doc]), pa.array(n)], ["h", "w", "p", "dk", "cnt"])

    return docs.select("dk", "held_out", "text").mapInArrow(run, "h long, w long, p double, dk long, cnt long")


def counted_hashes(rows: DataFrame, n: int, d1: np.ndarray, unk: float) -> DataFrame:
    """(h, p, dk, n, c, first) of ``hashed_pairs``: n in the document, c in training, p the log10 p1 of the second word; ``first`` on one row a bigram.

    Rows meet at a word that is not held: the second one if it is (its training
    rows add up to its own count), else the first."""
    gain = F.greatest("cnt", F.lit(0))
    second = F.col("p").isNull()
    rows = rows.withColumns({"second": second, "k": F.when(second, F.col("w")).otherwise(F.col("h"))}).repartition("k")
    pair, word = Window.partitionBy("k", "second", "h", "w"), Window.partitionBy("k", "second")
    both = rows.withColumn("first", F.row_number().over(pair.orderBy("dk")) == 1).withColumn("c", F.sum(gain).over(pair)).withColumn("wc", F.sum(gain).over(word))
    low = F.element_at(F.array(*[F.lit(float(x)) for x in d1]), F.least(F.col("wc"), F.lit(CUT + 1)).cast("int") + 1)
    p1 = F.when(F.col("wc") > 0, F.log10(low * F.col("wc") / F.lit(float(n + 1)))).otherwise(F.lit(math.log10(unk)))
    return both.select("h", F.when(second, p1).otherwise(F.col("p")).alias("p"), "dk", F.abs("cnt").alias("n"), "c", "first")


def hashed_terms(hashed: DataFrame, hist_sums: DataFrame, hot: DataFrame, v: Vocabulary, alpha: np.ndarray, d: np.ndarray) -> DataFrame:
    """Rows of kind 0 with what the bigrams by hashes give to documents: their counts, or log10 of alpha(h) p1(w), -log10 (C(h) + 1) taken back."""
    spark = hashed.sparkSession
    used = (F.col("large") + sum((F.col(k) * float(d[r] * r) for r, k in enumerate(KINDS, 1)), F.lit(0.0))) / (F.col("all") + 1)
    weight = F.when(F.col("p1") < 1 - 1e-12, F.log10((1 - used) / (1 - F.col("p1")))).otherwise(0.0)
    own = hist_sums.join(hot, "h", "left_anti").select("h", (weight + F.log10(F.col("all") + 1)).alias("back"))
    log_c, _ = logs(v)
    held = pa.table({"h": np.concatenate(([START_HASH], v.words.view(np.int64))).astype(np.int64), "back": (alpha + log_c)[np.concatenate(([START], np.arange(WORDS, len(alpha)))).astype(np.int64)]})
    lost = hashed.filter("c = 0").join(own.union(spark.createDataFrame(held)), "h", "left")  # a history that training never saw has weight 1
    zero = F.lit(0).cast("long")
    lost = lost.select("dk", (F.col("n") * (F.col("p") + F.coalesce("back", F.lit(0.0)))).alias("val"), *(zero.alias(k) for k in KINDS))
    seen = hashed.filter("c > 0").select("dk", (F.col("n") * F.log10("c")).alias("val"), *(F.when(F.col("c") == r, F.col("n")).otherwise(zero).alias(k) for r, k in enumerate(KINDS, 1)))
    out = seen.union(lost).groupBy("dk").agg(*(F.sum(x).alias(x) for x in ("val", *KINDS)))
    return out.select(F.lit(0).alias("kind"), zero.alias("key"), "dk", zero.alias("cnt"), zero.alias("known"), F.lit(0.0).alias("base"), "val", *KINDS)


def score_texts(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", folds: int = 7, fold: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; learns from rows outside the fold."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    docs = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), held_out(doc_id, folds, fold).alias("held_out"))
    docs = docs.withColumn("dk", F.xxhash64("id", "text", F.col("id").isNull()))
    uni = cut_lineage(unigrams(docs))
    n_docs = docs.filter("NOT held_out").count()
    tot = uni.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v"), *(F.sum((F.col("c") == r).cast("long")).alias(f"n{r}") for r in range(1, CUT + 2))).first()
    n = (tot.n or 0) + n_docs
    size = tot.v + (n_docs > 0)
    d1 = good_turing([tot[f"n{r}"] or 0 for r in range(1, CUT + 2)])
    if VOCAB_SHARE > 0:
        least, unk = max(1, math.ceil(n * VOCAB_SHARE)), None
    else:
        # the least power of two that at most HELD words reach
        reach = uni.agg(*(F.sum((F.col("c") >= 1 << k).cast("long")).alias(f"k{k}") for k in range(63))).first()
        least = next(1 << k for k in range(63) if (reach[k] or 0) <= HELD)
        small = [tot[f"n{r}"] or 0 for r in range(1, CUT + 1)]
        end = d1[min(n_docs, CUT + 1)] * n_docs / (n + 1) if n_docs else 0.5
        lower = sum((1 - d1[r]) * r * x for r, x in enumerate(small, 1))
        unk = 1 - end - ((tot.n or 0) - lower) / (n + 1)
    vocab_rows = uni.filter(F.col("c") >= least).toArrow()  # at most HELD (1 / VOCAB_SHARE) rows
    words, counts = vocab_rows["w"].to_numpy().view(np.uint64), vocab_rows["c"].to_numpy()
    rare, rare_types = (0, 0) if unk is not None else (int((tot.n or 0) - counts.sum()), tot.v - len(words))
    v = Vocabulary(words, counts, n_docs, rare, rare_types, n, d1, unk)
    vocab = sc.broadcast(v)
    cells = dense_counts(docs, vocab)
    adds = [F.sum(x).alias(x) for x in ("cnt", "known", "base", "val", *KINDS)]
    terms = cut_lineage(document_terms(docs, vocab, sc.broadcast(cells)))
    sums = cut_lineage(counted(travelling_pairs(docs, vocab), vocab).groupBy("kind", "key", "dk").agg(*adds))

    hashed = hist_sums = hot = None
    if v.by_hash:
        hashed = cut_lineage(counted_hashes(hashed_pairs(docs, vocab), n, d1, unk))
        c, r = F.col("c"), range(1, CUT + 2)
        hist_sums = cut_lineage(hashed.filter("first AND c > 0").groupBy("h").agg(
            F.sum("c").alias("all"), F.sum(F.when(c > CUT + 1, c).otherwise(0)).alias("large"), F.sum(F.pow(F.lit(10.0), "p")).alias("p1"),
            *(F.sum((c == x).cast("long")).alias(k) for x, k in zip(r, KINDS))))
        hot = F.broadcast(spark.createDataFrame(pa.table({"h": np.concatenate(([START_HASH], v.words.view(np.int64))).astype(np.int64)})))

    # held histories: at most one row a held word
    hist = sums.filter("kind = 5").select("key", "cnt", "val", *KINDS).toArrow()
    key = hist["key"].to_numpy()
    seen_p1, large, by_r = np.zeros(len(v.count)), np.zeros(len(v.count)), np.zeros((len(v.count), CUT + 2))
    seen_p1[key], large[key] = hist["val"].to_numpy(), hist["cnt"].to_numpy()
    square = cells.reshape(len(v.dense), len(v.dense))
    seen_p1[v.dense] += (square > 0) @ v.p1[v.dense]
    large[v.dense] += np.where(square > CUT + 1, square, 0).sum(1)
    for r, k in enumerate(KINDS, 1):
        by_r[key, r] = hist[k].to_numpy()
        by_r[v.dense, r] += (square == r).sum(1)
    kinds = by_r.sum(0)[1:]
    if v.by_hash:
        more = hist_sums.join(hot, "h", "left_semi").toArrow()
        word = more["h"].to_numpy()
        at_ = np.where(word == START_HASH, START, v.classes(word.view(np.uint64)))
        seen_p1[at_] += more["p1"].to_numpy()
        large[at_] += more["large"].to_numpy()
        for r, k in enumerate(KINDS, 1):
            by_r[at_, r] += more[k].to_numpy()
        every = hist_sums.agg(*(F.sum(k).alias(k) for k in KINDS)).first()
        kinds = kinds + np.array([every[k] or 0 for k in KINDS])
    d = good_turing([int(x) for x in kinds])
    used = (large + by_r @ (d * np.arange(CUT + 2))) / (v.count + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        alpha = np.where(seen_p1 < 1 - 1e-12, np.log10((1 - used) / (1 - seen_p1)), 0.0)
    alphas = spark.createDataFrame(pa.table({"key": np.arange(len(alpha)), "alpha": alpha}))

    both = terms.unionByName(sums.select(*terms.columns))
    if v.by_hash:
        both = both.unionByName(hashed_terms(hashed, hist_sums, hot, v, alpha, d).select(*terms.columns))
    lost = both.filter("kind = 3").join(alphas, "key").withColumn("val", F.col("val") + F.col("cnt") * F.col("alpha"))
    lost = lost.select("dk", F.lit(0).cast("long").alias("cnt"), "known", "base", "val", *KINDS)
    total = both.filter("kind = 0").select(*lost.columns).union(lost).groupBy("dk").agg(*adds)
    discount = sum((F.col(k) * float(math.log10(d[r])) for r, k in enumerate(KINDS, 1)), F.lit(0.0))
    # rows of one id and text are counted each, so a document's sums are shared equally among them
    keyed = docs.groupBy("dk").agg(F.count(F.lit(1)).alias("copies"))
    total = total.join(keyed, "dk").select(
        "dk", *((F.col(x) / F.col("copies")).alias(x) for x in ("cnt", "known", "base")), ((F.col("val") + discount) / F.col("copies")).alias("val"))
    out = docs.select("id", "held_out", "dk").join(total, "dk")
    n_tokens = F.col("cnt").cast("long") + 1
    return out.select(F.col("id").alias(doc_id), "held_out", n_tokens.alias("n_tokens"), F.col("known").cast("long").alias("n_known"),
                      F.lit(n).cast("long").alias("train_tokens"),
                      (F.col("base") - n_tokens * F.lit(math.log10(n + size + 1))).alias("base_score"), F.col("val").alias("score"))


def op8_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(read_table(spark, sf_dir, "documents"))
