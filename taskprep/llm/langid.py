"""Language identification: multinomial logistic regression on TF-IDF character n-grams.

Letters are lower-cased, every run of other characters is one space, and the
1- to 3-grams of the result are hashed into ``FEATURES`` columns. Document
frequencies are counted over all labelled rows. The regression itself is
fitted on a bounded sample of them: ``SAMPLE`` rows, shared equally by the
languages and taken in hash order. It is trained with follow-the-regularised-
leader (proximal, per coordinate) under an elastic net, so most weights are
exactly 0, and a temperature is fitted on a fifth of the sample that the
weights have not seen. Model and statistics have at most ``FEATURES`` rows.

Defined cases: a null text, or one without a letter, is ``und`` with score 0,
as is every text when no labelled row exists; rows without a label teach
nothing; a row without id counts as held out; repeated rows get equal results;
an empty table gives no rows; whole texts are read, however long; only the
text enters a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from taskprep.session import cut_lineage, read_table

FEATURES, ORDERS = 1 << 15, 3
SAMPLE, EPOCHS = 4000, 2
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.05, 0.05


@cache
def letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def features(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """Hashed n-gram numbers and their counts; None without a letter."""
    if not text:
        return None
    c = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    alpha = letters()[c]
    if not alpha.any():
        return None
    c = np.where(alpha, c, np.uint32(32))
    keep = alpha.copy()
    keep[1:] |= alpha[:-1]  # of a run of others, the first
    c = np.concatenate(([32], c[keep], [32])).astype(np.uint64)
    counts, h = np.zeros(FEATURES, np.int64), c
    for n in range(1, ORDERS + 1):
        if n > 1:
            h = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + c[n - 1 :]
        x = (h + np.uint64(n)) * np.uint64(0xD6E8FEB86659FD93)
        counts += np.bincount((x >> np.uint64(49)).astype(np.int64), minlength=FEATURES)
    idx = np.flatnonzero(counts)
    return idx, counts[idx]


def document_frequencies(rows: DataFrame) -> tuple[np.ndarray, int]:
    """How many labelled rows hold each feature, and how many there are; at most FEATURES + 1 rows reach the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(FEATURES + 1, np.int64)
        for batch in batches:
            for text in batch.column("text"):
                if (f := features(text.as_py())) is not None:
                    df[f[0]] += 1
                    df[FEATURES] += 1
        idx = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(idx, pa.int32()), pa.array(df[idx], pa.int64())], ["f", "df"])

    out = np.zeros(FEATURES + 1, np.int64)
    for r in rows.select("text").mapInArrow(run, "f int, df long").groupBy("f").agg(F.sum("df").alias("df")).toLocalIterator():
        out[r.f] = r.df
    return out[:FEATURES], int(out[FEATURES])


def tf_idf(f: tuple[np.ndarray, np.ndarray], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = (1 + np.log(f[1])) * idf[f[0]]
    return f[0], x / max(np.sqrt((x * x).sum()), 1e-12)


def softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def train(rows: list[tuple[np.ndarray, np.ndarray, int, bool]], k: int) -> tuple[np.ndarray, float]:
    """Weights (features x classes) and temperature from (index, value, class, calibrates) rows."""
    z, n = np.zeros((FEATURES, k)), np.zeros((FEATURES, k))
    learn = [r for r in rows if not r[3]] or rows
    for _ in range(EPOCHS):
        for idx, x, y, _c in learn:
            w = weights(z[idx], n[idx])
            g = softmax(x @ w)
            g[y] -= 1
            g = x[:, None] * g
            sigma = (np.sqrt(n[idx] + g * g) - np.sqrt(n[idx])) / ALPHA
            z[idx] += g - sigma * w
            n[idx] += g * g
    w = weights(z, n)
    held = [r for r in rows if r[3]] or rows
    scores, ys = np.array([x @ w[idx] for idx, x, _y, _c in held]), np.array([r[2] for r in held])
    grid = np.exp(np.linspace(np.log(0.02), np.log(20), 200))
    # targets a little inside (0, 1), so that a sample without a mistake doesn't ask for certainty
    target = np.full(scores.shape, 1 / (len(ys) + 2) / max(k - 1, 1))
    target[np.arange(len(ys)), ys] = (len(ys) + 1) / (len(ys) + 2)
    loss = [-(target * np.log(np.maximum(softmax(scores / t), 1e-12))).sum(1).mean() for t in grid]
    return w, float(grid[int(np.argmin(loss))])


def fit(labelled: DataFrame, sample: int = SAMPLE) -> dict | None:
    """The model: languages, idf, weights, temperature. ``labelled`` has key, text and lang."""
    langs = [r[0] for r in labelled.groupBy("lang").count().orderBy("lang").select("lang").collect()]  # one row a language
    if not langs:
        return None
    df, n = document_frequencies(labelled)
    idf = np.log((1 + n) / (1 + df)) + 1
    order = Window.partitionBy("lang").orderBy(F.xxhash64("key"), "key")
    picked = cut_lineage(labelled.select("key", "lang").withColumn("r", F.row_number().over(order)).filter(F.col("r") <= max(1, sample // len(langs))).select("key"))
    rows = labelled.join(picked.distinct(), "key").select("key", "text", "lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = []
        for batch in batches:
            for key, text, lang in zip(*(batch.column(c).to_pylist() for c in ("key", "text", "lang"))):
                if (f := features(text)) is not None:
                    got.append((key, *tf_idf(f, idf), langs.index(lang)))
        got.sort(key=lambda r: (r[0], r[3]))
        order = np.random.default_rng(0).permutation(len(got))
        w, t = train([(*got[i][1:], bool(i % 5 == 4)) for i in order], len(langs)) if got else (np.zeros((FEATURES, len(langs))), 1.0)
        idx = np.flatnonzero(w.any(1))
        yield pa.RecordBatch.from_arrays([pa.array([t]), pa.array([idx.tolist()], pa.list_(pa.int32())), pa.array([w[idx].ravel().tolist()], pa.list_(pa.float64()))], ["t", "idx", "w"])

    # at most ``sample`` rows meet in this one task
    row = rows.repartition(1).mapInArrow(run, "t double, idx array<int>, w array<double>").collect()[0]
    w = np.zeros((FEATURES, len(langs)))
    w[row.idx] = np.array(row.w).reshape(len(row.idx), len(langs))
    return {"langs": langs, "idf": idf, "w": w, "t": row.t}


def predict(docs: DataFrame, model: dict | None) -> DataFrame:
    """``docs`` (whose text column is ``text``) keep their other columns, with lang_pred and score."""
    keep = [c for c in docs.columns if c != "text"]
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema.fields if f.name != "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pred, score = [], []
            for text in batch.column("text"):
                f = features(text.as_py()) if model else None
                if f is None:
                    pred.append("und")
                    score.append(0.0)
                    continue
                idx, x = tf_idf(f, model["idf"])
                p = softmax(x @ model["w"][idx] / model["t"])
                pred.append(model["langs"][int(p.argmax())])
                score.append(float(min(1.0, p.max())))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(pred, pa.string()), pa.array(score, pa.float64())], [*keep, "lang_pred", "score"])

    return docs.mapInArrow(run, f"{kinds}lang_pred string, score double")


def held_out(doc_id: str | Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text falls into the fold; a null id counts as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit(""))) % folds == fold


def identify_languages(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", folds: int = 5, fold: int = 0, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row; learns from labelled rows outside the fold."""
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang"), held_out(doc_id, folds, fold).alias("held_out"))
    learn = rows.filter("NOT held_out AND lang IS NOT NULL AND text IS NOT NULL").select(F.xxhash64("id", "text").alias("key"), "text", "lang")
    return predict(rows.select("id", "held_out", "text"), fit(learn, sample)).withColumnRenamed("id", doc_id)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(read_table(spark, sf_dir, "documents"))
