"""Sources (S1-S9): review CSVs, label<TAB>text lines, configurable CSV splits,
nested QA JSON, question/table JSON lines, prediction maps, vocabularies.

Every reader declares its schema (no inference) so a scan is one pass and
columns can be pruned.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taskprep.functions.text import strip_unicode
from taskprep.sources.splittable import JsonElements, JsonMembers, QuotedLines, read_records

# Column layout of each review corpus (headerless CSV).
REVIEW_COLUMNS = {
    "yelp": ["labels", "content"],
    "amazon": ["labels", "title", "content"],
    "dbpedia": ["labels", "title", "content"],
    "agnews": ["labels", "title", "content"],
    "yahoo": ["labels", "title", "content", "answer"],
}
# Number of classes of each corpus.
NUM_CLASSES = {"yelp": 5, "yahoo": 10, "amazon": 5, "agnews": 4, "dbpedia": 14}


def read_reviews(spark: SparkSession, path: str, corpus: str) -> DataFrame:
    """Headerless review CSV, columns named by position for the corpus. A
    field may hold line ends; a large file is still read by many tasks."""
    fields = ", ".join(f"{c} {'int' if c == 'labels' else 'string'}" for c in REVIEW_COLUMNS[corpus])
    rows = read_records(spark, path, QuotedLines())
    return rows.select(F.from_csv("record", fields, {"quote": '"', "escape": '"'}).alias("r")).select("r.*")


def read_labelled_lines(spark: SparkSession, path: str) -> DataFrame:
    """``label<TAB>text`` lines; undecodable bytes dropped. The text is the
    second field alone and keeps its line end only where it is the last field."""
    raw = spark.read.text(path, wholetext=False)
    parts = F.split(F.regexp_replace("value", "�", ""), "\t")
    second = F.get(parts, F.lit(1))
    return raw.select(F.get(parts, F.lit(0)).try_cast("int").alias("label"),
                      F.when(F.size(parts) == 2, F.concat(second, F.lit("\n"))).otherwise(second).alias("text"))


BAD_ROWS = {"keep": "PERMISSIVE", "skip": "DROPMALFORMED", "error": "FAILFAST"}


def read_csv_splits(spark: SparkSession, files: Mapping[str, str | Sequence[str]], sep: str = ",",
                    quote: str = '"', na_values: Sequence[str] | None = None, header: bool = True,
                    schema: T.StructType | str | None = None, names: Sequence[str] | None = None,
                    decimal: str = ".", skip: int = 0, bad_rows: str = "keep") -> DataFrame:
    """S3: configurable CSV per named split (``train``/``validation``/``test``),
    one DataFrame with a ``split`` column. Chunking is Spark's file splits.

    ``names`` names the columns of files without a header, or in place of theirs.
    ``decimal`` is the decimal sign of number columns. ``skip`` leaves out the first
    records of each file, ahead of its header; it needs a ``schema``. Rows that do
    not fit the schema are kept with nulls, skipped, or an error."""
    want = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    numbers = [f.name for f in want or [] if isinstance(f.dataType, T.FractionalType)] if decimal != "." else []
    read_as = T.StructType([T.StructField(f.name, T.StringType() if f.name in numbers else f.dataType) for f in want]) if want else None
    if skip and want is None:
        raise ValueError("skip needs a schema")
    out = None
    for split, paths in files.items():
        paths = list(paths) if not isinstance(paths, str) else [paths]
        if skip:
            df = _skipped(spark, paths, read_as, skip + bool(header), {"sep": sep, "quote": quote}, bad_rows)
        else:
            r = spark.read.option("header", header).option("sep", sep).option("quote", quote).option("mode", BAD_ROWS[bad_rows])
            df = (r.schema(read_as) if read_as else r.option("inferSchema", True)).csv(paths)
        for c in numbers:
            df = df.withColumn(c, F.replace(c, F.lit(decimal), F.lit(".")).cast(want[c].dataType))
        if names is not None:
            df = df.toDF(*names)
        if na_values:
            for c in df.columns:
                df = df.withColumn(c, F.when(F.col(c).cast("string").isin(*na_values), None).otherwise(F.col(c)))
        df = df.withColumn("split", F.lit(split))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def _skipped(spark: SparkSession, paths: Sequence[str], schema: T.StructType, skip: int, options: dict[str, str], bad_rows: str) -> DataFrame:
    """The rows of CSV files without the first ``skip`` records of each."""
    records = read_records(spark, paths, QuotedLines())
    place = F.row_number().over(Window.partitionBy("file").orderBy("block", "n"))
    # the first records of a file lie in the first splits that hold any: only their heads are ranked
    heads = records.filter(F.col("n") < skip).withColumn("place", place).filter(F.col("place") <= skip).select("file", "block", "n")
    rest = records.join(heads, ["file", "block", "n"], "left_anti")
    bad = "__bad"
    held = T.StructType([*schema.fields, T.StructField(bad, T.StringType())])
    mode = {"mode": "FAILFAST"} if bad_rows == "error" else {"columnNameOfCorruptRecord": bad}
    parsed = rest.select(F.from_csv("record", (schema if bad_rows == "error" else held).toDDL(), {**options, **mode}).alias("r")).select("r.*")
    if bad_rows == "error":
        return parsed
    return (parsed.filter(F.col(bad).isNull()) if bad_rows == "skip" else parsed).drop(bad)


QA_SCHEMA = T.StructType([
    T.StructField("version", T.StringType()),
    T.StructField("data", T.ArrayType(T.StructType([
        T.StructField("title", T.StringType()),
        T.StructField("paragraphs", T.ArrayType(T.StructType([
            T.StructField("context", T.StringType()),
            T.StructField("qas", T.ArrayType(T.StructType([
                T.StructField("id", T.StringType()),
                T.StructField("question", T.StringType()),
                T.StructField("answers", T.ArrayType(T.StructType([
                    T.StructField("text", T.StringType()), T.StructField("answer_start", T.IntegerType())]))),
            ]))),
        ]))),
    ]))),
])


def flatten_qa(nested: DataFrame) -> DataFrame:
    """S4 + P4: article -> paragraph -> question rows; title defaults to "";
    strings stripped of Unicode whitespace; answers as parallel arrays."""
    a = nested.select(F.explode("data").alias("a"))
    p = a.select(F.col("a.title").alias("title"), F.explode("a.paragraphs").alias("p"))
    q = p.select("title", F.col("p.context").alias("context"), F.explode("p.qas").alias("q"))
    return q.select(
        F.col("q.id").alias("id"), strip_unicode(F.coalesce("title", F.lit(""))).alias("title"),
        strip_unicode("context").alias("context"), strip_unicode("q.question").alias("question"),
        F.struct(F.transform("q.answers", lambda x: strip_unicode(x.text)).alias("text"),
                 F.transform("q.answers", lambda x: x.answer_start).alias("answer_start")).alias("answers"))


def read_qa_json(spark: SparkSession, path: str) -> DataFrame:
    """Nested QA JSON file(s) -> flat example rows. A file is one document;
    its articles are read by as many tasks as it has splits."""
    return flatten_qa(_articles(spark, path))


def _articles(spark: SparkSession, path: str) -> DataFrame:
    """One row an article, in the shape that ``flatten_qa`` takes."""
    article = QA_SCHEMA["data"].dataType
    data = F.from_json(F.concat(F.lit("["), F.col("record"), F.lit("]")), article)
    return read_records(spark, path, JsonElements()).select(data.alias("data"))


QUESTION_SCHEMA = T.StructType([
    T.StructField("table_id", T.StringType()), T.StructField("question", T.StringType()),
    T.StructField("question_tok", T.ArrayType(T.StringType())), T.StructField("query", T.StringType()),
    T.StructField("query_tok", T.ArrayType(T.StringType())),
    T.StructField("sql", T.StructType([T.StructField("sel", T.IntegerType()), T.StructField("agg", T.IntegerType()),
                                       T.StructField("conds", T.ArrayType(T.ArrayType(T.StringType())))])),
    T.StructField("wvi_corenlp", T.ArrayType(T.ArrayType(T.IntegerType()))),
])
TABLE_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("header", T.ArrayType(T.StringType())),
    T.StructField("header_tok", T.ArrayType(T.ArrayType(T.StringType()))),
    T.StructField("types", T.ArrayType(T.StringType())),
    T.StructField("rows", T.ArrayType(T.ArrayType(T.StringType()))),
])


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Question JSON lines; the mixed ``[col, op, value]`` condition arrays
    are read as strings and typed into structs (a condition that lacks a part
    or a number keeps its row, with nulls in place); ``pos`` orders the rows as
    they stand in the files: by file name, block and line."""
    q = spark.read.schema(QUESTION_SCHEMA).json(path)
    conds = F.transform("sql.conds", lambda c: F.struct(
        F.get(c, F.lit(0)).try_cast("int").alias("col"), F.get(c, F.lit(1)).try_cast("int").alias("op"),
        F.get(c, F.lit(2)).alias("val")))
    q = q.withColumn("sql", F.struct(F.col("sql.sel").alias("sel"), F.col("sql.agg").alias("agg"), conds.alias("conds")))
    # an ordering key: the running number only compares lines of one block
    return q.withColumn("pos", F.struct(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                                        F.monotonically_increasing_id().alias("line")))


def read_tables(spark: SparkSession, path: str) -> DataFrame:
    """Table JSON lines (id, header, types, rows)."""
    return spark.read.schema(TABLE_SCHEMA).json(path)


def read_question_set(spark: SparkSession, folder: str, mode: str = "train", augmented: bool = False, header_tokens: bool = True,
                      toy: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The questions and tables of one part of a question folder.

    Files are named ``[aug.]<mode>_tok.jsonl`` and ``[aug.]<mode>[_tok].tables.jsonl``;
    the tables with tokenised headers are taken unless ``header_tokens`` is off.
    ``toy`` keeps the first questions and as many tables."""
    part = f"aug.{mode}" if augmented else mode
    questions = read_questions(spark, f"{folder}/{part}_tok.jsonl")
    tables = read_tables(spark, f"{folder}/{part}{'_tok' if header_tokens else ''}.tables.jsonl")
    if toy is not None:
        questions = questions.orderBy("pos").limit(toy)
        tables = tables.withColumn("__at", F.struct(F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))).orderBy("__at").limit(toy).drop("__at")
    return questions, tables


def read_train_dev(spark: SparkSession, folder: str, augmented: bool = False, header_tokens: bool = True, toy: int | None = None):
    """(train questions, train tables, dev questions, dev tables); only the training part has an augmented form."""
    return (*read_question_set(spark, folder, "train", augmented, header_tokens, toy), *read_question_set(spark, folder, "dev", False, header_tokens, toy))


def read_predictions(spark: SparkSession, dataset_path: str, predictions_path: str,
                     expected_version: str = "1.1") -> tuple[DataFrame, DataFrame, bool]:
    """Prediction map (one JSON object id -> text) and the dataset; returns
    (examples, predictions, version_ok)."""
    # what stands before and after the articles holds the other members of the document
    parts = read_records(spark, dataset_path, JsonElements())
    around = parts.select(F.coalesce("before", F.when(F.get_json_object("record", "$.paragraphs").isNull(), F.col("record"))).alias("t"))
    said = F.regexp_extract("t", r'"version"\s*:\s*"([^"]*)"', 1)
    version_ok = around.filter(F.col("t").isNotNull() & (said != "") & (said != expected_version)).isEmpty()
    members = read_records(spark, predictions_path, JsonMembers())
    one = F.from_json(F.concat(F.lit("{"), F.col("record"), F.lit("}")), "map<string,string>")
    return read_qa_json(spark, dataset_path), members.select(F.explode(one).alias("id", "prediction_text")), version_ok


def load_splits(spark: SparkSession, files: Mapping[str, str]) -> DataFrame:
    """Dataset by file extension (csv or json only), one DataFrame with ``split``."""
    out = None
    for split, path in files.items():
        ext = path.rsplit(".", 1)[-1].lower()
        if ext == "csv":
            df = spark.read.option("header", True).option("inferSchema", True).csv(path)
        elif ext in ("json", "jsonl"):
            df = spark.read.json(path)
        else:
            raise ValueError(f"unsupported file type: {path}")
        df = df.withColumn("split", F.lit(split))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def read_vocab(spark: SparkSession, vocab_path: str, embedding_path: str | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Vocabulary (token, id) and embedding (id, vec) tables.

    Both are parquet, or in the format they are published in: the vocabulary one
    JSON object token -> id, read by as many tasks as it has splits, the
    embedding a matrix file (``.npy``, up to 2 GB as Spark's binary reader takes) whose row i
    is the vector of id i."""
    if vocab_path.endswith(".json"):
        one = F.from_json(F.concat(F.lit("{"), F.col("record"), F.lit("}")), "map<string,int>")
        vocab = read_records(spark, vocab_path, JsonMembers()).select(F.explode(one).alias("token", "id"))
    else:
        vocab = spark.read.parquet(vocab_path)
    if embedding_path and embedding_path.endswith(".npy"):
        raw = spark.read.format("binaryFile").load(embedding_path).select("content")
        emb = raw.mapInArrow(_matrix_rows, "id int, vec array<float>")
    else:
        emb = spark.read.parquet(embedding_path) if embedding_path else None
    return vocab, emb


def _matrix_rows(batches):
    import io

    import numpy as np
    import pyarrow as pa
    for batch in batches:
        for content in batch.column("content"):
            m = np.load(io.BytesIO(memoryview(content.as_buffer())), allow_pickle=False).astype(np.float32)
            for i in range(0, len(m), 1024):
                part = m[i : i + 1024]
                offs = pa.array(np.arange(len(part) + 1, dtype=np.int32) * m.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(i, i + len(part), dtype=np.int32)), pa.ListArray.from_arrays(offs, pa.array(part.reshape(-1)))], ["id", "vec"])


def read_cells(spark: SparkSession, path: str, table_ids: Sequence[str] | None = None,
               n_buckets: int = 256) -> DataFrame:
    """Read a stored cell catalog; with ``table_ids`` only their hash buckets
    are listed and read (the bucket of a literal id folds to a constant, so
    the filter prunes partitions)."""
    cells = spark.read.parquet(path)
    if table_ids:
        buckets = [F.pmod(F.xxhash64(F.lit(t)), F.lit(n_buckets)).cast("int") for t in table_ids]
        cells = cells.filter(F.col("table_bucket").isin(*buckets) & F.col("table_id").isin(*table_ids))
    return cells.drop("table_bucket")
