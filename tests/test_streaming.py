import tempfile

from tests.conftest import SF


def test_stateless_cleaning_on_a_stream(spark):
    from taskprep.streaming.clean_stream import cleaned_stream

    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "documents.parquet").parquet(SF)
    q = (cleaned_stream(stream, "text").writeStream.format("memory").queryName("clean_docs")
         .option("checkpointLocation", tempfile.mkdtemp(prefix="stream-ckpt-", dir="/tmp")).start())
    q.processAllAvailable()
    q.stop()
    from taskprep.operators.clean import prepare_text
    batch = prepare_text(spark.read.parquet(f"{SF}/documents.parquet"), "text")
    assert spark.sql("SELECT count(*) FROM clean_docs").collect()[0][0] == batch.count()
