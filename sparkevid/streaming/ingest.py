"""Live ingestion: new documents become chunks, postings and additive statistics; feedback is an append-only log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as T
from ..operators import index
from ..sources import corpus
from ..sources.exports import vote

DOCUMENT = "doc_id bigint, text string"


def chunks(documents: DataFrame) -> DataFrame:
    """chunk_id, doc_id, text of windows of 500 words that overlap by 50."""
    w = documents.select("doc_id", T.space_words(F.col("text")).alias("words"))
    w = w.select("doc_id", F.explode(T.word_windows(F.col("words"), 500, 50)).alias("w"))
    return w.select(F.xxhash64("doc_id", "w.start_word").alias("chunk_id"), "doc_id", "w.text")


def write_batch(root: str):
    """A foreachBatch sink: each batch goes to folders of its own id, replaced as a whole when a batch is run again."""

    def write(batch: DataFrame, batch_id: int) -> None:
        c = chunks(batch).persist()
        try:
            posted = index.postings(c)
            for name, df in (("chunks", c), ("postings", posted), ("stats", index.term_stats(posted))):
                df.write.mode("overwrite").parquet(f"{root}/{name}/batch={batch_id}")
        finally:
            c.unpersist()

    return write


def accept(requested: DataFrame, root: str, batch_id: int) -> DataFrame:
    """Ingest a batch of requests (doc_id, text): those that are in order become a batch of their own; returns all with their error."""
    checked = corpus.requests(requested).persist()
    write_batch(root)(checked.where("error is null").select("doc_id", "text"), batch_id)
    return checked


def ingested(spark: SparkSession, root: str) -> DataFrame:
    """chunk_id, text, runtime of all batches, as retrieval takes them."""
    return spark.read.parquet(f"{root}/chunks").select("chunk_id", "text", F.lit(True).alias("runtime"))


def start(spark: SparkSession, source: str, root: str, checkpoint: str) -> StreamingQuery:
    """Ingest Parquet files that arrive in ``source`` until what is there is done; run again for more, or with another trigger."""
    stream = spark.readStream.schema(DOCUMENT).parquet(source)
    return stream.writeStream.foreachBatch(write_batch(root)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def statistics(spark: SparkSession, root: str) -> DataFrame:
    """term, df over all batches."""
    return spark.read.parquet(f"{root}/stats").groupBy("term").agg(F.sum("df").alias("df"))


def feedback_log(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream of feedback rows; votes outside -1, 0 and 1 count as 0."""
    return rows.withColumn("vote", vote(F.col("vote"))).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
