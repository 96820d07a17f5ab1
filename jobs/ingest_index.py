"""Keep a searchable index of a growing folder of documents.

    python jobs/ingest_index.py --config jobs/ingest_index.json [--source DIR --target DIR --checkpoint DIR]

A file stream takes the Parquet files that are new in a folder or glob since the last run (doc_id, text), cuts the documents into overlapping word windows and
writes each batch of files as chunks, postings, block maxima and term statistics, partitioned by batch and term bucket. The stream's
checkpoint holds what has been taken. A batch that is run again after a failure replaces its own folders; a run without new files changes
nothing. Documents without an id or a word go to ``rejected`` with a reason. A document that comes again is indexed again.
"""

from __future__ import annotations

import argparse
import json
import logging
import os
import sys

if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkevid.functions import text as T
from sparkevid.operators import inverted

LOG = logging.getLogger("jobs.ingest_index")
DOCUMENT = "doc_id bigint, text string"
#: Documents whose windows share a block of the index.
DOCS = 16


def windows(documents: DataFrame, size: int, overlap: int) -> DataFrame:
    """chunk_id, block, doc_id, start_word, text of the windows of each document."""
    w = documents.select("doc_id", T.space_words(F.col("text")).alias("words"))  # split once a document, not once a window
    w = w.select("doc_id", F.explode(T.word_windows(F.col("words"), size, overlap)).alias("w"))
    start = F.col("w.start_word").cast("long")
    return w.select(F.xxhash64("doc_id", start).alias("chunk_id"), F.floor(F.col("doc_id") / DOCS).alias("block"), "doc_id", start.alias("start_word"), "w.text")


def rejected(documents: DataFrame) -> DataFrame:
    reason = F.when(F.col("doc_id").isNull(), "no id").when(F.size(F.coalesce(T.space_words(F.col("text")), F.array())) == 0, "no words")
    return documents.select("doc_id", "text", reason.alias("reason")).where("reason is not null")


def run(spark: SparkSession, source: str, target: str, checkpoint: str, size: int = 500, overlap: int = 50, max_files: int = 64) -> dict[str, int]:
    """Take what is new in ``source``; returns the batches, documents, chunks and rejected documents of this run."""
    done = {"batches": 0, "documents": 0, "chunks": 0, "rejected": 0}

    def write(batch: DataFrame, number: int) -> None:
        bad = f"{target}/rejected/batch={number}"
        rejected(batch).write.mode("overwrite").parquet(bad)
        good = batch.where(F.col("doc_id").isNotNull())
        inverted.write_batch(windows(good, size, overlap), target, number)
        counts = {
            "documents": batch.count(),
            "chunks": spark.read.parquet(f"{target}/sizes/batch={number}").first()[0],
            "rejected": spark.read.schema("reason string").parquet(bad).count(),
        }
        LOG.info("batch %d: read %d documents, wrote %d chunks to %s, rejected %d", number, counts["documents"], counts["chunks"], target, counts["rejected"])
        done["batches"] += 1
        for k, v in counts.items():
            done[k] += v

    LOG.info("reading new files of %s", source)
    stream = spark.readStream.schema(DOCUMENT).option("maxFilesPerTrigger", max_files).parquet(source)
    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    LOG.info("run ended: %s", done)
    return done


def postings(spark: SparkSession, target: str) -> DataFrame:
    """doc_id, start_word, term, tf: the whole index as it stands."""
    found = inverted.Index(spark, target)
    ids = found.table("chunks").select("chunk_id", "doc_id", "start_word", "batch")
    return found.table("postings").join(ids, ["batch", "chunk_id"]).select("doc_id", "start_word", "term", "tf")


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    parser.add_argument("--config", required=True)
    for name in ("source", "target", "checkpoint"):
        parser.add_argument(f"--{name}")
    given = vars(parser.parse_args(argv))
    with open(given.pop("config"), encoding="utf-8") as f:
        settings = json.load(f) | {k: v for k, v in given.items() if v}
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(levelname)s %(name)s: %(message)s")
    spark = SparkSession.builder.appName("ingest_index").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        run(spark, **settings)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
