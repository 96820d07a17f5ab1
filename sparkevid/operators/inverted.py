"""A stored inverted index that retrieval reads: partitioned Parquet tables, added to batch by batch.

    chunks/batch=b               chunk_id, block, text and what else the chunks have
    segments/batch=b/bucket=t    term, df, most, hits (chunk_id, block, tf): a term's postings in some megabytes of chunks, and the largest tf
    terms/batch=b/bucket=t       term, df, most of the batch; document frequencies of batches add
    sizes/batch=b                chunks: the number of chunks of the batch

``Index.table`` gives the hits as rows, too: ``postings`` (term, chunk_id, block, tf) and ``blocks`` (term, block, n, most: postings of a block,
and the largest tf among them). They are not stored as rows, of which millions a batch would be sorted, nor twice: most blocks hold a term once.

A term's bucket is a hash of the term, so a search reads the buckets of the asked terms only, and files are sorted by term, so
row groups without these terms are skipped. A batch's folders are replaced as a whole when it is written again.

``search`` is exact: the k-th best score over a question's rarest terms bounds the k-th best score from below; the sum of a block's
maxima bounds the scores of its chunks from above. Postings of blocks that can't reach the bound are not scored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import small, spread, stored, top
from . import index
from .ranking import TF_CAP

#: Of a new index; one of many terabytes takes some thousands. All batches of an index, and its readers, use the same number.
BUCKETS = 16
#: Ids of chunks, or of documents, that share a block.
BLOCK = 64
#: Asked terms up to which they are named in the filter of the scan; beyond, a join alone finds them.
NAMED = 1000
#: Scores are compared after rounding to six places.
MARGIN = 1e-5
TABLES = ("chunks", "segments", "terms", "sizes")
#: Bytes of text whose postings make a segment, at least a chunk: some ten times as many are in memory.
SEGMENT = 8 << 20
SEGMENTS = "term string, df long, most int, hits array<struct<chunk_id: long, block: long, tf: int>>"


def bucket_of(term: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def blocks_of(chunks: DataFrame) -> DataFrame:
    """Chunks with their block; ``block`` may be given where neighbouring chunk ids mean nothing."""
    return chunks if "block" in chunks.columns else chunks.withColumn("block", F.floor(F.col("chunk_id") / BLOCK))


def segments(chunks: DataFrame, size: int = SEGMENT) -> DataFrame:
    """The postings of chunks (chunk_id, block, text) by SEGMENTS. Tokens are those of ``text.tokens``; a chunk is one row."""

    def count(batches):
        import numpy as np
        import pyarrow as pa

        inside = np.isin(np.arange(256), np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789'", np.uint8))
        ends = lambda starts, n: np.append(starts, n).astype(np.int32)

        def segment(ids, blocks, texts, at):
            """``texts``: bytes; ``at``: where each chunk's begin, and their end."""
            own = inside[texts]
            before = np.concatenate([[False], own[:-1]])
            before[at[:-1][at[:-1] < len(own)]] = False
            first = np.flatnonzero(own & ~before)
            if not len(first):
                return None
            length = np.diff(np.append(np.cumsum(own, dtype=np.int32)[first] - 1, np.count_nonzero(own)))
            words = pa.Array.from_buffers(pa.string(), len(first), [None, pa.py_buffer(ends(np.cumsum(length) - length, length.sum())), pa.py_buffer(texts[own])])
            words = words.dictionary_encode()
            chunk = np.repeat(np.arange(len(ids)), np.diff(np.searchsorted(first, at)))
            pair, tf = np.unique(words.indices.to_numpy().astype(np.int64) * len(ids) + chunk, return_counts=True)
            term, chunk, tf = pair // len(ids), pair % len(ids), tf.astype(np.int32)
            of_term = np.flatnonzero(np.append(True, term[1:] != term[:-1]))
            hits = pa.StructArray.from_arrays([ids.take(pa.array(chunk)), blocks.take(pa.array(chunk)), pa.array(tf)], ["chunk_id", "block", "tf"])
            columns = {
                "term": words.dictionary.take(pa.array(term[of_term])),
                "df": np.diff(ends(of_term, len(tf))).astype(np.int64),
                "most": np.maximum.reduceat(tf, of_term),
                "hits": pa.ListArray.from_arrays(ends(of_term, len(tf)), hits),
            }
            return pa.RecordBatch.from_pydict(columns)

        for rows in batches:
            ids, blocks, text = rows.column("chunk_id"), rows.column("block"), rows.column("text").cast(pa.large_binary())
            at = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
            data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
            lo = 0
            while lo < len(text):
                hi = max(lo + 1, int(np.searchsorted(at, at[lo] + size, "right")) - 1)
                made = segment(ids.slice(lo, hi - lo), blocks.slice(lo, hi - lo), data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
                if made is not None:
                    yield made
                lo = hi

    rows = chunks.select(F.col("chunk_id").cast("long"), F.col("block").cast("long"), F.coalesce(F.lower("text"), F.lit("")).alias("text"))
    return rows.mapInArrow(count, SEGMENTS)


def merged(chunks: DataFrame) -> DataFrame:
    """As ``segments``, for chunks of many rows (the same chunk_id and block): one posting for all rows of a chunk, a segment each."""
    each = chunks.select(F.col("chunk_id").cast("long"), F.col("block").cast("long"), F.explode(T.tokens(F.col("text"))).alias("term"))
    tf = F.col("tf").cast("int")
    each = each.groupBy("chunk_id", "block", "term").agg(F.count("*").alias("tf"))
    return each.select("term", F.lit(1).cast("long").alias("df"), tf.alias("most"), F.array(F.struct("chunk_id", "block", tf.alias("tf"))).alias("hits"))


def write_batch(chunks: DataFrame, root: str, batch: int, buckets: int = BUCKETS) -> None:
    """Index ``chunks`` (chunk_id, text, and optionally block and more) as one batch."""
    spark = chunks.sparkSession
    at = {name: f"{root}/{name}/batch={batch}" for name in TABLES}
    blocks_of(chunks).write.mode("overwrite").parquet(at["chunks"])
    kept = spark.read.schema(blocks_of(chunks).schema).parquet(at["chunks"])
    by_bucket = lambda df: df.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket")
    rows = spread(kept.select("chunk_id", "block", "text"))
    again = kept.groupBy("chunk_id", "block").count().where("count > 1").select(F.col("chunk_id").alias("c"), F.col("block").alias("b"))
    if again.isEmpty():
        posted = segments(rows)
    else:
        again, same = small(again), F.col("chunk_id").eqNullSafe(F.col("c")) & F.col("block").eqNullSafe(F.col("b"))
        posted = segments(rows.join(again, same, "left_anti")).unionByName(merged(rows.join(again, same, "left_semi")))
    posted = posted.withColumn("bucket", bucket_of("term", buckets))
    by_bucket(posted).parquet(at["segments"])
    posted = spark.read.schema(posted.schema).parquet(at["segments"])
    by_bucket(posted.groupBy("bucket", "term").agg(F.sum("df").alias("df"), F.max("most").alias("most"))).parquet(at["terms"])
    kept.agg(F.count("*").alias("chunks")).write.mode("overwrite").parquet(at["sizes"])


SCHEMAS = {
    "segments": f"{SEGMENTS}, batch int, bucket int",
    "terms": "term string, df long, most int, batch int, bucket int",
    "sizes": "chunks long, batch int",
}


class Index:
    """An index below ``root``, as it stands when a table is read."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root, buckets

    def table(self, name: str) -> DataFrame:
        if name == "postings":
            rows = self.table("segments").select("term", "batch", "bucket", F.inline("hits"))
            return rows.select("chunk_id", "block", "term", F.col("tf").cast("long").alias("tf"), "batch", "bucket")
        if name == "blocks":
            return self.table("postings").groupBy("term", "block", "batch", "bucket").agg(F.count("*").alias("n"), F.max("tf").alias("most"))
        reader = self.spark.read
        return (reader.schema(SCHEMAS[name]) if name in SCHEMAS else reader).parquet(f"{self.root}/{name}")

    def size(self) -> int:
        return self.table("sizes").agg(F.coalesce(F.sum("chunks"), F.lit(0))).first()[0]

    def statistics(self) -> DataFrame:
        """term, df over all batches."""
        return self.table("terms").groupBy("term").agg(F.sum("df").alias("df"))

    def _of(self, name: str, terms: DataFrame) -> DataFrame:
        """Rows of the asked terms; their buckets, and the terms themselves if there are few, are named in the scan's filter."""
        rows = self.table(name)
        named = [r[0] for r in terms.select("term").distinct().limit(NAMED + 1).collect()]
        if len(named) > NAMED:
            return rows
        buckets = [r[0] for r in self.spark.createDataFrame([(t,) for t in named], "term string").select(bucket_of("term", self.buckets)).distinct().collect()]
        return rows.where(F.col("bucket").isin(buckets) & F.col("term").isin(named))

    def weights(self, questions: DataFrame) -> DataFrame:
        """qid, term, bucket, qtf, df, weight of the terms that the index has: what one occurrence counts."""
        asked = stored(index.query_terms(questions), "asked")
        stats = self._of("terms", asked).groupBy("term").agg(F.sum("df").alias("df"))
        found = asked.join(stats, "term")
        weight = F.col("qtf") * (1 + F.log((F.lit(self.size()) + 1) / (F.col("df") + 1)))
        return stored(found.select("qid", "term", bucket_of("term", self.buckets).alias("bucket"), "qtf", "df", weight.alias("weight")), "weights")

    def _scored(self, weights: DataFrame, where: DataFrame | None = None) -> DataFrame:
        """qid, chunk_id, lexical. ``where``: qid, batch, block that are scored, else all."""
        rows = self._of("postings", weights).join(small(weights.select("qid", "bucket", "term", "weight")), ["bucket", "term"])
        if where is not None:
            rows = rows.join(small(where), ["qid", "batch", "block"], "left_semi")
        part = F.least("tf", F.lit(TF_CAP)) * F.col("weight")
        return rows.groupBy("qid", "chunk_id").agg(F.round(F.sum(part), 6).alias("lexical"))

    def scores(self, questions: DataFrame) -> DataFrame:
        """qid, chunk_id, lexical of every chunk with an asked term; the same as ``ranking.lexical_scores`` over all chunks."""
        return self._scored(self.weights(questions))

    def promising(self, weights: DataFrame, k: int) -> DataFrame:
        """qid, batch, block that may hold one of a question's k best chunks."""
        before = Window.partitionBy("qid").orderBy("df", "term").rowsBetween(Window.unboundedPreceding, -1)
        rare = weights.withColumn("before", F.coalesce(F.sum("df").over(before), F.lit(0))).where(F.col("before") < 4 * k).drop("before")
        best = top(self._scored(stored(rare, "rare")), k, ["qid"], F.desc("lexical"), F.asc("chunk_id"))
        bound = best.where(F.col("rank") == k).select("qid", F.col("lexical").alias("bound"))
        maxima = self._of("blocks", weights).join(small(weights.select("qid", "bucket", "term", "weight")), ["bucket", "term"])
        most = maxima.groupBy("qid", "batch", "block").agg(F.sum(F.least("most", F.lit(TF_CAP)) * F.col("weight")).alias("most"))
        return most.join(small(bound), "qid", "left").where(F.col("most") >= F.coalesce("bound", F.lit(0.0)) - MARGIN).select("qid", "batch", "block")

    def search(self, questions: DataFrame, k: int = 20) -> DataFrame:
        """qid, chunk_id, lexical, rank: the k best chunks of each question (qid, question), ties by chunk_id."""
        weights = self.weights(questions)
        where = stored(self.promising(weights, k), "promising")
        return top(self._scored(weights, where), k, ["qid"], F.desc("lexical"), F.asc("chunk_id"))


def compacted(old: Index, root: str) -> Index:
    """A copy of the index as a single batch in a folder of its own; readers change over by its path."""
    write_batch(old.table("chunks").drop("batch"), root, 0, old.buckets)
    return Index(old.spark, root, old.buckets)
