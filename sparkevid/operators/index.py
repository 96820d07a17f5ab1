"""Inverted statistics: postings, document frequencies, and their additive maintenance.

The reference data model is a forward index in memory; here postings are rows, document frequency an
aggregation over them, and a new batch changes both by a sum, without a rebuild.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import small, top


#: Tasks that count a split's words: their counts stay in memory.
PARTS = 8


def postings(chunks: DataFrame, chunk_id: str = "chunk_id", text: str = "text") -> DataFrame:
    """chunk_id, term, tf; stopwords are kept."""
    each = chunks.select(F.col(chunk_id).alias("chunk_id"), F.explode(T.tokens(F.col(text))).alias("term"))
    return each.groupBy("chunk_id", "term").agg(F.count("*").alias("tf"))


def term_stats(posted: DataFrame) -> DataFrame:
    """term, df: the number of chunks that hold a term."""
    return posted.groupBy("term").agg(F.count("*").alias("df"))


def merged_stats(old: DataFrame, new: DataFrame) -> DataFrame:
    """Statistics of two disjoint sets of chunks together."""
    return old.unionByName(new).groupBy("term").agg(F.sum("df").alias("df"))


def query_terms(questions: DataFrame, qid: str = "qid", question: str = "question") -> DataFrame:
    """qid, term, qtf over content words."""
    each = questions.select(F.col(qid).alias("qid"), F.explode(T.content_words(F.col(question))).alias("term"))
    return each.groupBy("qid", "term").agg(F.count("*").alias("qtf"))


def posted_terms(chunks: DataFrame, terms: DataFrame, tokens=T.tokens) -> DataFrame:
    """chunk_id, term, tf of the terms that questions ask for. Other tokens end before the aggregation, without a shuffle."""
    each = chunks.select("chunk_id", F.explode(tokens(F.col("text"))).alias("term"))
    return each.join(small(terms.select("term").distinct()), "term", "left_semi").groupBy("chunk_id", "term").agg(F.count("*").alias("tf"))


def keyphrases(texts: DataFrame, key: str, k: int = 8, text: str = "text") -> DataFrame:
    """key, rank, term, n: most frequent content words, ties by first occurrence.

    Texts are shuffled by their key, once; their words, several times as many bytes, are counted and ranked where they are."""
    dealt = texts.select(F.col(key), F.col(text).alias("_text")).repartition(PARTS * texts.rdd.getNumPartitions(), key)
    each = dealt.select(F.col(key), F.posexplode(T.content_words(F.col("_text"))).alias("pos", "term"))
    counted = each.groupBy(key, "term").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    return top(counted, k, [key], F.desc("n"), F.asc("first")).select(key, "rank", "term", "n")


def negative_samples(texts: DataFrame, key: str) -> DataFrame:
    """key, negative: for each key another one, by a shift in hash order within hash buckets, the last of a bucket taking the first.

    Equal keys are one. A bucket is one task's; their number follows the count of keys, so none grows with the table. A key that is
    alone in its bucket takes the least or the second key of the table; a table of one key has no negatives."""
    from pyspark.sql import Window

    keys = texts.select(key).where(F.col(key).isNotNull()).distinct()
    n = texts.count()
    buckets = max(1, n // 50_000)
    rows = keys.select(key, F.pmod(F.xxhash64(F.col(key), F.lit("bucket")), F.lit(buckets)).alias("b"), F.xxhash64(key).alias("h"))
    by = Window.partitionBy("b").orderBy("h", key)
    whole = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nxt = F.coalesce(F.lead(key).over(by), F.first(key).over(whole))
    ends = keys.agg(F.array_sort(F.array_distinct(F.array(F.min(key), F.max(key)))).alias("ends"))
    rows = rows.select(key, nxt.alias("negative")).join(F.broadcast(ends))  # one row
    other = F.get(F.array_except("ends", F.array(key)), F.lit(0))
    return rows.select(key, F.when(F.col(key) == F.col("negative"), other).otherwise(F.col("negative")).alias("negative")).where("negative is not null")
