"""Retrieval systems compared on the same cases, in one plan: cases from passages, hits of each system, metrics by category.

A passage gives two cases. The case ``passage`` asks its first words and expects a run of its words, in order; the case ``reversed`` asks
the same words and expects the run backwards, which no system should claim to have found: the run itself is its contradiction.
Texts are compared in their normal form (lower case, a-z and 0-9 as words).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import small, spread, stored
from . import index, metrics, ranking, similarity

#: Words of a question; first word and number of words of the expected run.
ASKED, FROM, RUN = 12, 2, 6
CATEGORIES = ("passage", "reversed")
#: Stands for a null chunk_id, which is last in ties.
NO_ID = (1 << 63) - 1


def cases(passages: DataFrame) -> DataFrame:
    """qid, item_id, category, question, supported, expected, contradiction of passages (item_id, text) that have enough words."""
    words = F.split(T.dedup_key(F.col("text")), " ")
    p = passages.select("item_id", words.alias("w")).where(F.size("w") >= FROM + RUN)
    run = F.slice("w", FROM + 1, RUN)
    ahead, back = F.array_join(run, " "), F.array_join(F.reverse(run), " ")
    p = p.select("item_id", F.array_join(F.slice("w", 1, ASKED), " ").alias("question"), ahead.alias("ahead"), back.alias("back")).where("ahead <> back")
    kinds = F.array(
        F.struct(F.lit(0).alias("k"), F.lit(CATEGORIES[0]).alias("category"), F.lit(True).alias("supported"), F.col("ahead").alias("expected"), F.lit(None).cast("string").alias("contradiction")),
        F.struct(F.lit(1).alias("k"), F.lit(CATEGORIES[1]).alias("category"), F.lit(False).alias("supported"), F.col("back").alias("expected"), F.col("ahead").alias("contradiction")),
    )
    p = p.withColumn("x", F.explode(kinds))
    return p.select((F.col("item_id") * 2 + F.col("x.k")).alias("qid"), "item_id", "x.category", "question", "x.supported", "x.expected", "x.contradiction")


def counts(chunks: DataFrame, questions: DataFrame) -> DataFrame:
    """chunk_id (a null one: NO_ID), token, tf of the tokens that a system may ask for, from one pass over the texts. Tokens with an apostrophe all stay: their
    parts are words of the systems that know no apostrophes."""
    asked = questions.select(F.explode(F.concat(T.tokens(F.col("question")), T.plain_tokens(F.col("question")), F.array(F.lit("'")))).alias("key")).distinct()
    each = spread(chunks).select(F.coalesce(F.col("chunk_id").cast("long"), F.lit(NO_ID)).alias("chunk_id"), F.explode(T.tokens(F.col("text"))).alias("token"))
    each = each.withColumn("key", F.when(F.contains("token", F.lit("'")), "'").otherwise(F.col("token")))
    return each.join(small(asked), "key", "left_semi").groupBy("chunk_id", "token").agg(F.count("*").alias("tf"))


def lexical_system(counted: DataFrame, n: int, questions: DataFrame, k: int) -> DataFrame:
    terms = index.query_terms(questions)
    df = counted.join(small(terms.select("term").distinct()), F.col("token") == F.col("term"), "left_semi").groupBy(F.col("token").alias("term")).agg(F.count("*").alias("df"))
    weights = terms.join(df, "term").select("qid", "term", (F.col("qtf") * ranking.idf(F.lit(n), F.col("df"))).alias("weight"))
    return similarity.best_scores(counted.select("chunk_id", F.col("token").alias("term"), F.least("tf", F.lit(ranking.TF_CAP)).alias("tf")), stored(weights, "weights"), k)


def keyword_system(counted: DataFrame, n: int, questions: DataFrame, k: int) -> DataFrame:
    weights = questions.select("qid", F.explode(T.plain_tokens(F.col("question"))).alias("term")).groupBy("qid", "term").agg(F.count("*").cast("double").alias("weight"))
    words = F.when(F.contains("token", F.lit("'")), F.filter(F.split("token", "'"), lambda x: x != "")).otherwise(F.array("token"))
    return similarity.best_scores(counted.select("chunk_id", F.explode(words).alias("term"), "tf"), stored(weights, "weights"), k)


#: Of counts, the number of chunks, questions (qid, question) and k: qid, chunk_id, rank, score of the first k chunks of each question.
SYSTEMS = {"keyword": keyword_system, "lexical": lexical_system}


def hits(chunks: DataFrame, asked: DataFrame, k: int = 5, systems: dict = SYSTEMS) -> DataFrame:
    """system, qid, chunk_id, rank, score of each system's first k chunks. Equal questions are asked once, and texts are read once."""
    once = stored(asked.groupBy("question").agg(F.min("qid").alias("qid")), "asked")
    counted, n = stored(counts(chunks, once), "counts"), chunks.count()
    found = [f(counted, n, once, k).select(F.lit(name).alias("system"), F.col("qid").alias("first"), F.nullif("chunk_id", F.lit(NO_ID)).alias("chunk_id"), "rank", "score") for name, f in systems.items()]
    all_of = asked.select("qid", "question").join(small(once.select(F.col("qid").alias("first"), "question"), of=asked), "question").drop("question")
    return reduce(DataFrame.unionByName, found).join(small(all_of, of=asked), "first").select("system", "qid", "chunk_id", "rank", "score")


def supports(chunks: DataFrame, asked: DataFrame, found: DataFrame, k: int = 5, systems: dict = SYSTEMS) -> DataFrame:
    """system and the columns of the cases, with the ranks at which the expected run and the contradiction are first met, or null.

    Texts that were hit are normalised once, whatever the number of hits; a case without hits stays."""
    said = lambda phrase: F.contains("said", F.concat(F.lit(" "), phrase, F.lit(" ")))
    hit = small(found.select("chunk_id").distinct(), of=asked, times=k * len(systems))
    texts = chunks.select("chunk_id", "text").join(hit, "chunk_id", "left_semi").select("chunk_id", F.concat(F.lit(" "), T.dedup_key(F.col("text")), F.lit(" ")).alias("said"))
    texts = texts.join(small(found, of=asked, times=k * len(systems)), "chunk_id")
    texts = texts.join(small(asked.select("qid", "expected", "contradiction")), "qid")
    met = texts.groupBy("system", "qid").agg(F.min(F.when(said(F.col("expected")), F.col("rank"))).alias("support_rank"), F.min(F.when(said(F.col("contradiction")), F.col("rank"))).alias("contradiction_rank"))
    every = asked.withColumn("system", F.explode(F.array(*map(F.lit, systems))))
    return every.join(met, ["system", "qid"], "left")


def verdict(supported: Column, support_rank: Column) -> Column:
    """Why a case failed: false_rejection, false_support, or null."""
    found = support_rank.isNotNull()
    return metrics.verdict(F.lit(None), supported, found, F.lit(True))


def by_system(results: DataFrame) -> DataFrame:
    """The metrics of each system and category, and of all categories together: recall at 1, 3 and 5, accuracy and rejection at 5, two
    reciprocal ranks, rates of false support and false rejection."""
    right, supported, rank = metrics.right(), F.col("supported"), F.col("support_rank")
    out = results.withColumn("category", F.explode(F.array("category", F.lit("(all)"))))
    return out.groupBy("system", "category").agg(
        *metrics.retrieval_aggregates(), metrics.rate(rank.isNotNull(), ~supported).alias("false_support"), metrics.rate(rank.isNull(), supported).alias("false_rejection"), F.count_if(~right).cast("long").alias("failed")
    )


def paired(results: DataFrame, base: str, new: str) -> DataFrame:
    """category, cases, both, only_base, only_new, neither: cases that the two systems got right, side by side."""
    each = results.withColumn("right", metrics.right()).groupBy("category", "qid").pivot("system", [base, new]).agg(F.bool_and("right"))
    b, n = F.col(base), F.col(new)
    count = lambda c, name: F.count_if(c).cast("long").alias(name)
    return each.groupBy("category").agg(F.count("*").alias("cases"), count(b & n, "both"), count(b & ~n, "only_base"), count(~b & n, "only_new"), count(~b & ~n, "neither"))


def evaluate(chunks: DataFrame, passages: DataFrame, k: int = 5, systems: dict = SYSTEMS) -> DataFrame:
    """One row for each system and case: qid, item_id, category, question, supported, expected, contradiction, system, ranks, reason."""
    asked = stored(cases(passages), "cases")
    found = stored(hits(chunks, asked, k, systems), "hits")
    return supports(chunks, asked, found, k, systems).withColumn("reason", verdict(F.col("supported"), F.col("support_rank")))
