"""Order-dependent dedup, greedy selection and evidence statistics. Order is always a sorted array or a window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def keep_first(df: DataFrame, by: list[Column], order: list[Column]) -> DataFrame:
    """The first row of each key. A key's rows are reduced before the shuffle where ``order`` is a struct of columns."""
    names = df.columns
    rows = df.groupBy(*(c.alias(f"_k{i}") for i, c in enumerate(by))).agg(F.min_by(F.struct(*names), F.struct(*order)).alias("r"))
    return rows.select("r.*")


def budget_selection(sentences: DataFrame, most: int = 5, chars: int = 2600, by: str = "qid", document_order: bool = False) -> DataFrame:
    """Evidence under a budget: in order of score, chunk rank and place, a sentence is taken unless it exceeds the budget
    (the first always is), until ``most`` are taken. Needs qid, score, chunk_rank, idx, sentence; adds pos.

    A question's eligible sentences come from its few ranked chunks, so the array is bounded."""
    item = F.struct((-F.col("score")).alias("o"), "chunk_rank", "idx", "sentence", "score")
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("chars"), F.array().cast("array<struct<o:double,chunk_rank:int,idx:int,sentence:string,score:double>>").alias("acc"))

    def merge(a: Column, x: Column) -> Column:
        take = (a["n"] < most) & ((a["n"] == 0) | (a["chars"] + F.length(x["sentence"]) <= chars))
        return F.struct(
            F.when(take, a["n"] + 1).otherwise(a["n"]).alias("n"),
            F.when(take, a["chars"] + F.length(x["sentence"])).otherwise(a["chars"]).alias("chars"),
            F.when(take, F.array_append(a["acc"], x)).otherwise(a["acc"]).alias("acc"),
        )

    eligible = sentences.where("score > 0").withColumn("score", F.col("score").cast("double")).withColumns({c: F.col(c).cast("int") for c in ("chunk_rank", "idx")})
    ordered = eligible.groupBy(by).agg(F.sort_array(F.collect_list(item)).alias("all"))
    chosen = ordered.select(by, F.aggregate("all", start, merge)["acc"].alias("acc"))
    if document_order:
        again = F.array_sort("acc", lambda a, b: F.when((a["chunk_rank"] < b["chunk_rank"]) | ((a["chunk_rank"] == b["chunk_rank"]) & (a["idx"] < b["idx"])), -1).otherwise(1))
        chosen = chosen.select(by, again.alias("acc"))
    rows = chosen.select(by, F.posexplode("acc").alias("pos", "s"))
    return rows.select(by, (F.col("pos") + 1).alias("pos"), "s.score", "s.chunk_rank", "s.idx", "s.sentence")


def greedy_distinct(sentences: Column, least: float = 0.65) -> Column:
    """Keeps a sentence unless it is a near copy of one that is kept; order decides."""
    near = lambda kept, x: F.exists(kept, lambda y: T.containment(T.signature(x), T.signature(y)) >= least)
    return F.aggregate(sentences, F.array().cast("array<string>"), lambda kept, x: F.when(near(kept, x), kept).otherwise(F.array_append(kept, x)))


def evidence_stats(evidence: DataFrame, subject: Column, marked: Column) -> DataFrame:
    """Per question: sentences, those that mention the subject, those with an intent mark, best score."""
    return evidence.groupBy("qid").agg(F.count("*").alias("selected"), F.count_if(subject).alias("with_subject"), F.count_if(marked).alias("with_intent"), F.max("score").alias("best"))


def mentions(sentence: Column, subject: Column) -> Column:
    """One word of a one-word subject, two of a longer one; an empty subject is never mentioned."""
    s = T.terms(subject)
    return (F.size(s) > 0) & (T.overlap(T.terms(sentence), s) >= F.least(F.lit(2), F.size(s)))


def context_sentences(rows: DataFrame, k: int = 3) -> DataFrame:
    """Of each question the k best sentences in their own order, or its first k where none scores. Needs qid, idx, sentence, score."""
    best = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), F.asc("idx")))
    any_hit = F.max("score").over(Window.partitionBy("qid")) > 0
    place = F.when(any_hit, F.when(F.col("score") > 0, best)).otherwise(F.row_number().over(Window.partitionBy("qid").orderBy("idx")))
    return rows.withColumn("place", place).where(F.col("place") <= k).select("qid", "idx", "sentence", "score")
