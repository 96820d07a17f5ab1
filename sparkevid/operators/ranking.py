"""Scores, ranks and fusion over (question, chunk) rows. Every rank is a total order that ends in an id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T
from ..functions import vectors as V
from ..session import small, stored, top
from . import index, similarity

TF_CAP = 3
RUNTIME_BOOST = 5.0


def lexical_scores(chunks: DataFrame, questions: DataFrame, df: DataFrame | None = None, n: int | None = None, posted: DataFrame | None = None) -> DataFrame:
    """qid, chunk_id, lexical: sum of min(tf, 3) * qtf * (1 + ln((N + 1) / (df + 1))) over a question's content terms.

    Only the postings of asked terms are counted, and their document frequencies with them; they are written, so that the corpus is
    read and tokenised once."""
    terms = index.query_terms(questions)
    if posted is None:
        posted = index.posted_terms(chunks, terms)
        posted = stored(posted, "posted") if df is None else posted
    if df is None:
        df = index.term_stats(posted)
    if n is None:
        n = chunks.count()
    weights = small(terms.join(df, "term"), of=terms)
    scored = posted.join(weights, "term").withColumn("part", F.least("tf", F.lit(TF_CAP)) * F.col("qtf") * idf(F.lit(n), F.col("df")))
    return scored.groupBy("qid", "chunk_id").agg(F.round(F.sum("part"), 6).alias("lexical"))


def idf(n: Column, df: Column) -> Column:
    return 1 + F.log((n + 1) / (df + 1))


def candidates(scored: DataFrame, k: Column | int = 20) -> DataFrame:
    """The first k of each question by score, lexical score and chunk_id; scores of zero or less are no hits. ``k`` may be a column."""
    hits = scored.where("score > 0")
    number = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), F.desc("lexical"), F.asc("chunk_id")))
    return hits.withColumn("rank", number).where(F.col("rank") <= k)


def keyword_scores(chunks: DataFrame, questions: DataFrame) -> DataFrame:
    """qid, chunk_id, keyword: raw counts over all of a question's tokens, repeats and stopwords included."""
    q = questions.select("qid", F.explode(T.plain_tokens(F.col("question"))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("qtf"))
    posted = index.posted_terms(chunks, q, T.plain_tokens)
    return posted.join(small(q), "term").groupBy("qid", "chunk_id").agg(F.sum(F.col("tf") * F.col("qtf")).alias("keyword"))


def hybrid(keyword: DataFrame, vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """qid, chunk_id, score: 0.7 keyword + 0.3 cosine, each scaled to 0..1 within its question, of chunks that have both.

    ``keyword``: qid, chunk_id, keyword; ``vectors`` and ``queries``: vec_id, embedding, the chunk's and the question's id. Cosines are ranged
    over all vectors by products of blocks, and then computed for the keyword hits alone; keyword bounds are aggregated before
    the shuffle."""
    rows = stored(keyword.select("qid", "chunk_id", F.col("keyword").cast("double").alias("keyword")), "keyword")
    own = rows.groupBy("qid").agg(F.min("keyword").alias("least_keyword"), F.max("keyword").alias("most_keyword"))
    ends = similarity.bounds(vectors, queries).select(F.col("query_id").alias("qid"), F.col("least").alias("least_cosine"), F.col("most").alias("most_cosine"))
    of_question = own.join(ends, "qid").join(queries.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q")), "qid")
    pairs = rows.where("qid <> chunk_id").join(small(of_question, of=queries), "qid").join(vectors.select(F.col("vec_id").alias("chunk_id"), "embedding"), "chunk_id")
    cosine = F.round(V.cosine(F.col("q"), F.col("embedding")), 6)
    k = V.scaled(F.col("keyword"), F.col("least_keyword"), F.col("most_keyword"))
    v = V.scaled(cosine, F.col("least_cosine"), F.col("most_cosine"))
    return pairs.select("qid", "chunk_id", F.round(0.7 * k + 0.3 * v, 6).alias("score"))


#: Relation, its question pattern, and the word that states it.
RELATIONS = (
    ("born", r"^when was (.+) born\??$", "born"),
    ("founded", r"^when was (.+) founded\??$", "founded"),
    ("established", r"^when was (.+) established\??$", "established"),
    ("released", r"^when was (.+) released\??$", "released"),
    ("published", r"^when was (.+) published\??$", "published"),
    ("named_after", r"^(?:who or what|what|who) was (.+) named after\??$", "named after"),
)
CAUSAL = ("because", "due to", "as a result of", "caused by", "fell after", "collapsed after")


def relation(question: Column) -> Column:
    """The factual relation that a question asks for, or null."""
    q = F.lower(F.trim(question))
    out = None
    for name, pattern, _ in RELATIONS:
        hit = F.contains(q, F.lit("named after")) if name == "named_after" else F.regexp_like(q, F.lit(pattern))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def relation_subject(question: Column) -> Column:
    """The subject of a factual or plain causal question, or null."""
    q = F.trim(question)
    patterns = [p for _, p, _ in RELATIONS] + [r"^why did (.+) fall\??$", r"^why was (.+?) .+?\??$"]
    return F.coalesce(*(F.nullif(F.regexp_replace(F.trim(F.regexp_extract(q, f"(?i){p}", 1)), "[.?!]+$", ""), F.lit("")) for p in patterns))


def _near(subject: Column, word: str, reach: int) -> tuple[Column, Column]:
    """Patterns: the subject before the word within reach, and after it."""
    quoted = F.concat(F.lit(r"\b\Q"), F.replace(subject, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E\b"))
    return F.concat(F.lit("(?d)"), quoted, F.lit(f".{{0,{reach}}}\\b{word}\\b")), F.concat(F.lit(f"(?d)\\b{word}\\b.{{0,{reach}}}"), quoted)


def _bound(question: Column, chunk: Column, body) -> Column:
    """body(x) with the lower-case question q and chunk c, the relation and the subject computed once a row."""
    parts = {"q": F.lower(question), "c": F.lower(chunk), "relation": relation(question), "subject": F.lower(relation_subject(question))}
    return R.let(F.struct(*(v.alias(k) for k, v in parts.items())), body)


def factual_bonus(question: Column, chunk: Column) -> Column:
    """Stage-one bonus: 8 for the subject of a factual question, and more where its relation is stated close by."""
    points = lambda hit, value: F.when(hit, value).otherwise(0.0)

    def stated(x: Column, name: str, word: str) -> Column:
        direct, reverse = _near(x["subject"], r"(?:was\s+)?born" if name == "born" else word, 60 if name == "born" else 80)
        if name == "born":
            dated = points(F.regexp_like(x["c"], F.lit(r"\bborn\s+(?:on|in)\b")), 2.0) + points(F.regexp_like(x["c"], F.lit(r"\b(?:18|19|20)\d{2}\b")), 2.0)
            return points(F.regexp_like(x["c"], direct), 40.0) + points(F.regexp_like(x["c"], reverse), 30.0) + dated
        return F.when(F.regexp_like(x["c"], direct), 36.0).when(F.contains(x["c"], F.lit(word)), 6.0).otherwise(0.0)

    def bonus(x: Column) -> Column:
        value = F.lit(0.0)
        for name, _, word in RELATIONS:
            value = F.when(x["relation"] == name, stated(x, name, word)).otherwise(value)
        return points(x["relation"].isNotNull() & x["subject"].isNotNull() & F.contains(x["c"], x["subject"]), 8.0 + value)

    return _bound(question, chunk, bonus)


def pattern_bonus(question: Column, chunk: Column) -> Column:
    """Stage-two bonus: stated relation, causal marks for why-questions, and the subject's presence."""

    def bonus(x: Column) -> Column:
        out = F.lit(0.0)
        for name, _, word in RELATIONS:
            direct, reverse = _near(x["subject"], r"(?:was\s+)?born" if name == "born" else word, 60 if name == "born" else 80)
            part = F.when(F.regexp_like(x["c"], direct), 30.0 if name == "born" else 24.0)
            part = part.when(F.regexp_like(x["c"], reverse), 20.0) if name == "born" else part
            out = out + F.when(F.contains(x["q"], F.lit(word)) & x["subject"].isNotNull(), part.otherwise(0.0)).otherwise(0.0)
        for mark in CAUSAL:
            out = out + F.when(F.startswith(x["q"], F.lit("why ")) & F.contains(x["c"], F.lit(mark)), 4.0).otherwise(0.0)
        return out + F.when(F.coalesce(F.contains(x["c"], x["subject"]), F.lit(False)), 10.0).otherwise(0.0)

    return _bound(question, chunk, bonus)


def reranked(hits: DataFrame, k: int = 5) -> DataFrame:
    """final = score + pattern bonus; the first k by final, lexical and chunk_id. Needs question and text beside the score."""
    final = hits.drop("rank").withColumn("final", F.col("score") + pattern_bonus(F.col("question"), F.col("text")))
    return top(final, k, ["qid"], F.desc("final"), F.desc("lexical"), F.asc("chunk_id"))


def fused(hits: DataFrame, query_step: float = 0.25, query_most: float = 3.0, rank_step: float = 0.4, rank_most: float = 2.5) -> DataFrame:
    """Hits of several queries of a question, fused by normalised text.

    Needs qid, query_rank, rank, chunk_id, text, base, runtime. A hit counts base plus bonuses for early queries and
    ranks; equal texts fuse to the best of these, with the number of hits, the distinct queries and the least chunk_id."""
    bonus = F.greatest(F.lit(0.0), query_most - query_step * (F.col("query_rank") - 1)) + F.greatest(F.lit(0.0), rank_most - rank_step * (F.col("rank") - 1))
    combined = F.col("base") + bonus + F.when(F.col("runtime"), RUNTIME_BOOST).otherwise(0.0)
    rows = hits.select("qid", T.dedup_key(F.col("text")).alias("key"), "chunk_id", "text", "base", combined.alias("combined"), "query_rank")
    return rows.groupBy("qid", "key").agg(
        F.max("combined").alias("best"), F.max("base").alias("base"), F.count("*").alias("query_hits"), F.countDistinct("query_rank").alias("queries"),
        F.min("chunk_id").alias("chunk_id"), F.min_by("text", "chunk_id").alias("text"),
    )


def merged_rank(merged: DataFrame, k: int = 12, step: float = 1.2, most: float = 5.0, bonus: Column | None = None) -> DataFrame:
    """merged = best + min(5, 1.2 (hits - 1)) + bonus; the first k by merged, hits, base and chunk_id."""
    extra = F.lit(0.0) if bonus is None else bonus
    scored = merged.withColumn("merged", F.round(F.col("best") + F.least(F.lit(most), step * (F.col("query_hits") - 1)) + extra, 6))
    return top(scored, k, ["qid"], F.desc("merged"), F.desc("query_hits"), F.desc("base"), F.asc("chunk_id"))


#: Phrases that a question has one of (or none of, after "!"), phrases that a chunk has one of, and what that is worth. A domain's own rules
#: are given to ``phrase_bonus``.
CHUNK_RULES = (
    (("!replace", "!different", "!compare"), ("does not replace",), -8.0),
    (("!different", "!compare"), ("is different from",), -3.0),
)


def phrase_bonus(question: Column, chunk: Column, rules: tuple = CHUNK_RULES) -> Column:
    """Sum of the rules whose phrases a question and a chunk have. Of a question's phrases one must occur, those after "!" must all be
    missing, and "a&b" needs both parts."""
    q, c = F.lower(question), F.lower(chunk)

    def holds(phrase: str) -> Column:
        out = F.lit(True)
        for part in phrase.split("&"):
            out = out & F.contains(q, F.lit(part))
        return out

    total = F.lit(0.0)
    for asked, found, delta in rules:
        wanted = [holds(p) for p in asked if not p.startswith("!")]
        ok = wanted[0] if wanted else F.lit(True)
        for w in wanted[1:]:
            ok = ok | w
        for p in asked:
            if p.startswith("!"):
                ok = ok & ~F.contains(q, F.lit(p[1:]))
        total = total + F.when(ok & T.any_substring(chunk, found), delta).otherwise(0.0)
    return total


def sentence_score(sentence: Column, question: Column, subject: Column, chunk_rank: Column, marks: Column) -> Column:
    """2 per question word, 3 per subject word, the chunk's rank bonus, intent marks, 1 for 8 to 45 words, -2 above 70; 0 without words."""
    own, words = T.terms(sentence), F.size(T.space_words(sentence))
    score = 2.0 * T.overlap(own, T.terms(question)) + 3.0 * T.overlap(own, T.terms(subject)) + F.greatest(F.lit(0.0), 3 - 0.25 * (chunk_rank - 1))
    score = score + marks + F.when(words.between(8, 45), 1.0).otherwise(0.0) - F.when(words > 70, 2.0).otherwise(0.0)
    return F.when(F.size(own) == 0, F.lit(0.0)).otherwise(score)


def sentence_score_v3(sentence: Column, question: Column, chunk_rank: Column, marks: Column) -> Column:
    """3 per common word, rank bonus, pattern marks; -2 without a common word, -1 below 25 characters, -2 above 70 words."""
    common = T.overlap(T.terms(sentence), T.terms(question))
    score = 3.0 * common + F.greatest(F.lit(0.0), 3 - 0.5 * (chunk_rank - 1)) + marks
    return score - F.when(common == 0, 2.0).otherwise(0.0) - F.when(F.length(sentence) < 25, 1.0).otherwise(0.0) - F.when(F.size(T.space_words(sentence)) > 70, 2.0).otherwise(0.0)


def side_sentence_score(sentence: Column, entity: Column, marks: list[str]) -> Column:
    """5 per common word, 7 for a mention of the entity, 2 per mark, 1 for 8 to 45 words and -2 above 70."""
    words = F.size(T.space_words(sentence))
    score = 5.0 * T.overlap(T.terms(sentence), T.terms(entity))
    score = score + F.when(F.exists(T.entity_terms(entity), lambda e: F.contains(T.dedup_key(sentence), T.dedup_key(e))), 7.0).otherwise(0.0)
    for m in marks:
        score = score + F.when(F.contains(F.lower(sentence), F.lit(m)), 2.0).otherwise(0.0)
    return score + F.when(words.between(8, 45), 1.0).otherwise(0.0) - F.when(words > 70, 2.0).otherwise(0.0)


def source_list(hits: DataFrame, k: int = 5) -> DataFrame:
    """The first k hits as citations: qid, rank, id, preview of 240 characters, score to three places."""
    return hits.where(F.col("rank") <= k).select("qid", "rank", F.col("chunk_id").alias("id"), F.left("text", F.lit(240)).alias("preview"), F.bround("score", 3).alias("score"))
