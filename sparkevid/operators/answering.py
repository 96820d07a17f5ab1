"""Questions to answers over a corpus: plan, expand, retrieve, rerank, fuse, select evidence, fall back, gate, answer, cite.

All questions go through together as rows. A question's queries have the key struct(qid, query_rank); evidence is judged
for struct(qid, stage), where stage 0 has the primary queries and stage n the first n fallbacks as well. Questions whose evidence is
sufficient at stage 0 leave by an anti-join; of the others, all further stages are judged at once and the first sufficient
one counts, or else the last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T
from ..session import small, stored, top
from . import gates, index, questions, ranking, selection, synthesis
from .inverted import Index

#: Hits of a query, chunks of a question, sources of an answer.
PER_QUERY, MERGED, SOURCES = 5, 12, 5
CANDIDATES, FACTUAL_CANDIDATES = 20, 120
#: Of a comparison: hits of a query, chunks of a side.
SIDE_QUERY, SIDE_CHUNKS = 6, 8
MARK = 3.0


#: Points of a mark (others: MARK), of two and three marks of a structure together, of names in a list of people, and what
#: shows that a sentence with names is about something else.
LIGHT_MARKS, LIGHT = ("process", "change", "features"), 2.5
STEPS = ((2, 5.0), (3, 5.0))
NAME, NAMES_MOST, LED = 4.0, 8.0, 6.0
LEADING = ("member", "government", "leader")
ELSEWHERE, ELSEWHERE_POINTS = ("newspaper", "museum", "painting", "collection"), -8.0
_NAME = r"\b[A-Z][a-z]+(?:-[A-Z][a-z]+)? [A-Z][a-z]+(?:-[A-Z][a-z]+)?\b"


def intent_marks(sentence: Column, intent: Column, subject: Column) -> Column:
    """Points of a sentence for its intent: for each mark; for marks of a structure that stand together, in steps; for names of people, more
    beside a word of leading, less beside one that tells of something else; for a comparison twice its subject's words."""
    names = F.size(F.regexp_extract_all(sentence, F.lit(_NAME), F.lit(0)))
    parts = F.struct(F.lower(sentence).alias("low"), gates.marks_of(intent, gates.INTENT_MARKS).alias("marks"), names.alias("names"))

    def points(x: Column) -> Column:
        has = lambda words: F.size(F.filter(T.words_of(words), lambda m: F.contains(x["low"], m)))
        steps = F.lit(0.0)
        for least, value in STEPS:
            steps = steps + F.when(x["hits"] >= least, value).otherwise(0.0)
        people = F.least(F.lit(NAMES_MOST), NAME * x["names"]) + F.when((x["names"] > 0) & (has(LEADING) > 0), LED).otherwise(0.0) + ELSEWHERE_POINTS * has(ELSEWHERE)
        own = F.when(intent == "structure", steps).when(intent == "entity_list", people).when(intent == "comparison", 2.0 * T.overlap(T.terms(sentence), T.terms(subject))).otherwise(0.0)
        return F.when(intent.isin(*LIGHT_MARKS), LIGHT).otherwise(MARK) * x["hits"] + own

    counted = lambda x: F.struct(x["low"].alias("low"), x["names"].alias("names"), F.size(F.filter(x["marks"], lambda m: F.contains(x["low"], m))).alias("hits"))
    return R.let(R.let(parts, counted), points)


def retrieved(chunks: DataFrame, queries: DataFrame, k: int = PER_QUERY, kept: Index | None = None) -> DataFrame:
    """qid (the query's key), chunk_id, text, runtime, rank, final: the first k chunks of each query after both bonus stages.

    Needs chunk_id, text, runtime, and qid, question. Only postings of asked terms are kept; the text is met by hits alone. With ``kept``, an
    index of these chunks, no text is tokenised: scores come from the postings of the asked terms' buckets."""
    if kept is None:
        posted = stored(index.posted_terms(chunks, index.query_terms(queries)), "posted")  # for document frequencies and for scores
        scored = ranking.lexical_scores(chunks, queries, posted=posted)
    else:
        scored = kept.scores(queries)
    factual = ranking.relation(F.col("question")).isNotNull()
    asked = queries.select("qid", "question", factual.alias("factual"))
    ingested = chunks.where("runtime").select("chunk_id", F.lit(True).alias("ingested"))
    scored = scored.join(small(asked, of=queries), "qid").join(ingested, "chunk_id", "left").withColumn("ingested", F.coalesce("ingested", F.lit(False)))
    own = top(scored.where("not factual"), CANDIDATES, ["qid", "ingested"], F.desc("lexical"), F.asc("chunk_id"), rank="r").drop("r")
    hits = own.unionByName(scored.where("factual")).join(chunks.select("chunk_id", "text", "runtime"), "chunk_id")
    score = F.col("lexical") + ranking.factual_bonus(F.col("question"), F.col("text")) + F.when(F.col("runtime"), ranking.RUNTIME_BOOST).otherwise(0.0)
    kept = ranking.candidates(hits.withColumn("score", score), F.when(F.col("factual"), FACTUAL_CANDIDATES).otherwise(CANDIDATES))
    return ranking.reranked(kept, k).select("qid", "chunk_id", "text", "runtime", "rank", "final")


def merged_chunks(hits: DataFrame, plans: DataFrame) -> DataFrame:
    """The fused chunks of struct(qid, stage), ranked, with what is asked."""
    asked = plans.select(F.col("qid").alias("id"), "question", "intent", "subject")
    fused = ranking.fused(hits.withColumn("base", F.col("final"))).join(small(asked, of=plans), F.col("qid.qid") == F.col("id")).drop("id")
    return ranking.merged_rank(fused, MERGED, bonus=ranking.phrase_bonus(F.col("question"), F.col("text")))


def judged(hits: DataFrame, plans: DataFrame) -> DataFrame:
    """qid, stage, sentences, best_score, sufficient, sources: the evidence of each stage."""
    merged = stored(merged_chunks(hits, plans), "merged")
    s = merged.select("qid", "question", "intent", "subject", F.col("rank").alias("chunk_rank"), F.posexplode(T.sentences_keeping_initials(F.col("text"))).alias("idx", "sentence"))
    named = selection.mentions(F.col("sentence"), F.col("subject"))
    score = ranking.sentence_score(F.col("sentence"), F.col("question"), F.col("subject"), F.col("chunk_rank"), intent_marks(F.col("sentence"), F.col("intent"), F.col("subject")))
    s = s.withColumn("score", F.when((F.col("intent") == "general") | named, F.round(score, 6)).otherwise(-1000.0))
    s = selection.keep_first(s, [F.col("qid"), T.dedup_key(F.col("sentence"))], [F.col("chunk_rank"), F.col("idx")])
    chosen = stored(selection.budget_selection(s), "chosen")
    asked = plans.select(F.col("qid").alias("id"), "intent", "subject")
    e = chosen.join(small(asked, of=plans), F.col("qid.qid") == F.col("id")).drop("id")
    stats = selection.evidence_stats(e, selection.mentions(F.col("sentence"), F.col("subject")), gates.intent_supported(F.col("sentence"), F.col("intent")))
    said = chosen.groupBy("qid").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "sentence"))), lambda x: x["sentence"]).alias("sentences"))  # five at most
    found = merged.groupBy("qid", "intent", "subject").agg(F.count("*").alias("merged"), F.sort_array(F.collect_list(F.struct("rank", F.col("chunk_id").alias("id"), F.col("merged").alias("score"), "text"))).alias("found"))  # twelve at most
    rows = found.join(stats, "qid", "left").join(said, "qid", "left")
    none = lambda c: F.coalesce(c, F.lit(0))
    enough = gates.sufficient(F.col("merged"), none(F.col("selected")), none(F.col("with_subject")), none(F.col("with_intent")), F.col("intent"))
    sources = F.transform(F.slice("found", 1, SOURCES), lambda x: F.struct(x["rank"].alias("rank"), x["id"].alias("id"), F.bround(x["score"], 3).alias("score"), x["text"].alias("text")))
    empty = F.array().cast("array<string>")
    return rows.select("qid.qid", "qid.stage", F.coalesce("sentences", empty).alias("sentences"), F.coalesce("best", F.lit(0.0)).alias("best_score"), enough.alias("sufficient"), sources.alias("sources"))


def evidence(hits: DataFrame, queries: DataFrame, plans: DataFrame) -> DataFrame:
    """``judged`` of the stage that counts: the primary queries, or the first sufficient prefix of fallbacks.

    ``hits``: qid, query_rank, chunk_id, text, runtime, rank, final of the queries (``questions.expanded``)."""
    late = F.row_number().over(_in_order("qid", "is_primary"))
    staged = queries.select(F.col("qid").alias("q"), "query_rank", F.when(F.col("is_primary"), 0).otherwise(late).alias("from_stage"))
    staged = stored(staged, "staged")
    hits = hits.withColumnRenamed("qid", "q").join(small(staged, of=queries), ["q", "query_rank"])
    at = lambda stage: F.struct(F.col("q").alias("qid"), stage.alias("stage")).alias("qid")
    rest = ["query_rank", "chunk_id", "text", "runtime", "rank", "final"]
    first = stored(judged(hits.where("from_stage = 0").select(at(F.lit(0)), *rest), plans), "judged")
    enough = first.where("sufficient").select(F.col("qid").alias("q"))
    last = staged.groupBy("q").agg(F.max("from_stage").alias("last")).where("last > 0")
    more = hits.join(small(enough, of=plans), "q", "left_anti").join(small(last, of=plans), "q")
    more = more.withColumn("stage", F.explode(F.sequence(F.greatest("from_stage", F.lit(1)), "last")))
    later = judged(more.select(at(F.col("stage")), *rest), plans)
    best = F.struct((~F.col("sufficient")).alias("poor"), F.when(F.col("sufficient"), F.col("stage")).otherwise(-F.col("stage")).alias("stage"))
    return first.unionByName(later).withColumn("o", best).groupBy("qid").agg(F.min_by(F.struct("stage", "sentences", "best_score", "sufficient", "sources"), "o").alias("e")).select("qid", "e.*")


def _in_order(*by: str):
    from pyspark.sql import Window

    return Window.partitionBy(*by).orderBy("query_rank")


def side_queries(plans: DataFrame) -> DataFrame:
    """qid, side (0: left, 1: right), entity, query_rank, query of comparisons."""
    two = F.array(F.struct(F.lit(0).alias("side"), F.col("left").alias("entity")), F.struct(F.lit(1).alias("side"), F.col("right").alias("entity")))
    rows = plans.where("intent = 'comparison'").select("qid", F.explode(two).alias("x")).select("qid", "x.*")
    forms = F.array(*(F.replace(F.lit(f), F.lit("{entity}"), F.col("entity")) for f in ("{entity}", "{entity} characteristics", "{entity} history")))
    return rows.select("qid", "side", "entity", F.posexplode(forms).alias("i", "query")).select("qid", "side", "entity", (F.col("i") + 1).alias("query_rank"), "query")


def sides(hits: DataFrame) -> DataFrame:
    """qid, left_sentences, right_sentences, both_sufficient of comparisons: each side is judged for itself, by its results and by what its
    sentences say of it, and both must have evidence.

    ``hits``: qid, side, entity, query_rank, chunk_id, text, runtime, rank, final of ``side_queries``. A side's hits must name its entity;
    the join of the sides is inner, so a comparison with one side only has no row."""
    hits = hits.withColumnRenamed("final", "base")
    key = T.dedup_key(F.col("text"))
    hits = hits.where(F.exists(T.entity_terms(T.without_article(F.col("entity"))), lambda e: F.contains(key, T.dedup_key(e))))
    hits = hits.select(F.struct("qid", "side", "entity").alias("qid"), "query_rank", "rank", "chunk_id", "text", "base", "runtime")
    merged = ranking.merged_rank(ranking.fused(hits, 0.4, 3.0, 0.3, 2.0), SIDE_CHUNKS, step=1.0)
    s = merged.select("qid", F.col("rank").alias("chunk_rank"), F.posexplode(T.sentences_keeping_initials(F.col("text"))).alias("idx", "sentence"))
    score = ranking.side_sentence_score(F.col("sentence"), T.without_article(F.col("qid.entity")), list(gates.INTENT_MARKS["features"])) + F.greatest(F.lit(0.0), 2.5 - 0.3 * (F.col("chunk_rank") - 1))
    s = selection.keep_first(s.withColumn("score", score), [F.col("qid"), T.dedup_key(F.col("sentence"))], [F.col("chunk_rank"), F.col("idx")])
    own = F.exists(T.entity_terms(T.without_article(F.col("qid.entity"))), lambda e: F.contains(T.dedup_key(F.col("sentence")), T.dedup_key(e)))
    five = top(s.where((F.col("score") > 0) & own), 5, ["qid"], F.desc("score"), F.asc("chunk_rank"), F.asc("idx"), rank="pos")
    said = five.groupBy("qid").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "sentence"))), lambda x: x["sentence"]).alias("sentences"))
    enough = gates.side_sufficient(F.col("merged"), F.size("sentences")) & gates.side_confidence(F.col("sentences"), F.col("qid.entity"), F.lit(False))["sufficient"]
    side = said.join(merged.groupBy("qid").agg(F.count("*").alias("merged")), "qid").withColumn("enough", enough).select("qid.qid", "qid.side", "sentences", "enough")
    left, right = (side.where(F.col("side") == k).select("qid", F.col("sentences").alias(f"{n}_sentences"), F.col("enough").alias(f"{n}_enough")) for k, n in ((0, "left"), (1, "right")))
    return left.join(right, "qid").select("qid", "left_sentences", "right_sentences", (F.col("left_enough") & F.col("right_enough")).alias("both_sufficient"))


#: Names that a second hop takes from the evidence of the first, and sentences of the second hop.
HOP_NAMES, HOP_SENTENCES = 3, 5


def second_hops(found: DataFrame, chunks: DataFrame, kept: Index | None = None) -> DataFrame:
    """qid, first, second, hop_answer (of both parts, or null), hop_sentences of multi-hop questions (qid, question, sentences): what the second part asks is looked for with the
    names that answer the first part, or else with those of its evidence, for all questions at once.

    The second query exists only after the first retrieval; it asks for a name that the question itself does not have, and of what is found
    only sentences with such a name count."""
    q = F.col("question")
    multi = found.where(R.any_match(F.lower(questions.bare(q)), questions.HOPS))
    first, second = questions.hops(q)
    names = F.array_distinct(F.flatten(F.transform(F.coalesce("sentences", F.array().cast("array<string>")), T.person_names)))
    new = F.slice(F.filter(names, lambda n: ~F.contains(F.lower(q), F.lower(n))), 1, HOP_NAMES)
    asked = stored(multi.select("qid", first.alias("first"), second.alias("second"), "sentences", new.alias("names")).where("second is not null"), "multi_hop")
    if not asked.limit(1).count():
        return asked.select("qid", "first", "second", F.lit(None).cast("string").alias("hop_answer"), F.array().cast("array<string>").alias("hop_sentences"))
    own = answer_of(F.col("first"), F.coalesce("sentences", F.array().cast("array<string>")))
    asked = asked.withColumn("first_answer", own)
    answered = T.person_names(F.coalesce("first_answer", F.lit("")))
    asked = asked.withColumn("names", F.when(F.size(answered) > 0, answered).otherwise(F.col("names")))
    asked = stored(asked.select("qid", "first", "second", "first_answer", "names", F.concat_ws(" ", F.lit("about"), F.array_join("names", " "), F.col("second")).alias("query")), "hops")
    hits = retrieved(chunks, asked.select("qid", F.col("query").alias("question")), PER_QUERY, kept)
    s = hits.join(small(asked, of=asked), "qid").select("qid", "query", "names", F.col("rank").alias("chunk_rank"), F.posexplode(T.sentences_keeping_initials(F.col("text"))).alias("idx", "sentence"))
    score = ranking.sentence_score(F.col("sentence"), F.col("query"), F.array_join("names", " "), F.col("chunk_rank"), F.lit(0.0))
    s = selection.keep_first(s.withColumn("score", F.round(score, 6)), [F.col("qid"), T.dedup_key(F.col("sentence"))], [F.col("chunk_rank"), F.col("idx")])
    s = s.where((F.size("names") == 0) | F.exists("names", lambda n: F.contains(F.lower("sentence"), F.lower(n))))
    best = selection.budget_selection(s, HOP_SENTENCES)
    said = best.groupBy("qid").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "sentence"))), lambda x: x["sentence"]).alias("hop_sentences"))  # five at most
    rows = asked.join(small(said, of=asked), "qid", "left").withColumn("hop_sentences", F.coalesce("hop_sentences", F.array().cast("array<string>")))
    both = F.concat("first_answer", F.lit(" "), answer_of(F.col("second"), F.col("hop_sentences")))
    return stored(rows.select("qid", "first", "second", both.alias("hop_answer"), "hop_sentences"), "second_hops")


def answer_of(question: Column, sentences: Column) -> Column:
    """The answer to one part of a question as a sentence, or null."""
    return synthesis.formatted(question, synthesis.sentence_answer(question, sentences))


def premise(question: Column, sentences: Column) -> Column:
    """struct(asserted, stated): whether the question asserts a relation, and the first sentence that states it with both its sides, or null."""
    relation, source, target = questions.asserted(question)
    parts = F.struct(sentences.alias("ss"), relation.alias("relation"), source.alias("source"), target.alias("target"))
    return R.let(parts, lambda x: F.struct(x["relation"].isNotNull().alias("asserted"), F.when(x["relation"].isNotNull(), gates.premise_sentence(x["ss"], x["source"], x["target"], gates.marks_of(x["relation"], gates.RELATION_MARKS), 0.6)).alias("stated")))


def indexed_answers(asked: DataFrame, kept: Index, runtime: bool = True) -> DataFrame:
    """``answers`` over a stored index, such as ``jobs/ingest_index.py`` keeps; its chunks count as ingested."""
    chunks = kept.table("chunks").select("chunk_id", "text", F.lit(runtime).alias("runtime"))
    return answers(asked, chunks, kept)


def answers(asked: DataFrame, chunks: DataFrame, kept: Index | None = None) -> DataFrame:
    """qid, question, intent, subject, answer, answer_type, supported, stage, sources, support, ask_model for each question (qid, question).

    ``chunks`` has chunk_id, text, runtime; ``kept`` is their index, if there is one. A refused request has an answer_type of its own and no sources.

    ``support`` is the reasoning support of the evidence; a question without an answer whose support suffices may go to a model (``ask_model``)."""
    error = gates.request_error(F.col("question"), F.lit(SOURCES))
    good = asked.where(error.isNull())
    plans = stored(questions.plan(good), "plans")
    queries = stored(questions.expanded(plans), "queries")
    of_sides = stored(side_queries(plans), "sides")
    key = lambda side: F.struct("qid", side.alias("side"), F.col("query_rank").cast("int").alias("query_rank")).alias("qid")
    every = queries.select(key(F.lit(-1)), F.col("query").alias("question")).unionByName(of_sides.select(key(F.col("side")), F.col("query").alias("question")))
    hits = stored(retrieved(chunks, stored(every, "asked"), SIDE_QUERY, kept).select("qid.*", "chunk_id", "text", "runtime", "rank", "final"), "hits")
    found = evidence(hits.where((F.col("side") == -1) & (F.col("rank") <= PER_QUERY)).drop("side"), queries, plans)
    pairs = sides(hits.join(small(of_sides.drop("query"), of=of_sides), ["qid", "side", "query_rank"]))
    rows = stored(plans.join(found, "qid", "left").join(pairs, "qid", "left"), "evidence")
    rows = rows.join(second_hops(rows, chunks, kept), "qid", "left")
    cited = rows.select("qid", "question", F.explode("sources").alias("s")).select("qid", "question", "s.*")
    conflict = gates.conflicts(gates.evidence_pairs(cited))

    empty = F.array().cast("array<string>")
    said = F.coalesce("sentences", empty)
    more = F.array_union(said, F.coalesce("hop_sentences", empty))
    rows = rows.join(conflict, "qid", "left").withColumn("said", F.when(F.col("intent") == "general", said).otherwise(more))
    q = F.col("question")
    clash, support = F.coalesce("conflict", F.lit(False)), F.coalesce("sufficient", F.lit(False))
    compared = F.when(F.col("both_sufficient"), synthesis.compared(T.capitalized(F.col("left")), T.capitalized(F.col("right")), F.col("left_sentences"), F.col("right_sentences"), F.regexp_like(F.lower(q), F.lit("fall|fell|decline|collapse"))))
    rows = rows.withColumns({"a": synthesis.answered(q, F.col("intent"), F.col("subject"), F.col("said"), support, clash), "compared": compared, "p": premise(q, F.col("said"))})
    reasoned = F.struct(*(c.alias(k) for k, c in gates.reasoning_support(q, F.col("said"), F.coalesce("best_score", F.lit(0.0))).items()))
    rows = rows.withColumns({"g": reasoned, "hop": F.when(F.col("intent") == "general", F.col("hop_answer"))})
    texts = F.transform(F.coalesce("sources", F.array().cast("array<struct<rank:int,id:bigint,score:double,text:string>>")), lambda x: x["text"])
    comparison = F.col("intent") == "comparison"
    traced = comparison | gates.traceable(F.col("a.answer"), texts)
    refused = F.struct(F.lit(gates.REFUSAL).alias("answer"), F.lit("system").alias("kind"), F.lit(False).alias("ok"))
    final = (
        F.when(comparison & F.col("compared").isNotNull(), F.struct(F.col("compared").alias("answer"), F.lit("comparison").alias("kind"), F.lit(True).alias("ok")))
        .when(comparison, refused).when(F.col("p.asserted") & F.col("p.stated").isNotNull() & ~clash, F.struct(F.col("p.stated").alias("answer"), F.lit("premise").alias("kind"), F.lit(True).alias("ok")))
        .when(F.col("p.asserted") & ~clash, refused).when(F.col("hop").isNotNull() & ~clash, F.struct(F.col("hop").alias("answer"), F.lit("multi_hop").alias("kind"), F.lit(True).alias("ok")))
        .when(F.col("a.ok") & ~traced, refused).otherwise(F.col("a"))
    )
    cites = F.transform("sources", lambda x: F.struct(x["rank"].alias("rank"), x["id"].alias("id"), F.left(x["text"], F.lit(240)).alias("preview"), x["score"].alias("score")))
    rows = rows.withColumn("f", final).select("qid", "question", "intent", "subject", "f.answer", F.col("f.kind").alias("answer_type"), F.col("f.ok").alias("supported"), "stage", cites.alias("sources"), F.col("g.support").alias("support"), (~F.col("f.ok") & ~clash & ~comparison & ~F.col("p.asserted") & F.col("g.sufficient")).alias("ask_model"))
    bad = asked.where(error.isNotNull()).select("qid", "question", *(F.lit(None).cast("string").alias(c) for c in ("intent", "subject")), F.lit(gates.REFUSAL).alias("answer"), error.alias("answer_type"), F.lit(False).alias("supported"), F.lit(None).cast("int").alias("stage"), F.lit(None).cast("array<struct<rank:int,id:bigint,preview:string,score:double>>").alias("sources"), F.lit(None).cast("double").alias("support"), F.lit(False).alias("ask_model"))
    return rows.unionByName(bad)
