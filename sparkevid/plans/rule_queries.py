"""Queries of the rules. The driver's documents are of invented words, so each document fills one of some written patterns with its own
words (``of_documents``), and the rules run over these; their SQL does the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T
from ..operators import answering, etl, gates, ranking, selection, synthesis
from ..operators import questions as Q
from ..session import spread, table
from .common import KEY, PLAIN, SENTENCES, TERMS, WORDS, frame, literal, of_documents, of_documents_sql, values

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


QUESTIONS = [
    (1, "Why did the Velan League decline?"), (2, "Compare the Velan League and the Orsk Union"), (3, "What is the significance of the Harbor Charter?"), (4, "What were the effects of the long drought?"),
    (5, "How did river trade change over time?"), (6, "What were the main features of the Orsk Union?"), (7, "What is the structure of a tidal gate?"), (8, "Who were the key figures of the Velan League?"),
    (9, "Explain how a tidal gate works."), (10, "When was Mara Tolle born?"), (11, "When was the Harbor Board founded?"), (12, "What was Port Ansel named after?"), (13, "Where is Port Ansel located?"),
    (14, "Why was the Harbor Charter important?"), (15, "What happened after the Velan League fell?"), (16, "How do mills differ from presses?"), (17, "why did Port Ansel fall?"), (18, "When did Mara Tolle discover the north channel?"),
    (19, "What were the effects of the long drought on river trade and why did it end?"), (20, "What is the population of Port Ansel?"), (21, "  Describe the changes in   river trade  "), (22, "How did the Harbor Charter limit the League?"),
    (23, "Write a poem about rivers"), (24, "Salt"), (25, "What caused the long drought?"), (26, "When was the Tide Atlas published?"), (27, "How was the drought responsible for hunger?"), (28, "Mills versus presses"),
]
QS = of_documents_sql(QUESTIONS, "qid, question")
_N = "trim(regexp_replace(question, '[ \\t\\n]+', ' ', 'g'))"
_L = f"lower({_N})"
_B = f"regexp_replace({_N}, '[?.!]+$', '')"


def asked(spark, sf_dir):
    return of_documents(spark, sf_dir, QUESTIONS, "qid long, question string")


def _clean(sql: str) -> str:
    c = f"trim(regexp_replace({sql}, '[ \\t\\n]+', ' ', 'g'))"
    c = f"regexp_replace(regexp_replace({c}, '^[ :,-]+', ''), '[?.!]+$', '')"
    return f"trim(regexp_replace({c}, '(?i)^(?:explain|describe) +', ''))"


def _simple(name: str, columns: Callable[[], dict], sql: dict[str, str]) -> None:
    """A query of one expression a column over the fixture questions."""

    def run(spark, sf_dir):
        return asked(spark, sf_dir).select("qid", *(c.alias(k) for k, c in columns().items()))

    run.__name__ = name
    query(f"SELECT qid, {', '.join(f'{v} AS {k}' for k, v in sql.items())} FROM {QS}")(run)




def _q():
    return F.col("question")


def _lower():
    return F.lower(Q.normalized(_q()))


_simple("intent_classify", lambda: {"intent": Q.intent(_q())}, {"intent": R.first_match_sql(_L, Q.INTENTS, "general")})
_simple("route_classify", lambda: {"route": Q.route(_q())}, {"route": f"CASE WHEN {R.any_match_sql(_L, Q.ANALYTICAL)} THEN 'model' WHEN {R.any_match_sql(_L, Q.EXTRACTIVE)} THEN 'extractor' ELSE 'model' END"})
_simple("forced_route", lambda: {"route": F.when(Q.intent(_q()) != "general", "model").otherwise(Q.route(_q()))}, {"route": f"CASE WHEN ({R.first_match_sql(_L, Q.INTENTS, 'general')}) <> 'general' OR {R.any_match_sql(_L, Q.ANALYTICAL)} OR NOT {R.any_match_sql(_L, Q.EXTRACTIVE)} THEN 'model' ELSE 'extractor' END"})
_simple(
    "question_tests",
    lambda: {"factual": R.any_match(_lower(), Q.FACTUAL), "effect": R.any_match(_lower(), Q.EFFECT_QUESTIONS), "change": R.any_match(_lower(), Q.CHANGE_QUESTIONS), "multi_hop": R.any_match(_lower(), Q.HOPS)},
    {"factual": R.any_match_sql(_L, Q.FACTUAL), "effect": R.any_match_sql(_L, Q.EFFECT_QUESTIONS), "change": R.any_match_sql(_L, Q.CHANGE_QUESTIONS), "multi_hop": R.any_match_sql(_L, Q.HOPS)},
)
_simple("comparison_pair", lambda: dict(zip(("left", "right"), Q.pair(_q()), strict=True)), {k: f"CASE WHEN lower({_clean(R.first_group_sql(_B, Q.PAIRS, 1))}) <> lower({_clean(R.first_group_sql(_B, Q.PAIRS, 2))}) THEN {_clean(R.first_group_sql(_B, Q.PAIRS, g))} END" for k, g in (("left", 1), ("right", 2))})
_ap = [p for _, p in Q.ASSERTED]
_simple("asserted_relation", lambda: dict(zip(("relation", "source", "target"), Q.asserted(_q()), strict=True)), {"relation": R.first_match_sql(_B, Q.ASSERTED), "source": _clean(R.first_group_sql(_B, _ap, 1)), "target": _clean(R.first_group_sql(_B, _ap, 2))})
_simple("causal_parse", lambda: {"relation": R.first_match(Q.bare(_q()), Q.CAUSAL_QUESTIONS), "subject": R.first_group(Q.bare(_q()), [p for _, p in Q.CAUSAL_QUESTIONS])}, {"relation": R.first_match_sql(_B, Q.CAUSAL_QUESTIONS), "subject": R.first_group_sql(_B, [p for _, p in Q.CAUSAL_QUESTIONS])})
_simple("premise_parse", lambda: {"relation": R.first_match(Q.bare(_q()), Q.PREMISES), "source": R.first_group(Q.bare(_q()), [p for _, p in Q.PREMISES], 1), "target": R.first_group(Q.bare(_q()), [p for _, p in Q.PREMISES], 2)}, {"relation": R.first_match_sql(_B, Q.PREMISES), "source": R.first_group_sql(_B, [p for _, p in Q.PREMISES], 1), "target": R.first_group_sql(_B, [p for _, p in Q.PREMISES], 2)})
_simple("question_modes", lambda: {"summary_mode": R.first_match(_lower(), Q.SUMMARY_MODES, "none"), "ui_intent": R.first_match(_lower(), Q.UI_INTENTS, "hybrid"), "type": R.first_match(_lower(), Q.TYPES, "other")}, {"summary_mode": R.first_match_sql(_L, Q.SUMMARY_MODES, "none"), "ui_intent": R.first_match_sql(_L, Q.UI_INTENTS, "hybrid"), "type": R.first_match_sql(_L, Q.TYPES, "other")})
_simple("predicate_lookup", lambda: {"predicate": Q.predicate(_q())}, {"predicate": f"list_filter({literal(sorted(Q.PREDICATES, key=lambda p: (-len(p), p)))}, lambda p: contains(lower(question), p))[1]"})
_rel = [(n, "named after" if n == "named_after" else p) for n, p, _ in ranking.RELATIONS]
_sp = [f"(?i){p}" for _, p, _ in ranking.RELATIONS] + [r"(?i)^why did (.+) fall\??$", r"(?i)^why was (.+?) .+?\??$"]
_sub_sql = "coalesce(" + ", ".join(f"nullif(regexp_replace(trim(regexp_extract(trim(question), {literal(p)}, 1)), '[.?!]+$', ''), '')" for p in _sp) + ")"
_simple("factual_relation", lambda: {"relation": ranking.relation(_q()), "subject": ranking.relation_subject(_q())}, {"relation": R.first_match_sql("lower(trim(question))", _rel), "subject": _sub_sql})
_h1 = f"coalesce({R.first_group_sql(_B, ('(?i)(effects? of .+?) on .+$',))}, {R.first_group_sql(_B, ('(?i)^(.+?) (?:and|or|because|since|as a result of) .+$',))})"
_h2 = f"coalesce({R.first_group_sql(_B, ('(?i)effects? of .+? on (.+)$',))}, {R.first_group_sql(_B, ('(?i)^.+? (?:and|or|because|since|as a result of) (.+)$',))})"
_content = "list_filter(regexp_extract_all(lower({}), '[a-z0-9'']+'), lambda w: length(w) >= 2 AND NOT list_contains(" + literal(T.STOPWORDS) + ", w))"
_simple("hop_split", lambda: dict(zip(("first", "second"), Q.hops(_q()), strict=True)), {"first": _h1, "second": f"CASE WHEN len({WORDS.format(_h2)}) <= 3 THEN {_h2} || ' ' || array_to_string({_content.format(_h1)}, ' ') ELSE {_h2} END"})


def _subject_sql() -> str:
    cases = " ".join(f"WHEN '{k}' THEN {R.first_group_sql(_B, p)}" for k, p in Q.SUBJECTS.items())
    return _clean(f"coalesce(CASE intent {cases} END, {_B})")


def _effect_sql(c: str) -> str:
    for verb, noun in (("fell", "fall"), ("collapsed", "collapse")):
        c = f"regexp_replace({c}, '(?i)^(.+?) {verb}$', 'the {noun} of \\1')"
        c = f"regexp_replace({c}, '(?i)^(.+?)(?:''s|’s) {noun}$', 'the {noun} of \\1')"
    return c


_LEFT, _RIGHT = (f"CASE WHEN lower({_clean(R.first_group_sql(_B, Q.PAIRS, 1))}) <> lower({_clean(R.first_group_sql(_B, Q.PAIRS, 2))}) THEN {_clean(R.first_group_sql(_B, Q.PAIRS, g))} END" for g in (1, 2))
_PLAN = f"""p0 AS (SELECT qid, question, {_LEFT} AS "left", {_RIGHT} AS "right", {R.first_match_sql(_L, Q.INTENTS, "general")} AS found FROM {QS}),
p1 AS (SELECT *, CASE WHEN found = 'comparison' AND "left" IS NULL THEN 'general' ELSE found END AS intent FROM p0),
p2 AS (SELECT *, {_subject_sql()} AS s FROM p1),
p3 AS (SELECT qid, question, intent, CASE WHEN intent = 'effect' THEN {_effect_sql("s")} ELSE s END AS subject, "left", "right" FROM p2),
plans AS (SELECT *, {R.template_sql("intent", Q.CANONICAL, subject="subject", left='"left"', right='"right"')} AS canonical FROM p3)"""


@query(f'WITH {_PLAN} SELECT qid, intent, subject, "left", "right", canonical FROM plans')
def question_plan(spark, sf_dir):
    return Q.plan(asked(spark, sf_dir)).drop("question")


@query(
    f"""WITH {_PLAN}, t AS (SELECT * FROM {values([(r, p, i, x) for i, r, p, x in Q.TEMPLATES], "rank, primary_q, intent, template")}),
i AS (SELECT qid, 1 AS query_rank, true AS is_primary, {_N} AS query FROM plans UNION ALL SELECT qid, 2, true, canonical FROM plans
  UNION ALL SELECT qid, rank, primary_q, replace(replace(replace(template, '{{subject}}', subject), '{{left}}', coalesce("left", '')), '{{right}}', coalesce("right", '')) FROM plans JOIN t USING (intent)
  UNION ALL SELECT qid, 3, false, array_to_string({_content.format("question")}, ' ') FROM plans WHERE intent = 'general')
SELECT qid, query_rank, is_primary, query FROM (SELECT *, row_number() OVER (PARTITION BY qid, lower(query) ORDER BY query_rank) AS r FROM i WHERE query IS NOT NULL AND query <> '') WHERE r = 1"""
)
def query_expand(spark, sf_dir):
    return Q.expanded(Q.plan(asked(spark, sf_dir)))


@query(f"WITH {_PLAN} SELECT intent, count(*) AS n FROM plans GROUP BY intent")
def type_counts(spark, sf_dir):
    return Q.plan(asked(spark, sf_dir)).groupBy("intent").agg(F.count("*").alias("n"))


EFFECTS = [(1, "the Velan League fell"), (2, "Port Ansel collapsed"), (3, "the League's fall"), (4, "river trade")]


@query(f"SELECT id, {_effect_sql('s')} AS subject FROM {of_documents_sql(EFFECTS, 'id, s')}")
def effect_rewrite(spark, sf_dir):
    return of_documents(spark, sf_dir, EFFECTS, "id long, s string").select("id", Q.effect_subject(F.col("s")).alias("subject"))


_SHORT = "trim(regexp_replace(lower(s), ' (?:empire|kingdom|republic|state)$', ''))"
NAMES = [(1, "  : the Velan Empire??"), (2, "explain a Tidal gate."), (3, "Orsk Republic"), (4, "Describe An old mill"), (5, "salt")]


@query(f"""SELECT id, {_clean("s")} AS subject, trim(regexp_replace({_clean("s")}, '(?i)^(?:the|a|an) +', '')) AS bare, upper(left(s, 1)) || substring(s, 2) AS capital,
CASE WHEN lower(s) = {_SHORT} THEN lower(s) ELSE lower(s) || '|' || {_SHORT} END AS terms FROM {of_documents_sql(NAMES, "id, s")}""")
def subject_cleanup(spark, sf_dir):
    s = F.col("s")
    d = of_documents(spark, sf_dir, NAMES, "id long, s string")
    return d.select("id", T.clean_subject(s).alias("subject"), T.without_article(s).alias("bare"), T.capitalized(s).alias("capital"), F.array_join(T.entity_terms(s), "|").alias("terms"))


_ITEMS = "regexp_extract_all(text, '[A-Za-z]{4,12}')[1:doc_id % 5]"


@query(f"SELECT doc_id AS id, CASE len(x) WHEN 0 THEN NULL WHEN 1 THEN x[1] WHEN 2 THEN x[1] || ' and ' || x[2] ELSE array_to_string(x[:len(x) - 1], ', ') || ', and ' || x[len(x)] END AS said FROM (SELECT doc_id, {_ITEMS} AS x FROM documents)")
def natural_join(spark, sf_dir):
    """Lists of none to four words of each document."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.regexp_extract_all("text", F.lit("[A-Za-z]{4,12}"), F.lit(0)).alias("w"))
    d = d.select("id", F.slice("w", F.lit(1), (F.col("id") % 5).cast("int")).alias("x"))
    return d.select("id", T.natural_list(F.col("x")).alias("said"))


@query(f"SELECT doc_id, CASE WHEN len({WORDS.format('text')}) <= 32 THEN md5(text) ELSE md5(regexp_replace(array_to_string(({WORDS.format('text')})[1:32], ' '), '[,;:. ]+$', '') || '.') END AS digest FROM documents")
def shorten_text(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents")).select("doc_id", F.md5(T.shortened(F.col("text"), 32)).alias("digest"))


CONTEXTS = [
    (1, "When was Mara Tolle born?", "Mara Tolle was born in 1871 in Port Ansel. She led the Board.", "1871"),
    (2, "When was the Harbor Board founded?", "The Harbor Board was founded in 1902; it grew quickly.", "1902"),
    (3, "What was Port Ansel named after?", "Port Ansel was named after Ansel Roe, a pilot.", "Ansel Roe, a pilot"),
    (4, "Why did Port Ansel fall?", "Port Ansel finally fell after a long siege of the harbor. Trade stopped.", "a long siege of the harbor."),
    (5, "Why did the Velan League decline?", "The League declined because its fleets were lost; debts rose.", "Because its fleets were lost."),
    (6, "What caused the long drought?", "The drought was due to a shift of the winds.", "It was due to a shift of the winds."),
    (7, "When was the Tide Atlas published?", "The Tide Atlas lists tides.", None),
    (8, "When was the Tide Atlas published?", "The Tide Atlas was published in 1910.", "1911"),
    (9, "When was Mara Tolle born?", "Mara Tolle was born on May 4 , 1871 near the coast.", "May 4 , 1871"),
    (10, "Why did it end?", "aaaaaaaa", "aaaaaaaaaaaa"),
    (11, "When was the Guild established?", "The Guild was established in 1880.", "1880"), (12, "When was the film released?", "The film was released in 1951.", "1951"),
]
CS = of_documents_sql(CONTEXTS, "qid, question, context, answer")


def contexts(spark, sf_dir):
    return of_documents(spark, sf_dir, CONTEXTS, "qid long, question string, context string, answer string")


def _extract_sql(q: str, c: str) -> str:
    found = []
    for asked_, pattern, form, least, most in synthesis.EXTRACT_RULES:
        v = f"trim(regexp_replace(regexp_extract({c}, {literal(pattern)}, 1), '\\s+', ' ', 'g'))"
        head, tail = form.split("{}")
        found.append(f"CASE WHEN regexp_matches(lower(trim({q})), {literal(asked_)}) AND length({v}) BETWEEN {least} AND {most} AND {v} <> '' THEN {literal(head)} || {v} || {literal(tail)} END")
    return f"coalesce({', '.join(found)})"


@query(f"SELECT qid, {_extract_sql('question', 'context')} AS answer FROM {CS}")
def rule_extract(spark, sf_dir):
    return contexts(spark, sf_dir).select("qid", synthesis.rule_extract(_q(), F.col("context")).alias("answer"))


def _confidence_sql() -> str:
    q, c = "lower(trim(question))", "regexp_replace(lower(context), '\\s+', ' ', 'g')"
    a = "regexp_replace(regexp_replace(regexp_replace(lower(trim(answer)), '\\s+', ' ', 'g'), '^(?:because |it was due to |it happened as a result of )', ''), '\\.+$', '')"
    stated = " ".join(f"WHEN contains({q}, '{w}') THEN regexp_matches({c}, {literal(p)})" for w, p in gates.RELATION_STATED)
    repeat = "|".join(f"{ch}{{6,}}" for ch in "abcdefghijklmnopqrstuvwxyz")
    return f"""CASE WHEN coalesce(answer, '') = '' THEN 0.0 ELSE round(greatest(0.0, least(1.0, CASE WHEN {a} <> '' AND contains({c}, {a}) THEN 0.5 ELSE 0 END
+ CASE WHEN CASE {stated} WHEN starts_with({q}, 'why ') OR starts_with({q}, 'what caused ') THEN regexp_matches({c}, {literal(gates.CAUSE_STATED)}) ELSE false END THEN 0.35 ELSE 0 END
+ CASE WHEN len({WORDS.format("answer")}) BETWEEN 1 AND 45 THEN 0.1 ELSE 0 END - CASE WHEN length(answer) > 300 THEN 0.3 ELSE 0 END - CASE WHEN regexp_matches(answer, '{repeat}') THEN 0.3 ELSE 0 END)), 6) END"""


@query(f"SELECT qid, {_confidence_sql()}::DOUBLE AS confidence FROM {CS}")
def extract_confidence(spark, sf_dir):
    return contexts(spark, sf_dir).select("qid", gates.extraction_confidence(_q(), F.col("context"), F.col("answer")).alias("confidence"))


def _bonus_sql(born: float, other: float, stage: int) -> str:
    c, s = "lower(context)", f"lower({_sub_sql})"
    rel = R.first_match_sql("lower(trim(question))", _rel)
    cases = []
    for name, _, word in ranking.RELATIONS:
        w, reach = (r"(?:was\s+)?born", 60) if name == "born" else (word, 80)
        esc = f"regexp_replace({s}, '([.?*+(){{}}\\[\\]\\\\^$|])', '\\\\\\1', 'g')"
        direct = f"regexp_matches({c}, '\\b' || {esc} || '\\b.{{0,{reach}}}\\b{w}\\b')"
        reverse = f"regexp_matches({c}, '\\b{w}\\b.{{0,{reach}}}\\b' || {esc} || '\\b')"
        if stage == 1:
            v = f"CASE WHEN {direct} THEN 40.0 ELSE 0 END + CASE WHEN {reverse} THEN 30.0 ELSE 0 END + CASE WHEN regexp_matches({c}, '\\bborn\\s+(?:on|in)\\b') THEN 2.0 ELSE 0 END + CASE WHEN regexp_matches({c}, '\\b(?:18|19|20)\\d{{2}}\\b') THEN 2.0 ELSE 0 END" if name == "born" else f"CASE WHEN {direct} THEN 36.0 WHEN contains({c}, '{word}') THEN 6.0 ELSE 0 END"
            cases.append(f"WHEN ({rel}) = '{name}' THEN {v}")
        else:
            v = f"CASE WHEN {direct} THEN 30.0 WHEN {reverse} THEN 20.0 ELSE 0 END" if name == "born" else f"CASE WHEN {direct} THEN 24.0 ELSE 0 END"
            cases.append(f"CASE WHEN contains(lower(question), '{word}') AND {s} IS NOT NULL THEN {v} ELSE 0 END")
    if stage == 1:
        return f"CASE WHEN ({rel}) IS NOT NULL AND {s} IS NOT NULL AND contains({c}, {s}) THEN 8.0 + CASE {' '.join(cases)} ELSE 0 END ELSE 0.0 END"
    causal = " + ".join(f"CASE WHEN starts_with(lower(question), 'why ') AND contains({c}, '{m}') THEN 4.0 ELSE 0 END" for m in ranking.CAUSAL)
    return f"{' + '.join(cases)} + {causal} + CASE WHEN coalesce(contains({c}, {s}), false) THEN 10.0 ELSE 0 END"


@query(f"SELECT qid, ({_bonus_sql(40, 36, 1)})::DOUBLE AS factual, ({_bonus_sql(30, 24, 2)})::DOUBLE AS pattern FROM {CS}")
def candidate_bonus(spark, sf_dir):
    c = F.col("context")
    return contexts(spark, sf_dir).select("qid", ranking.factual_bonus(_q(), c).alias("factual"), ranking.pattern_bonus(_q(), c).alias("pattern"))


@query(
    f"""WITH h AS (SELECT a.qid, b.qid AS chunk_id, a.question, b.context, len(list_intersect({TERMS.format("a.question")}, {TERMS.format("b.context")}))::DOUBLE AS lexical FROM {of_documents_sql(CONTEXTS, "qid, question, context, answer", "a")} JOIN {of_documents_sql(CONTEXTS, "qid, question, context, answer", "b")} ON a.qid // 12 = b.qid // 12),
s AS (SELECT qid, chunk_id, lexical, lexical + {_bonus_sql(40, 36, 1)} AS score, question, context FROM h WHERE lexical > 0),
k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, lexical DESC, chunk_id) AS r FROM s),
f AS (SELECT qid, chunk_id, lexical, score + {_bonus_sql(30, 24, 2)} AS final FROM k WHERE r <= 20)
SELECT qid, chunk_id, final, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY final DESC, lexical DESC, chunk_id) AS rank FROM f) WHERE rank <= 5"""
)
def rerank_topk(spark, sf_dir):
    """Candidates are of their question's dozen and share a term with it, which is an equi-join, then two bonus stages."""
    c = contexts(spark, sf_dir).withColumn("dozen", F.floor(F.col("qid") / 12))
    a = c.select("dozen", "qid", "question", F.explode(T.terms(_q())).alias("term"))
    b = c.select("dozen", F.col("qid").alias("chunk_id"), F.col("context").alias("text"), F.explode(T.terms(F.col("context"))).alias("term"))
    hits = a.join(b, ["dozen", "term"]).groupBy("qid", "question", "chunk_id", "text").agg(F.count("*").cast("double").alias("lexical"))
    hits = hits.withColumn("score", F.col("lexical") + ranking.factual_bonus(_q(), F.col("text")))
    return ranking.reranked(ranking.candidates(hits)).select("qid", "chunk_id", "final", "rank")


@query(
    f"""WITH s AS (SELECT qid, question, context, {SENTENCES.format("context")} AS ss, {TERMS.format("question")} AS asked FROM {CS}),
o AS (SELECT *, greatest(len(asked), 1) AS n, list_transform(ss, lambda x: len(list_intersect({TERMS.format("x")}, asked)) / greatest(len(asked), 1)) AS ov, len(list_filter(asked, lambda t: len(list_filter(ss, lambda x: list_contains({TERMS.format("x")}, t))) > 0)) AS matched FROM s),
r AS (SELECT *, matched / n AS coverage, coalesce(list_max(ov), 0.0) AS best, len(list_filter(ov, lambda x: x >= 0.5)) AS strong FROM o),
z AS (SELECT *, round(0.45 * coverage + 0.40 * best + 0.15 * least(1.0, 30.0 / 60), 6) AS support FROM r)
SELECT qid, round(coverage, 6) AS coverage, round(best, 6) AS best_overlap, strong::BIGINT AS strong, support, matched >= CASE WHEN len(asked) >= 4 THEN 3 WHEN len(asked) >= 2 THEN 2 ELSE 1 END AND coverage >= 0.55 AND strong >= 1 AND best >= 0.65 AND support >= 0.62 AS sufficient FROM z"""
)
def support_confidence(spark, sf_dir):
    r = gates.reasoning_support(_q(), T.sentences(F.col("context")), F.lit(30.0))
    return contexts(spark, sf_dir).select("qid", *(c.cast("long").alias(k) if k == "strong" else c.alias(k) for k, c in r.items()))


_TRACE = "list_distinct(list_filter(regexp_extract_all(lower({}), '[a-z0-9]{{3,}}'), lambda w: NOT list_contains(" + literal(gates.UNTRACED) + ", w)))"


@query(f"SELECT qid, coalesce(trim(answer) <> '' AND len(list_intersect({_TRACE.format('answer')}, {_TRACE.format('context')})) >= CASE WHEN len({_TRACE.format('answer')}) <= 4 THEN 1 ELSE 2 END, false) AS traceable FROM {CS}")
def traceability(spark, sf_dir):
    return contexts(spark, sf_dir).select("qid", F.coalesce(gates.traceable(F.col("answer"), F.array("context")), F.lit(False)).alias("traceable"))


@query(
    f"""SELECT qid, len(list_filter({WORDS.format("lower(answer)")}, lambda w: length(w) > 3 AND contains(lower(context), w))) > 0 AS grounded,
CASE WHEN len(list_filter({PLAIN.format("answer")}, lambda w: length(w) >= 4)) > 0 THEN round(len(list_filter({PLAIN.format("answer")}, lambda w: length(w) >= 4 AND contains(lower(context), w))) / len(list_filter({PLAIN.format("answer")}, lambda w: length(w) >= 4)), 6) ELSE 0.0 END AS overlap,
length(question) BETWEEN 10 AND 200 AND length(answer) BETWEEN 3 AND 220 AND length(answer) - length(replace(answer, ',', '')) <= 4 AND NOT regexp_matches(lower(answer), '^(?:and|or|but|which|that|who)\\b') AND NOT regexp_matches(lower(answer), '\\b(?:and|or|of|the|a|an|to|in|by)[ .]*$') AS kept FROM {CS} WHERE answer IS NOT NULL"""
)
def example_filter(spark, sf_dir):
    a, c = F.col("answer"), F.col("context")
    return contexts(spark, sf_dir).where("answer is not null").select("qid", gates.grounded(a, c).alias("grounded"), F.round(gates.answer_overlap(a, c), 6).alias("overlap"), gates.example_kept(_q(), a).alias("kept"))


FACTS = [
    (1, "Mara Tolle was born in 1871 in Port Ansel. The Harbor Board was founded in 1902. It was founded in 1903."), (2, "Port Ansel is located in Northern Vela. Port Ansel had a population of 12,400. Port Ansel is the capital of Vela."),
    (3, "Port Ansel was named after Ansel Roe. The mill closed because the river ran dry for many years. The Tide Atlas was published in 1910."), (4, "Nothing is stated here at all, really nothing. The old gate opened in 1888."),
    (5, "The Harbor Board was founded in 1902. The shortage was caused by a shift of the winds over the sea."),
]
FS = of_documents_sql(FACTS, "doc_id, text")


def facts(spark, sf_dir):
    return of_documents(spark, sf_dir, FACTS, "doc_id long, text string")


def _trim_sql(c: str) -> str:
    return f"regexp_replace({c}, '^[ ,.;:-]+|[ ,.;:-]+$', '', 'g')"


def _mined_sql(s: str) -> str:
    found = []
    for kind, pattern, question in etl.MINING:
        a, b = (_trim_sql(f"regexp_extract({s}, {literal(pattern)}, {g})") for g in (1, 2))
        w = WORDS.format(a)
        valid = f"length({a}) BETWEEN 2 AND 120 AND len({w}) BETWEEN 1 AND 14 AND length({b}) BETWEEN 1 AND 120 AND len(list_filter({w}, lambda w: list_contains({literal(etl.VAGUE)}, regexp_replace(lower(w), '[ ,.;:]+', '', 'g')))) = 0 AND length({a}) - length(replace({a}, ',', '')) <= 1"
        valid += f" AND len({WORDS.format(b)}) <= 10" if kind == "location" else f" AND length({b}) <= 30" if kind == "population" else ""
        head, tail = question.split("{s}")
        found.append(f"CASE WHEN {valid} THEN {{'type': '{kind}', 'question': {literal(head)} || {a} || {literal(tail)}, 'answer': {b}}} END")
    return f"CASE WHEN length({s}) BETWEEN 25 AND 400 THEN coalesce({', '.join(found)}) END"


_MINED = f"""s AS (SELECT doc_id, unnest({SENTENCES.format("text")}) AS s, generate_subscripts({SENTENCES.format("text")}, 1) - 1 AS idx FROM {FS}),
c AS (SELECT *, left(concat_ws(' ', lag(s) OVER o, s, lead(s) OVER o), 1200) AS context FROM s WINDOW o AS (PARTITION BY doc_id ORDER BY idx)),
m AS (SELECT doc_id, idx, context, {_mined_sql("s")} AS m FROM c),
e AS (SELECT doc_id, idx, m.type AS type, m.question AS question, m.answer AS answer, context FROM m WHERE m IS NOT NULL AND contains(lower(context), lower(m.answer)))"""


@query(f"WITH {_MINED} SELECT doc_id, idx, type, question, answer FROM (SELECT *, row_number() OVER (PARTITION BY lower(question), lower(answer) ORDER BY doc_id, idx) AS r FROM (SELECT * FROM e ORDER BY doc_id, idx LIMIT {etl.CAP})) WHERE r = 1")
def qa_mine(spark, sf_dir):
    return etl.first_examples(etl.examples(facts(spark, sf_dir), "doc_id"), "doc_id").drop("context")


@query(f"WITH {_MINED} SELECT doc_id, idx, type, md5('<CONTEXT>' || chr(10) || context || chr(10) || '<QUESTION>' || chr(10) || question || chr(10) || '<ANSWER>' || chr(10) || answer) AS prompt FROM e WHERE list_contains({literal(list(etl.ALLOWED))}, type)")
def qa_prompts(spark, sf_dir):
    e = etl.filtered(etl.examples(facts(spark, sf_dir), "doc_id"))
    return e.select("doc_id", "idx", "type", F.md5(etl.prompt(F.col("context"), F.col("question"), F.col("answer"))).alias("prompt"))


def _reasons_sql(s: str) -> str:
    found = []
    for kind, pattern in etl.REASONS:
        a, b = (_trim_sql(f"regexp_extract({s}, {literal(pattern)}, {g})") for g in (1, 2))
        found.append(f"CASE WHEN {a} <> '' AND length({b}) BETWEEN 8 AND 220 THEN {{'type': '{kind}', 'question': 'Why is it that ' || {a} || '?', 'answer': {b}}} END")
    return f"coalesce({', '.join(found)})"


@query(f"""WITH {_MINED.replace(_mined_sql("s"), _reasons_sql("s")).replace("1200", "1400")} SELECT doc_id, idx, type, question, answer FROM e""")
def why_mine(spark, sf_dir):
    return etl.examples(facts(spark, sf_dir), "doc_id", etl.reasons, 1400).drop("context")


@query(f"SELECT type, count(*) AS n FROM (WITH {_MINED} SELECT type FROM e) GROUP BY type")
def qa_type_counts(spark, sf_dir):
    return etl.examples(facts(spark, sf_dir), "doc_id").groupBy("type").agg(F.count("*").alias("n"))


@query("SELECT doc_id, i, length(trim(text)) > 0 AS has_response FROM documents, (SELECT unnest([1, 2, 3]) AS i) WHERE length(trim(text)) > 0")
def instruction_pick(spark, sf_dir):
    """Which sentence is picked is a matter of the hash; there are three of each text."""
    i = etl.instructions(spread(table(spark, sf_dir, "documents")), "doc_id")
    return i.select("doc_id", "i", (F.length("response") > 0).alias("has_response"))


@query("SELECT count(*) AS n, count(DISTINCT doc_id) AS n_docs, true AS all_differ FROM documents WHERE len(list_filter(regexp_extract_all(lower(text), '[a-z0-9'']+'), lambda w: length(w) >= 2 AND NOT list_contains(" + literal(T.STOPWORDS) + ", w))) > 0")
def embedding_triples(spark, sf_dir):
    t = etl.triples(spread(table(spark, sf_dir, "documents")), "doc_id")
    return t.agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs"), F.bool_and(F.col("doc_id") != F.col("negative")).alias("all_differ"))


EVIDENCE = [
    (1, "What is the warranty period of the pump?", 1, 9.0, "The pump warranty period is 12 months from delivery."), (1, "What is the warranty period of the pump?", 2, 8.5, "The pump warranty period is 24 months from delivery."),
    (2, "Should the valve be open during the test?", 1, 7.0, "Operators must open the inlet valve before the pressure test."), (2, "Should the valve be open during the test?", 2, 6.9, "Operators must close the inlet valve before the pressure test."),
    (3, "Which model is installed?", 1, 5.0, "The installed model identifier is AB-12 at the north station."), (3, "Which model is installed?", 2, 4.9, "The installed model identifier is CD-34 at the north station."),
    (4, "What is the flow of the pump?", 1, 5.0, "The pump flow is 12 liters at the station."), (4, "What is the flow of the pump?", 2, 4.0, "The pump flow is 12 liters at the station."),
    (5, "How long is the pier?", 1, 5.0, "The pier length is 40 meters overall."), (5, "How long is the pier?", 2, 1.0, "The pier length is 90 meters overall."),
    (6, "May the filter be cleaned?", 1, 5.0, "Never clean the filter with acid."), (6, "May the filter be cleaned?", 2, 4.8, "You should clean the filter with acid."),
]


@query(f"SELECT qid, conflict FROM {of_documents_sql([(1, True), (2, True), (3, True), (4, False), (5, None), (6, True)], 'qid, conflict')} WHERE conflict IS NOT NULL")
def conflict_pairs(spark, sf_dir):
    """Number, directive, identifier, none, none within the score's range (so no pair), polarity."""
    s = of_documents(spark, sf_dir, EVIDENCE, "qid long, question string, rank int, score double, text string")
    return gates.conflicts(gates.evidence_pairs(s))


@query(
    f"""WITH s AS (SELECT *, max(score) OVER (PARTITION BY qid) AS m FROM {of_documents_sql(EVIDENCE, "qid, question, rank, score, text")}),
g AS (SELECT * FROM s WHERE score >= 0.7 * m AND len(list_intersect({_TRACE.format("question")}, {_TRACE.format("text")})) > 0)
SELECT a.qid, a.text AS left_text, b.text AS right_text FROM g a JOIN g b ON a.qid = b.qid AND a.rank < b.rank"""
)
def evidence_pairs(spark, sf_dir):
    return gates.evidence_pairs(of_documents(spark, sf_dir, EVIDENCE, "qid long, question string, rank int, score double, text string"))


GATES = [
    ("cause", "the Velan League", "The Velan League fell after a revolt in the harbor."), ("cause", "the Velan League", "The League traded salt."), ("effect", "drought", "River trade lost half of its boats."), ("effect", "drought", "It was dry."),
    ("structure", "tidal gate", "A tidal gate consists of two leaves."), ("general", "salt", "Salt was cheap."), ("process", "tidal gate", "The gate opens."), ("features", "", "A system of canals."),
    ("entity_list", "the Board", "Mara Tolle was a leader of the Board."), ("change", "river trade", "River trade became smaller and smaller."), ("significance", "Harbor Charter", "The Harbor Charter limited the power of the League."),
]


def _marks_sql() -> str:
    cases = " ".join(f"WHEN '{k}' THEN {' OR '.join(f'contains(lower(sentence), {literal(m)})' for m in v)}" for k, v in gates.INTENT_MARKS.items())
    return f"CASE intent {cases} ELSE true END"


_GATES = [(i, *g) for i, g in enumerate(GATES)]


@query(f"SELECT id, intent, subject, sentence, len({TERMS.format('subject')}) > 0 AND len(list_intersect({TERMS.format('sentence')}, {TERMS.format('subject')})) >= least(2, len({TERMS.format('subject')})) AS mentioned, {_marks_sql()} AS supported FROM {of_documents_sql(_GATES, 'id, intent, subject, sentence')}")
def sentence_gates(spark, sf_dir):
    g = of_documents(spark, sf_dir, _GATES, "id long, intent string, subject string, sentence string")
    return g.select("*", selection.mentions(F.col("sentence"), F.col("subject")).alias("mentioned"), gates.intent_supported(F.col("sentence"), F.col("intent")).alias("supported"))


COUNTS = [(a, b, c, d, i) for a in (1, 2, 3) for b in (1, 2) for c in (0, 1) for d in (0, 1) for i in ("cause", "general")]


_COUNTS = [(i, *c) for i, c in enumerate(COUNTS)]


@query(f"SELECT *, merged >= 2 AND selected >= 2 AND with_subject >= 1 AND (intent IN ('general', 'comparison') OR with_intent >= 1) AS sufficient, merged >= 3 AND selected >= 2 AS side_sufficient, round(0.45 * with_subject + 0.40 * with_intent + 0.15 * least(1.0, selected / 3), 6)::DOUBLE AS fall_score, round(0.50 * with_subject + 0.35 * with_intent + 0.15 * least(1.0, selected / 3), 6)::DOUBLE AS side_score FROM {of_documents_sql(_COUNTS, 'id, merged, selected, with_subject, with_intent, intent')}")
def sufficiency(spark, sf_dir):
    c = of_documents(spark, sf_dir, _COUNTS, "id long, merged int, selected int, with_subject int, with_intent int, intent string")
    m, s, a, b = (F.col(k) for k in ("merged", "selected", "with_subject", "with_intent"))
    return c.select("*", gates.sufficient(m, s, a, b, F.col("intent")).alias("sufficient"), gates.side_sufficient(m, s).alias("side_sufficient"), gates.side_score(a, b, s, F.lit(True)).alias("fall_score"), gates.side_score(a, b, s, F.lit(False)).alias("side_score"))


PREMISE = [
    (1, "the Harbor Charter", "the League", ["The weather was mild.", "The Harbor Charter limited the League in every port."], ["limit"]), (2, "the Harbor Charter", "the League", ["The Harbor Charter was signed.", "The League was limited."], ["limit"]),
    (3, "Mara Tolle", "north channel", ["Mara Tolle discovered the north channel in spring."], ["discover", "found"]), (4, "Mara Tolle", "north channel", ["Mara Tolle mapped the north channel."], ["discover"]),
]


@query(f"SELECT qid, list_filter(ss, lambda x: len(list_intersect({TERMS.format('a')}, {TERMS.format('x')})) >= 0.6 * len({TERMS.format('a')}) AND len(list_intersect({TERMS.format('b')}, {TERMS.format('x')})) >= 0.6 * len({TERMS.format('b')}) AND len(list_filter(ms, lambda m: contains(lower(x), m))) > 0)[1] AS sentence FROM {of_documents_sql(PREMISE, 'qid, a, b, ss, ms')}")
def premise_check(spark, sf_dir):
    p = of_documents(spark, sf_dir, PREMISE, "qid long, a string, b string, ss array<string>, ms array<string>")
    return p.select("qid", gates.premise_sentence(F.col("ss"), F.col("a"), F.col("b"), F.col("ms"), 0.6).alias("sentence"))


ANCHORS = [(1, "What is the pressure of pump AB-12?", "Pump AB-12 has a pressure of 3 bar."), (2, "What is the pressure of pump AB-12?", "Pump CD-34 has a pressure of 3 bar."), (3, "What is the pressure?", "3 bar"), (4, "When was the gate built?", "The gate was built in 1888."), (5, "When was the gate built?", "The gate is old."), (6, "Where is the gate?", "the gate is in Vela"), (7, "Where is the gate?", "nowhere")]


@query(f"SELECT * FROM {of_documents_sql([(1, True, True), (2, False, True), (3, None, True), (4, None, True), (5, None, False), (6, None, True), (7, None, False)], 'qid, anchored, stated')}")
def anchor_check(spark, sf_dir):
    a = of_documents(spark, sf_dir, ANCHORS, "qid long, question string, context string")
    c = F.col("context")
    return a.select("qid", gates.identifier_anchor(_q(), c).alias("anchored"), gates.predicate_stated(_q(), c, F.lit(None).cast("string")).alias("stated"))


REQUESTS = [(1, "What?", 5), (2, "  ", 5), (3, "What?", 0), (4, "What?", 21), (5, None, 5), (6, "x" * 4097, 5), (7, "What?", None)]


@query(f"SELECT id, CASE WHEN trim(coalesce(q, '')) = '' THEN 'blank' WHEN length(q) > 4096 THEN 'too_long' WHEN k IS NULL OR k NOT BETWEEN 1 AND 20 THEN 'top_k' END AS error FROM {of_documents_sql(REQUESTS, 'id, q, k')}")
def request_validation(spark, sf_dir):
    r = of_documents(spark, sf_dir, REQUESTS, "id long, q string, k int")
    return r.select("id", gates.request_error(F.col("q"), F.col("k")).alias("error"))


PEOPLE = [(1, "Mara Tolle and Ivo J. Brandt met Ana-Lise Roe near Port Ansel."), (2, "The President spoke. King Orso was absent."), (3, "no names here"), (4, "Mara Tolle led; Mara Tolle won.")]


@query(f"SELECT * FROM {of_documents_sql([(1, 'Mara Tolle|Ivo J. Brandt|Ana-Lise Roe|Port Ansel'), (2, ''), (3, ''), (4, 'Mara Tolle|Mara Tolle')], 'id, names')}")
def person_names(spark, sf_dir):
    return of_documents(spark, sf_dir, PEOPLE, "id long, s string").select("id", F.array_join(T.person_names(F.col("s")), "|").alias("names"))


EV = [
    (1, "cause", "the Velan League", ["The Velan League declined because its fleets were lost at sea.", "Its debts rose after the war."]),
    (2, "change", "river trade", ["River trade became much smaller over the years of drought.", "River trade became much smaller in the years of drought.", "River trade moved to the coast and expanded there again."]),
    (3, "entity_list", "the Harbor Board", ["Mara Tolle and Ivo Brandt were leaders of the Harbor Board.", "It met weekly."]), (4, "effect", "the drought", ["It was sunny."]),
    (5, "structure", "a tidal gate", ["A tidal gate consists of two leaves and a sill (see the plate).", "However, a tidal gate is divided into upper and lower parts."]),
]


SAID = [
    (1, "The Velan League declined because of its fleets were lost at sea.", "synthesized", True),
    (2, "River trade changed in several important ways. River trade became much smaller over the years of drought. River trade moved to the coast and expanded there again.", "synthesized", True),
    (3, "Key figures of the Harbor Board included Mara Tolle and Ivo Brandt.", "synthesized", True),
    (4, "I could not find enough supporting evidence to answer that.", "system", False),
    (5, "A tidal gate had a structured organization. A tidal gate consists of two leaves and a sill. A tidal gate is divided into upper and lower parts.", "synthesized", True),
]


@query(f"SELECT * FROM {of_documents_sql(SAID, 'qid, answer, answer_type, supported')}")
def answer_synthesis(spark, sf_dir):
    e = of_documents(spark, sf_dir, EV, "qid long, intent string, subject string, ss array<string>")
    a = synthesis.answered(F.lit("Tell me about it"), F.col("intent"), F.col("subject"), F.col("ss"), F.lit(True), F.lit(False))
    return e.select("qid", a.alias("a")).select("qid", "a.answer", F.col("a.kind").alias("answer_type"), F.col("a.ok").alias("supported"))


SIDES = [(1, "Velan", "Orsk", ["Velan lost a war and two provinces."], ["Orsk lost a war in the north."]), (2, "Velan", "Orsk", ["Velan is large."], ["Orsk is small."]), (3, "Velan", "Orsk", [], ["Orsk is small."])]


@query(f"SELECT * FROM {of_documents_sql([(1, 'Both show military pressure. Velan shows territorial losses.'), (2, 'Velan: Velan is large. Orsk: Orsk is small.'), (3, None)], 'qid, answer')}")
def comparison_synthesis(spark, sf_dir):
    s = of_documents(spark, sf_dir, SIDES, "qid long, l string, r string, ls array<string>, rs array<string>")
    return s.select("qid", synthesis.compared(F.col("l"), F.col("r"), F.col("ls"), F.col("rs")).alias("answer"))


@query(f"SELECT qid, CASE WHEN {R.first_match_sql(_L, Q.UI_INTENTS, 'hybrid')} = 'lookup' THEN 'rag_only' WHEN {R.first_match_sql(_L, Q.UI_INTENTS, 'hybrid')} = 'generative' AND qid % 2 = 0 THEN 'generative' ELSE 'hybrid' END AS mode FROM {QS}")
def polish_route(spark, sf_dir):
    return asked(spark, sf_dir).select("qid", synthesis.polish_route(_q(), F.col("qid") % 2 == 1).alias("mode"))


_S3 = f"3.0 * len(list_intersect({TERMS.format('s')}, {TERMS.format(literal('the thing and haed ened'))}))"


@query(
    f"""WITH s AS (SELECT conv_id, turn, unnest({SENTENCES.format("text")}) AS s, generate_subscripts({SENTENCES.format("text")}, 1) AS r FROM conversations)
SELECT conv_id, turn, round(sum({_S3} + greatest(0.0, 3 - 0.5 * (r - 1)) - CASE WHEN {_S3} = 0 THEN 2.0 ELSE 0 END - CASE WHEN length(s) < 25 THEN 1.0 ELSE 0 END - CASE WHEN len({WORDS.format("s")}) > 70 THEN 2.0 ELSE 0 END), 4)::DOUBLE AS v3,
round(sum(5.0 * len(list_intersect({TERMS.format("s")}, ['thing'])) + CASE WHEN contains({KEY.format("s")}, 'thing') THEN 7.0 ELSE 0 END + CASE WHEN contains(lower(s), 'ation') THEN 2.0 ELSE 0 END + CASE WHEN len({WORDS.format("s")}) BETWEEN 8 AND 45 THEN 1.0 ELSE 0 END - CASE WHEN len({WORDS.format("s")}) > 70 THEN 2.0 ELSE 0 END), 4)::DOUBLE AS side FROM s GROUP BY ALL"""
)
def sentence_scores(spark, sf_dir):
    s = spread(table(spark, sf_dir, "conversations")).select("conv_id", "turn", F.posexplode(T.sentences(F.col("text"))).alias("i", "s"))
    v3 = ranking.sentence_score_v3(F.col("s"), F.lit("the thing and haed ened"), F.col("i") + 1, F.lit(0.0))
    side = ranking.side_sentence_score(F.col("s"), F.lit("thing"), ["ation"])
    return s.groupBy("conv_id", "turn").agg(F.round(F.sum(v3), 4).alias("v3"), F.round(F.sum(side), 4).alias("side"))


#: A small corpus beside the driver's documents; no document has the words that its questions ask for.
CORPUS = [
    (1, "The Velan League declined because its fleets were lost at sea. The Velan League also lost its northern ports.", False),
    (2, "Debts rose in the Velan League for years. The decline of the Velan League was slow.", False),
    (3, "Mara Tolle was born in 1871 in Port Ansel. Mara Tolle studied tides for many years.", True),
    (4, "The Harbor Board was founded in 1902. Members of the Harbor Board met in Port Ansel.", False),
    (5, "River trade changed when the dry years began. River trade became smaller and moved to the coast.", False),
    (6, "River trade developed slowly in the wet years. River trade declined in the dry years.", False),
    (7, "A tidal gate consists of two leaves and a sill. A tidal gate is divided into an upper and a lower part.", False),
    (8, "The structure of a tidal gate follows the tide. Each tidal gate has a frame as its main component.", False),
    (9, "The pump warranty period is 12 months from delivery.", False),
    (10, "The pump warranty period is 24 months from delivery.", False),
    (11, "The Orsk Union had a government of towns. The Orsk Union lost a war in the north.", False),
    (12, "The Orsk Union kept a system of courts. Taxes in the Orsk Union were low.", False),
    (13, "The Velan League had a constitution of its own. Taxes in the Velan League were high.", False),
    (14, "The towns of the Orsk Union were small. The courts of the Orsk Union sat in spring.", False),
    (15, "The Harbor Charter limited the Velan League in every port. The Harbor Charter was read aloud in spring.", False),
    *((20 + i, f"Effects of the long drought were sung in {x}. Consequences in {x} were many.", False) for i, x in enumerate(("Vela", "Orsk", "Tern", "Rill", "Moor", "Fenn"))),
    (30, "In the aftermath people moved. The long drought led to hunger in the towns.", False),
    (31, "An aftermath of the long drought is told in the annals. It resulted in new wells.", False),
    (40, "The Quern Guild was led by Ivo Brandt, its leader for years. Masters of the Quern Guild met at the mill.", False),
    (41, "Ivo Brandt was born in 1832 in Moor. Ivo Brandt kept a diary.", False),
    (42, "The Quern Guild had a hall of its own. The Quern Guild kept an important archive.", False),
    (43, "A drum mill uses water and converts its force to motion. A drum mill produces flour in stages.", False),
    (44, "The process of a drum mill begins with the cycle of the wheel. The wheel of a drum mill turns slowly.", False),
]
ASKED = [
    (1, "Why did the Velan League decline?"), (2, "When was Mara Tolle born?"), (3, "When was the Harbor Board founded?"), (4, "How did river trade change over time?"), (5, "What is the structure of a tidal gate?"),
    (6, "What is the warranty period of the pump?"), (7, "Compare the Velan League and the Orsk Union."), (8, "How did the Harbor Charter limit the Velan League?"), (9, "How did Mara Tolle overthrow the Orsk Union?"),
    (10, "What were the effects of the long drought?"), (11, "What is the population of Port Ansel?"), (12, "   "), (13, "Compare the Velan League and the Fulling Guild."),
    (14, "Who led the Quern Guild and when was the leader born?"), (15, "Describe the Quern Guild."), (16, "What are the main features of the Orsk Union?"), (17, "Who were the key figures of the Quern Guild?"), (18, "What is the significance of the Harbor Charter?"),
    (19, "Explain how a drum mill works."),
]


def fixture_corpus(spark, sf_dir):
    """The driver's documents and the small corpus, as chunks."""
    d = spread(table(spark, sf_dir, "documents")).select(F.col("doc_id").alias("chunk_id"), "text", F.lit(False).alias("runtime"))
    return d.unionByName(frame(spark, [(10**12 + i, t, r) for i, t, r in CORPUS], "chunk_id long, text string, runtime boolean"))


#: What the rules say of these questions, worked out by hand.
ANSWERS = [
    (1, 'The Velan League declined because of its fleets were lost at sea.', 'synthesized', True, 0, 2),
    (2, 'Mara Tolle was born in 1871.', 'extracted', True, 0, 3),
    (3, 'The Harbor Board was founded in 1902.', 'extracted', True, 0, 4),
    (4, 'River trade changed in several important ways. River trade became smaller and moved to the coast. River trade changed when the dry years began. River trade developed slowly in the wet years.', 'synthesized', True, 0, 5),
    (5, 'A tidal gate had a structured organization. A tidal gate is divided into an upper and a lower part. The structure of a tidal gate follows the tide. A tidal gate consists of two leaves and a sill.', 'synthesized', True, 0, 8),
    (6, 'The retrieved sources contradict each other, so no single answer is given.', 'conflict', False, 0, 9),
    (7, 'The Velan League: The Velan League had a constitution of its own. The Velan League declined because its fleets were lost at sea. The Orsk Union: The Orsk Union had a government of towns. The Orsk Union kept a system of courts.', 'comparison', True, 0, 11),
    (8, 'The Harbor Charter limited the Velan League in every port.', 'premise', True, 0, 15),
    (9, 'I could not find enough supporting evidence to answer that.', 'system', False, 0, 3),
    (10, 'The long drought had several major effects. Effects of the long drought were sung in Vela. The long drought led to hunger in the towns. An aftermath of the long drought is told in the annals.', 'synthesized', True, 1, 20),
    (11, 'I could not find enough supporting evidence to answer that.', 'system', False, 0, 3),
    (12, 'I could not find enough supporting evidence to answer that.', 'blank', False, None, None),
    (13, 'I could not find enough supporting evidence to answer that.', 'system', False, 0, 1),
    (14, 'Ivo Brandt. The leader was born in 1832.', 'multi_hop', True, 0, 40),
    (15, 'The Quern Guild can be described as follows. The Quern Guild was led by Ivo Brandt, its leader for years. Masters of the Quern Guild met at the mill.', 'synthesized', True, 0, 40),
    (16, 'The main features of the Orsk Union were: The Orsk Union had a government of towns. The Orsk Union kept a system of courts. The Orsk Union lost a war in the north.', 'synthesized', True, 0, 11),
    (17, 'Key figures of the Quern Guild included Ivo Brandt.', 'synthesized', True, 0, 40),
    (18, 'The Harbor Charter was significant because it changed important political or legal relationships. The Harbor Charter limited the Velan League in every port. The Harbor Charter was read aloud in spring.', 'synthesized', True, 0, 15),
    (19, 'A drum mill produces flour in stages. The process of a drum mill begins with the cycle of the wheel. A drum mill uses water and converts its force to motion.', 'synthesized', True, 0, 44),
]


@query(f"SELECT * FROM {values(ANSWERS, 'qid, answer, answer_type, supported, stage, first_source')}")
def question_answers(spark, sf_dir):
    """From questions to answers over all documents: extraction, synthesis of every intent, summary, two hops, conflict, comparison, premises,
    fallback, abstention, refusal."""
    a = answering.answers(frame(spark, ASKED, "qid long, question string"), fixture_corpus(spark, sf_dir))
    return a.select("qid", "answer", "answer_type", "supported", "stage", (F.get("sources", F.lit(0))["id"] - 10**12).alias("first_source"))


#: Every sentence of the documents with the question of the second instruction form; RE2 and Java agree on these words.
_IQ = "regexp_extract_all(s, '[a-zA-Z][a-zA-Z0-9''-]*')"


def _asked_sql(verb: str) -> str:
    subject = f"trim(split_part(s, ' {verb} ', 1))"
    return f"CASE WHEN contains(lower(s), ' {verb} ') AND len({WORDS.format(subject)}) BETWEEN 3 AND 12 THEN 'What {verb} ' || {subject} || '?' END"


@query(
    f"""WITH s AS (SELECT doc_id, text, unnest({SENTENCES.format("text")}) AS s, generate_subscripts({SENTENCES.format("text")}, 1) - 1 AS i FROM documents),
q AS (SELECT *, list_filter({_IQ}, lambda w: length(w) >= 5)[1:5] AS useful FROM s),
a AS (SELECT doc_id, i, text, s, coalesce({_asked_sql("is")}, {_asked_sql("was")}, 'According to the context, what information is given about ' || CASE WHEN len(useful) > 0 THEN array_to_string(useful, ' ') ELSE 'this topic' END || '?') AS question FROM q)
SELECT doc_id, count(*) AS n, md5(string_agg(md5('<RESULT>' || chr(10) || text || chr(10) || chr(10) || '<ANSWER>' || chr(10) || 'Question: ' || question || chr(10) || 'Answer:'), '' ORDER BY i)) AS digest FROM a GROUP BY doc_id"""
)
def instruction_questions(spark, sf_dir):
    e = etl.evidence_instructions(spread(table(spark, sf_dir, "documents")), "doc_id", None).select("doc_id", F.struct("i", F.md5("prompt").alias("p")).alias("x"))
    e = e.groupBy("doc_id").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("x")).alias("x"))  # a document's sentences
    return e.select("doc_id", "n", F.md5(F.array_join(F.transform("x", lambda x: x["p"]), "")).alias("digest"))


MINED = [
    (1, "When was Mara Tolle born?", "1871", "born_year"), (1, "When was The Harbor Board founded?", "1902", "founded_year"), (2, "What is Port Ansel the capital of?", "Vela", "capital"), (3, None, None, None), (4, None, None, None),
    (5, "When was The Harbor Board founded?", "1902", "founded_year"),
]


@query(f"SELECT doc_id, question, answer, type FROM (SELECT *, row_number() OVER (PARTITION BY lower(question), lower(answer) ORDER BY doc_id) AS r FROM {of_documents_sql(MINED, 'doc_id, question, answer, type')} WHERE question IS NOT NULL) WHERE r = 1")
def instruction_mine(spark, sf_dir):
    return etl.mined_instructions(facts(spark, sf_dir), "doc_id").select("doc_id", "question", "answer", "type")
