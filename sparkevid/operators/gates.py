"""Support gates: is an answer grounded, sufficient, traceable, free of conflict? Null stays apart from false."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T

#: Substrings that show an intent in a sentence.
INTENT_MARKS = {
    "entity_list": ("leader", "leaders", "member", "members", "politician", "government"),
    "structure": ("structure", "organized", "organisation", "organization", "consists", "consisted", "divided", "component", "components", "part", "parts", "hierarchy", "sub-unit", "subunit"),
    "process": ("process", "works", "uses", "produces", "splits", "converts", "transforms", "absorbs", "releases", "energy", "stage", "stages", "cycle"),
    "significance": ("important", "significant", "impact", "influence", "limited", "power", "authority", "rights", "law", "legal", "constitutional", "changed", "transformed"),
    "cause": ("because", "due to", "caused by", "fell after", "collapsed after", "overrun", "defeat", "defeated", "revolt", "invasion", "pressure", "decline", "declined"),
    "effect": ("resulted", "led to", "after", "following", "lost", "became", "came under", "no longer", "fragmented", "divided", "replaced"),
    "change": ("transitioned", "became", "changed", "developed", "evolved", "expanded", "declined", "lost", "moved", "came under"),
    "features": ("feature", "features", "institution", "government", "branch", "constitution", "system", "organized", "structure"),
}
#: Words that do not trace an answer to a source.
UNTRACED = "about after again also around because been being between both could does each from has have into more most other over same some such than that their there these they this those through under were which while with would your what when where who why how answer following several important ways main was are and the for not but its all can is to of in on at be as by or".split()
#: Opposite actions, attributes, and how numbers, identifiers and directives are written.
OPPOSITES = {"open": "close", "start": "stop", "enable": "disable", "connect": "disconnect", "install": "remove", "increase": "decrease", "raise": "lower", "attach": "detach"}
ATTRIBUTES = "amount date duration identifier limit number period pressure price quantity revision serial temperature time value version voltage warranty year".split()
IDENTIFIER_ATTRIBUTES = "asset document identifier installed model revision serial terminal unit version".split()
NUMBER = r"(?i)(\d+(?:\.\d+)?)(?:\s*([a-z%°][a-z0-9%°/-]*))?"
IDENTIFIER = r"\b(?:[A-Z][A-Z0-9]*(?:[-/][A-Z0-9]+)+|[A-Z]{2,}\d+[A-Z0-9]*)\b"
DIRECTIVE = r"(?i)\b(must|should|required to|need to|do not|don't|never|avoid|prohibited|only)\b(.{0,90})"
NEGATIVE = ("do not", "don't", "never", "avoid")
REACH = 90
CONFIDENT = 0.80
REFUSAL = "I could not find enough supporting evidence to answer that."
CONFLICT = "The retrieved sources contradict each other, so no single answer is given."
RELATION_STATED = (("born", r"\bwas born (?:on|in)\b"), ("founded", r"\bwas founded in\b"), ("established", r"\bwas established in\b"), ("released", r"\bwas released in\b"), ("published", r"\bwas published in\b"), ("named after", r"\bwas named after\b"))
CAUSE_STATED = r"\bbecause\b|\bdue to\b|\bas a result of\b|\bwas caused by\b|\bfell after\b"


def marks_of(intent: Column, table: dict[str, tuple[str, ...]]) -> Column:
    """The marks of a row's intent as an array; empty for other intents."""
    out = F.array().cast("array<string>")
    for name, marks in table.items():
        out = F.when(intent == name, T.words_of(marks)).otherwise(out)
    return out


def intent_supported(sentence: Column, intent: Column) -> Column:
    """A mark of the intent occurs; general and comparison need none."""
    parts = F.struct(F.lower(sentence).alias("low"), marks_of(intent, INTENT_MARKS).alias("marks"))
    return intent.isin("general", "comparison") | R.let(parts, lambda x: F.exists(x["marks"], lambda m: F.contains(x["low"], m)))


def sufficient(merged: Column, selected: Column, with_subject: Column, with_intent: Column, intent: Column) -> Column:
    """Two results, two sentences, one that mentions the subject, and for a special intent one that shows it."""
    return (merged >= 2) & (selected >= 2) & (with_subject >= 1) & (intent.isin("general", "comparison") | (with_intent >= 1))


#: Words by which a sentence states a relation.
RELATION_MARKS = {
    "cause": ("cause", "led to", "lead to", "because of"), "create": ("creat", "produc", "generat", "form", "establish"), "limit": ("limit", "restrict", "constrain"), "function_as": ("functioned as", "functions as", "acted as", "acts as", "served as", "serves as"),
    "operate_as": ("operated as", "operates as"), "structure_as": ("structured as", "structure as", "organized as", "organised as", "structure of"), "describe_as": (" as ",), "govern": ("govern",), "organize": ("organiz", "organis"), "replicate": ("replicat",),
    "separate": ("separat",), "overthrow": ("overthrow", "overthrew"), "sign": ("sign",), "invent": ("invent", "discover", "develop"), "perform": ("perform",), "split": ("split", "divid"),
}


def side_sufficient(merged: Column, sentences: Column) -> Column:
    return (merged >= 3) & (sentences >= 2)


def extraction_confidence(question: Column, context: Column, answer: Column) -> Column:
    """0.5 for an answer in its context, 0.35 for the relation stated there, 0.1 for 1 to 45 words, -0.3 each for over 300 characters and six equal ones in a row."""
    q, c = F.lower(F.trim(question)), F.regexp_replace(F.lower(context), r"\s+", " ")
    a = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(F.trim(answer)), r"\s+", " "), "^(?:because |it was due to |it happened as a result of )", ""), r"\.+$", "")
    stated = None
    for word, pattern in RELATION_STATED:
        hit = F.when(F.contains(q, F.lit(word)), F.regexp_like(c, F.lit(pattern))) if stated is None else stated.when(F.contains(q, F.lit(word)), F.regexp_like(c, F.lit(pattern)))
        stated = hit
    stated = stated.when(F.startswith(q, F.lit("why ")) | F.startswith(q, F.lit("what caused ")), F.regexp_like(c, F.lit(CAUSE_STATED))).otherwise(False)
    score = F.when((a != "") & F.contains(c, a), 0.5).otherwise(0.0) + F.when(stated, 0.35).otherwise(0.0) + F.when(F.size(T.space_words(answer)).between(1, 45), 0.1).otherwise(0.0)
    score = score - F.when(F.length(answer) > 300, 0.3).otherwise(0.0) - F.when(F.regexp_like(answer, F.lit(r"(.)\1{5,}")), 0.3).otherwise(0.0)
    return F.when(F.coalesce(answer, F.lit("")) == "", 0.0).otherwise(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 6))


def reasoning_support(question: Column, sentences: Column, best_score: Column) -> dict[str, Column]:
    """Coverage of the question's terms by all sentences, best overlap of one, number at half or more, score, and whether that suffices."""
    asked = T.terms(question)
    n = F.greatest(F.size(asked), F.lit(1))
    overlaps = F.transform(sentences, lambda s: T.overlap(T.terms(s), asked) / n)
    matched = F.size(F.filter(asked, lambda t: F.exists(sentences, lambda s: F.array_contains(T.terms(s), t))))
    coverage, best = matched / n, F.coalesce(F.array_max(overlaps), F.lit(0.0))
    half = F.size(F.filter(overlaps, lambda x: x >= 0.5))
    score = F.round(0.45 * coverage + 0.40 * best + 0.15 * F.least(F.lit(1.0), best_score / 60), 6)
    floor = F.when(F.size(asked) >= 4, 3).when(F.size(asked) >= 2, 2).otherwise(1)
    enough = (matched >= floor) & (coverage >= 0.55) & (half >= 1) & (best >= 0.65) & (score >= 0.62)
    return {"coverage": F.round(coverage, 6), "best_overlap": F.round(best, 6), "strong": half, "support": score, "sufficient": enough}


#: What shows that a sentence tells of a fall, and what that it tells something of its subject at all.
FALL_MARKS = ("fall", "fell", "declin", "collaps", "dissol", "ended", "end of", "defeat", "overrun", "inva", "revolt")
GENERAL_MARKS = ("is", "was", "are", "were", "had", "has", "have", "consist", "includ", "contain", "became", "led", "kept", "made")
SIDE_CONFIDENT = 0.55


def side_confidence(sentences: Column, entity: Column, fall: Column) -> Column:
    """struct(score, sufficient) of a side: its entity is named, a sentence that names it shows the relation (a fall, or anything told of it), and
    up to three sentences say so. Both hits and a score of SIDE_CONFIDENT are needed."""
    terms = T.entity_terms(T.without_article(entity))
    names = lambda s: F.exists(terms, lambda e: F.contains(T.dedup_key(s), T.dedup_key(e)))
    tells = lambda s: F.exists(T.space_words(F.lower(s)), lambda w: F.exists(T.words_of(GENERAL_MARKS), lambda m: F.startswith(w, m)))
    hit = F.exists(sentences, names)
    shown = F.exists(sentences, lambda s: names(s) & F.when(fall, T.any_substring(s, FALL_MARKS)).otherwise(tells(s)))
    one = lambda c: F.when(c, 1.0).otherwise(0.0)
    score = side_score(one(hit), one(shown), F.size(sentences), fall)
    return F.struct(score.alias("score"), (hit & shown & (score >= SIDE_CONFIDENT)).alias("sufficient"))


def side_score(entity: Column, relation: Column, n: Column, fall: Column) -> Column:
    """Share of entity hits, relation hits and coverage min(1, n / 3), by the weights of the question's kind."""
    coverage = F.least(F.lit(1.0), n / 3)
    return F.round(F.when(fall, 0.45 * entity + 0.40 * relation + 0.15 * coverage).otherwise(0.50 * entity + 0.35 * relation + 0.15 * coverage), 6)


def covered(terms: Column, sentence: Column) -> Column:
    """Share of terms that a sentence has; 0 for none."""
    return F.when(F.size(terms) > 0, T.overlap(terms, T.terms(sentence)) / F.size(terms)).otherwise(F.lit(0.0))


def premise_sentence(sentences: Column, source: Column, target: Column, marks: Column, least: float) -> Column:
    """The first sentence that covers source and target and has one of the marks, or null."""
    s, t = T.terms(source), T.terms(target)
    hit = F.filter(sentences, lambda x: (covered(s, x) >= least) & (covered(t, x) >= least) & F.exists(marks, lambda m: F.contains(F.lower(x), m)))
    return F.get(hit, F.lit(0))


def grounded(answer: Column, context: Column) -> Column:
    """A word of over three characters of the answer is in the context."""
    return F.exists(F.filter(T.space_words(F.lower(answer)), lambda w: F.length(w) > 3), lambda w: F.contains(F.lower(context), w))


def predicate_stated(question: Column, context: Column, predicate: Column) -> Column:
    """The question's predicate in the context, else a year for when, else a capitalised word for where, else nothing to check."""
    q = F.lower(question)
    return (
        F.when(predicate.isNotNull(), F.contains(F.lower(context), predicate)).when(F.startswith(q, F.lit("when")), F.regexp_like(context, F.lit(r"\b(?:1[0-9]|20)[0-9]{2}\b")))
        .when(F.startswith(q, F.lit("where")), F.regexp_like(context, F.lit(r"\b[A-Z][a-z]+"))).otherwise(True)
    )


def identifier_anchor(question: Column, context: Column) -> Column:
    """Null without identifiers in the question; else whether all occur in the context with one of the first two other terms."""
    ids = F.transform(F.regexp_extract_all(question, F.lit(IDENTIFIER), F.lit(0)), F.lower)
    c = F.lower(context)
    words = F.slice(F.filter(T.terms(question), lambda w: ~F.exists(ids, lambda i: F.contains(i, w))), 1, 2)
    return F.when(F.size(ids) > 0, F.forall(ids, lambda i: F.contains(c, i)) & F.exists(words, lambda w: F.contains(c, w)))


def traced_terms(t: Column) -> Column:
    """Distinct runs of three or more of a-z and 0-9 that are no function words."""
    return F.array_except(F.regexp_extract_all(F.lower(t), F.lit("[a-z0-9]{3,}"), F.lit(0)), T.words_of(UNTRACED))


def traceable(answer: Column, sources: Column) -> Column:
    """Enough terms of the answer in its sources: one of up to four, else two."""
    a, s = traced_terms(answer), traced_terms(F.array_join(sources, " "))
    return (F.trim(answer) != "") & (F.size(sources) > 0) & (T.overlap(a, s) >= F.when(F.size(a) <= 4, 1).otherwise(2))


def evidence_pairs(sources: DataFrame) -> DataFrame:
    """qid, left_text, right_text of pairs of a question's sources that score at least 0.7 of its best and share a term with it.

    Needs qid, question, rank, score, text. A question has a handful of sources; the join is on qid."""
    from pyspark.sql import Window

    floor = 0.7 * F.max("score").over(Window.partitionBy("qid"))
    s = sources.withColumn("good", F.col("score") >= floor).where("good").where(F.arrays_overlap(traced_terms(F.col("question")), traced_terms(F.col("text"))))
    a, b = s.select("qid", F.col("rank").alias("i"), F.col("text").alias("left_text")), s.select("qid", F.col("rank").alias("j"), F.col("text").alias("right_text"))
    return a.join(b, "qid").where("i < j").drop("i", "j")


def located(text: Column, pattern: str) -> Column:
    """All matches of a pattern in order as (match, terms of the window of REACH characters around it).

    Spark's functions give no offsets, so the text is walked: each match is found after the end of the one before."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<match:string,terms:array<string>>>").alias("out"))

    def step(acc: Column, m: Column) -> Column:
        at = F.position(m, text, acc["at"])
        lo = F.greatest(F.lit(1), at - REACH)
        window = F.substr(text, lo, at + F.length(m) + REACH - lo)
        return F.struct((at + F.length(m)).alias("at"), F.array_append(acc["out"], F.struct(m.alias("match"), traced_terms(window).alias("terms"))).alias("out"))

    return F.aggregate(found, start, step, lambda acc: acc["out"])


def numeric_conflict(left: Column, right: Column) -> Column:
    """Two numbers of one unit that differ, in windows that share two terms, with a unit or an attribute word."""
    attributes = T.words_of(ATTRIBUTES)
    # a number within a word or an identifier is none
    value = lambda x: F.regexp_extract(x["match"], NUMBER, 1)
    unit = lambda x: F.lower(F.regexp_extract(x["match"], NUMBER, 2))

    def clash(x: Column, y: Column) -> Column:
        shared = F.array_intersect(x["terms"], y["terms"])
        named = (unit(x) != "") & ~unit(x).isin("ad", "bc")
        return (value(x) != value(y)) & (unit(x) == unit(y)) & (F.size(shared) >= 2) & (named | F.arrays_overlap(shared, attributes))

    masked = lambda t: F.regexp_replace(t, r"[A-Za-z0-9_]*[A-Za-z_-][0-9][A-Za-z0-9_-]*", "#")
    b = located(masked(right), NUMBER)
    return F.exists(located(masked(left), NUMBER), lambda x: F.exists(b, lambda y: clash(x, y)))


def identifier_conflict(left: Column, right: Column) -> Column:
    """Each side has an identifier that the other lacks, in windows that share an attribute word."""
    a, b = located(left, IDENTIFIER), located(right, IDENTIFIER)
    ids = lambda x: F.transform(x, lambda y: F.lower(y["match"]))
    only = lambda x, other: F.filter(x, lambda y: ~F.array_contains(ids(other), F.lower(y["match"])))
    context = lambda x: F.flatten(F.transform(x, lambda y: y["terms"]))
    own, theirs = only(a, b), only(b, a)
    shared = F.array_intersect(context(own), context(theirs))
    return (F.size(own) > 0) & (F.size(theirs) > 0) & F.arrays_overlap(shared, T.words_of(IDENTIFIER_ATTRIBUTES))


def directive_conflict(left: Column, right: Column) -> Column:
    """Opposite actions on an object that shares two terms, or one action demanded and forbidden."""
    verbs = [*OPPOSITES, *OPPOSITES.values()]

    def parsed(t: Column) -> Column:
        found = F.regexp_extract_all(t, F.lit(DIRECTIVE), F.lit(0))
        one = lambda m: F.struct(F.lower(F.regexp_extract(m, DIRECTIVE, 1)).isin(*NEGATIVE).alias("no"), traced_terms(F.regexp_extract(m, DIRECTIVE, 2)).alias("terms"))
        return F.filter(F.transform(found, one), lambda x: F.size(x["terms"]) > 0)

    def clash(x: Column, y: Column) -> Column:
        opposite = F.lit(False)
        for a, b in OPPOSITES.items():
            for p, q in ((a, b), (b, a)):
                opposite = opposite | (F.array_contains(x["terms"], p) & F.array_contains(y["terms"], q))
        shared = F.array_intersect(x["terms"], y["terms"])
        objects = F.array_except(shared, T.words_of(verbs))
        return (opposite & (F.size(objects) >= 2)) | ((F.size(shared) > 0) & (x["no"] != y["no"]))

    return F.exists(parsed(left), lambda x: F.exists(parsed(right), lambda y: clash(x, y)))


def conflicts(pairs: DataFrame) -> DataFrame:
    """qid, conflict: whether any pair of its evidence contradicts."""
    a, b = F.col("left_text"), F.col("right_text")
    return pairs.groupBy("qid").agg(F.bool_or(numeric_conflict(a, b) | identifier_conflict(a, b) | directive_conflict(a, b)).alias("conflict"))


def example_kept(question: Column, answer: Column) -> Column:
    """Quality of a derived example: lengths, balanced brackets and quotes, few commas, a clean beginning and end."""
    count = lambda t, c: F.length(t) - F.length(F.replace(t, F.lit(c), F.lit("")))
    balanced = (count(answer, "(") == count(answer, ")")) & (count(answer, '"') % 2 == 0)
    return F.length(question).between(10, 200) & F.length(answer).between(3, 220) & balanced & (count(answer, ",") <= 4) & ~F.regexp_like(F.lower(answer), F.lit(r"^(?:and|or|but|which|that|who)\b")) & ~F.regexp_like(F.lower(answer), F.lit(r"\b(?:and|or|of|the|a|an|to|in|by)[ .]*$"))


def answer_overlap(answer: Column, context: Column, least: int = 4) -> Column:
    """Share of the answer's words of ``least`` characters or more that occur in the context; 0 for none."""
    w = F.filter(T.plain_tokens(answer), lambda x: F.length(x) >= least)
    return F.when(F.size(w) > 0, F.size(F.filter(w, lambda x: F.contains(F.lower(context), x))) / F.size(w)).otherwise(F.lit(0.0))


def request_error(question: Column, top_k: Column) -> Column:
    """Why a request is refused, or null."""
    return (
        F.when(F.coalesce(F.trim(question), F.lit("")) == "", "blank").when(F.length(question) > 4096, "too_long").when(F.octet_length(question) > 1 << 20, "too_large")
        .when(top_k.isNull() | ~top_k.between(1, 20), "top_k")
    )


