"""Extraction and answer synthesis: rules over a context, then scored and compressed sentences, then abstention."""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T
from . import compression, gates, questions, ranking

#: Rules in order: condition on the lower-case question, pattern on the context, template, least and most characters.
EXTRACT_RULES = (
    (r"\bborn\b", r"(?i)was born on ([A-Za-z]+ \d{1,2} ?, ?\d{4})", "{}", 1, 40),
    (r"\bborn\b", r"(?i)was born in (\d{4})", "{}", 1, 40),
    (r"\bfounded\b|\bestablished\b", r"(?i)was founded in (\d{4})", "{}", 1, 40),
    (r"\bfounded\b|\bestablished\b", r"(?i)was established in (\d{4})", "{}", 1, 40),
    (r"\breleased\b", r"(?i)was released in (\d{4})", "{}", 1, 40),
    (r"\bpublished\b", r"(?i)was published in (\d{4})", "{}", 1, 40),
    (r"\bnamed after\b", r"(?i)was named after ([^.;]+)", "{}", 1, 1000),
    (r"^why .*(?:fall|fell|collapse)", r"(?i)\b(?:finally )?fell after ([^.;]+)", "{}.", 5, 300),
    (r"^why .*(?:fall|fell|collapse)", r"(?i)\bcollapsed after ([^.;]+)", "{}.", 5, 300),
    (r"^why .*(?:fall|fell|collapse)", r"(?i)\bfell when ([^.;]+)", "{}.", 5, 300),
    (r"^why |^what caused ", r"(?i)\bbecause ([^.;]+)", "Because {}.", 3, 220),
    (r"^why |^what caused ", r"(?i)\bdue to ([^.;]+)", "It was due to {}.", 3, 220),
    (r"^why |^what caused ", r"(?i)\bas a result of ([^.;]+)", "It happened as a result of {}.", 3, 220),
    (r"^why |^what caused ", r"(?i)\bwas caused by ([^.;]+)", "{}.", 3, 220),
)
#: Causes by theme.
THEMES = (
    ("military pressure", ("military", "army", "troops", "overrun", "invading", "invasion", "defeat", "defeated", "war")),
    ("territorial losses", ("territorial", "territory", "provinces", "lost provinces")),
    ("economic problems", ("economic", "economy", "financial")),
    ("political instability", ("political", "revolt", "leadership", "government")),
    ("nationalist movements", ("nationalist", "nationalism")),
)


@dataclass(frozen=True)
class Kind:
    """How an intent's sentences are scored, chosen, compressed and introduced."""

    marks: tuple[tuple[str, float], ...]
    #: (words from, to, points); points above so many words.
    bands: tuple[tuple[int, int, float], ...]
    long: tuple[int, float]
    most: int
    words: int
    opening: str = ""
    #: The opening of several sentences only, and of those that do not begin with the subject.
    several: bool = False
    unless_named: bool = False
    #: Patterns with points, and what takes points.
    strong: tuple[tuple[str, float], ...] = ()
    noise: tuple[tuple[str, float], ...] = ()
    near: float = 0.65
    #: Clauses that stand for their sentence: pattern, and a form with its groups.
    clauses: tuple[tuple[str, str], ...] = ()
    #: Summaries: points of a common word with the question, of a mention of the subject, and of one without; sentences that lean on another.
    common: float = 0.0
    named: float = 0.0
    unnamed: float = 0.0
    leaning: float = 0.0
    #: Points of a sentence without any mark.
    unmarked: float = 0.0
    #: Whether sentences are cut to the clauses that keep their content, and whether one with the question's own words may take the last place.
    by_clauses: bool = False
    key_terms: bool = False


_GENERAL = (("produces", 2.0), ("includes", 2.0), ("consists", 2.0), ("contains", 2.0), ("limited", 2.0), ("organized", 2.0), ("predominant", 2.0), ("important", 1.5), ("significant", 2.0), ("because", 2.0), ("led to", 2.0), ("resulted", 2.0))
_SUMMARY = {"bands": ((8, 38, 2.0), (39, 50, 0.5)), "long": (60, -4.0), "words": 46, "common": 1.5, "named": 3.0}
_UNDER = (r"(?i)^(.+?) came under (.+?)(?:\.|$)", "$1 came under $2.")
#: Marks and their weights, patterns, lengths and clauses by intent.
KINDS = {
    "cause": Kind(
        marks=(
            ("decline", 2.0), ("declined", 2.5), ("collapse", 2.0), ("collapsed", 2.5), ("fall", 1.5), ("fell", 2.0), ("weaken", 1.5), ("weakened", 2.0), ("failed", 2.0), ("ended", 1.5), ("military", 2.0), ("army", 1.5), ("troops", 1.5), ("overrun", 3.0),
            ("invading", 2.5), ("invasion", 2.5), ("defeat", 2.5), ("defeated", 3.0), ("revolt", 2.5), ("territorial", 2.5), ("territory", 1.5), ("provinces", 1.5), ("economic", 2.0), ("economy", 2.0), ("political", 1.5), ("leadership", 1.5),
            ("government", 1.5), ("nationalist", 2.0), ("nationalism", 2.0), ("pressure", 1.5), ("crisis", 1.5),
        ),
        strong=((r"\bbecause of\b", 10.0), (r"\bbecause\b", 9.0), (r"\bdue to\b", 9.0), (r"\bcaused by\b", 9.0), (r"\bfell after\b", 8.0), (r"\bcollapsed after\b", 8.0), (r"\bdeclined because\b", 10.0), (r"\bwas overrun\b", 7.0), (r"\bwas defeated\b", 6.0)),
        bands=((8, 45, 1.0), (46, 60, 0.2)), long=(60, -3.0), most=3, words=46,
    ),
    "change": Kind(
        marks=(
            ("transitioned", 6.0), ("transition", 5.0), ("became", 5.0), ("changed", 4.0), ("developed", 4.0), ("evolved", 4.0), ("organized", 4.0), ("reorganized", 4.0), ("expanded", 3.0), ("grew", 3.0), ("increased", 2.5), ("declined", 3.0), ("weakened", 3.0), ("lost", 4.0),
            ("deprived", 3.0), ("moved", 2.5), ("shifted", 2.5), ("came under", 4.0), ("conquered", 3.0), ("formed", 2.0), ("created", 2.0),
        ),
        bands=((8, 35, 1.5), (36, 50, 0.5)), long=(60, -3.0), most=4, words=32, opening="{subject} changed in several important ways. ", several=True,
        clauses=(
            (r"(?i)^(.+?) remained (.+?) until it transitioned into (.+?)(?:\.|$)", "$1 transitioned from $2 into $3."), (r"(?i)^(.+?) transitioned into (.+?)(?:\.|$)", "$1 transitioned into $2."), (r"(?i)^(.+?) was organized into (.+?)(?:\.|$)", "$1 was organized into $2."),
            (r"(?i)^(.+?) lost territor(?:y|ies) (?:including |in )?(.+?)(?:\.|$)", "$1 lost territories including $2."), _UNDER,
            (r"(?i)^(.+?) moved to (.+?)(?:,|\.|$)", "$1 moved to $2."),
        ),
    ),
    "effect": Kind(
        marks=(
            ("as a result", 8.0), ("resulted in", 8.0), ("led to", 8.0), ("after", 2.0), ("following", 2.0), ("no longer", 5.0), ("no longer part", 7.0), ("lost", 5.0), ("loss", 3.0), ("territories", 3.0), ("came under", 6.0),
            ("became", 3.0), ("fragmented", 5.0), ("divided", 4.0), ("replaced", 4.0), ("moved", 2.0), ("shifted", 2.0), ("control", 2.0), ("power", 2.0),
        ),
        strong=((r"\bno longer part of\b", 8.0), (r"\bresulted in\b", 7.0), (r"\bled to\b", 7.0)),
        bands=((8, 45, 1.0),), long=(65, -2.0), most=4, words=34, near=0.60, opening="{subject} had several major effects. ", clauses=(_UNDER,),
    ),
    "structure": Kind(
        marks=(
            ("structure", 4.0), ("organized", 4.0), ("organisation", 4.0), ("organization", 4.0), ("consists", 4.0), ("consisted", 4.0), ("divided", 4.0), ("sub-unit", 4.0), ("subunit", 4.0), ("component", 3.0), ("components", 3.0), ("part", 2.0), ("parts", 2.0),
            ("hierarchy", 3.0), ("layer", 2.0), ("layers", 2.0), ("branch", 2.0), ("branches", 2.0),
        ),
        bands=((8, 45, 1.0),), long=(65, -2.0), most=3, words=46, opening="{subject} had a structured organization. ", named=3.0, unnamed=-20.0, by_clauses=True, key_terms=True,
    ),
    "features": Kind(marks=(*_GENERAL, ("institution", 4.0), ("government", 4.0), ("branch", 4.0), ("constitution", 4.0), ("system", 4.0), ("organized", 3.0), ("structure", 3.0)), most=3, opening="The main features of {subject} were: ", **_SUMMARY),
    "process": Kind(
        marks=(
            *_GENERAL, ("uses", 6.0), ("use", 4.0), ("converts", 7.0), ("convert", 6.0), ("produces", 5.0), ("produced", 4.0), ("splits", 6.0), ("split", 5.0), ("absorbs", 5.0), ("captures", 5.0), ("transforms", 6.0), ("releases", 5.0), ("released", 4.0), ("forms", 4.0),
            ("process", 3.0), ("mechanism", 3.0), ("energy", 2.0),
        ),
        most=3, opening="{subject} works through several key processes. ", unless_named=True, **_SUMMARY,
    ),
    "significance": Kind(
        marks=(
            ("limited power", 9.0), ("limited", 5.0), ("constrained", 7.0), ("restricted", 7.0), ("rights", 7.0), ("liberties", 7.0), ("constitutional", 6.0), ("rule of law", 8.0), ("authority", 5.0), ("power", 4.0), ("reformed", 5.0), ("changed", 4.0),
            ("transformed", 5.0), ("established", 4.0), ("influenced", 5.0),
        ),
        strong=tuple((rf"\b{m}", w) for m, w in _GENERAL),
        most=2, opening="{subject} was significant because it changed important political or legal relationships. ", unmarked=-5.0, leaning=-5.0, **_SUMMARY,
    ),
    "summary": Kind(marks=_GENERAL, most=3, opening="{subject} can be described as follows. ", **_SUMMARY),
}
PAST = {"decline": "declined", "collapse": "collapsed", "weaken": "weakened", "fail": "failed", "fall": "fell", "end": "ended"}
LEANING = r"(?i)^(?:these |those |this was |this is |both sides |they |it )"


def rule_extract(question: Column, context: Column) -> Column:
    """The first rule whose question and context match within its lengths, or null."""
    q = F.lower(F.trim(question))

    def filled(value: Column, form: str, least: int, most: int) -> Column:
        head, tail = form.split("{}")
        return F.when(F.length(value).between(least, most) & (value != ""), F.concat(F.lit(head), value, F.lit(tail)))

    found = []
    for asked, pattern, form, least, most in EXTRACT_RULES:
        value = F.trim(F.regexp_replace(F.regexp_extract(context, pattern, 1), r"\s+", " "))
        found.append(F.when(F.regexp_like(q, F.lit(asked)), R.let(value, partial(filled, form=form, least=least, most=most))))
    return F.coalesce(*found)


#: Verbs of when-questions, and of who-questions.
WHEN_WORDS = "born birth founded found established signed released published wrote written built created died death began started introduced invented discovered completed opened elected became constructed ruled reigned won joined left ended occurred happened".split()
WHO_VERBS = "wrote write written authored author invented discovered founded created composed painted built designed developed established led defeated directed starred"
NO_NAMES = "the in during after before when while even although once from this that however responding against around among".split()
_FUNCTION = "what is was are were the a an of and for with".split()


def sentence_answer(question: Column, sentences: Column) -> Column:
    """The rule answer of the first sentence that has one, else by the question's first word, or null.

    when: the first year of a sentence with the question's verb, or with its subject; who: the first name of two to four words beside
    what is asked about; what is: the first sentence with a word of the subject; where: a place after "located in" and the like; other
    questions with identifiers: the first sentence that has them."""
    first = lambda xs: F.get(F.filter(xs, lambda a: a.isNotNull()), F.lit(0))
    lowered = F.lower(F.trim(question))
    bare = F.regexp_replace(lowered, "[?. ]+$", "")
    verbs = WHO_VERBS.replace(" ", "|")
    asked = F.regexp_replace(F.regexp_replace(bare, rf"^who (?:(?:{verbs}) +)?", ""), "^(?:the|a|an) +", "")
    parts = {
        "q": lowered, "question": question, "ss": sentences, "predicate": questions.predicate(question), "verbs": F.array_intersect(F.split(bare, " +"), T.words_of(WHEN_WORDS)),
        "subject": F.regexp_replace(bare, "^when (?:was|were|is|are|did|does|do) +", ""), "action": F.regexp_extract(bare, rf"^who ({verbs}) ", 1), "object": asked,
        "topic": F.filter(F.split(F.regexp_replace(bare, "^what (?:is|was) +", ""), " +"), lambda w: (F.length(w) > 3) & ~w.isin(_FUNCTION)),
    }

    def found(x: Column) -> Column:
        def about(s: Column) -> Column:
            """What one sentence answers, by the question's first word."""

            def read(y: Column) -> Column:
                low = y["low"]
                fits = x["predicate"].isNull() | F.contains(low, x["predicate"])
                dated = F.when(F.size(x["verbs"]) > 0, F.exists(x["verbs"], lambda v: F.contains(low, v))).otherwise(F.contains(low, x["subject"]))
                names = F.filter(y["names"], lambda n: ~F.split(F.lower(n), " ")[0].isin(NO_NAMES) & ~F.arrays_overlap(F.split(F.lower(n), " "), F.split(x["object"], " +")))
                named = F.contains(low, x["object"]) & ((x["action"] == "") | F.contains(low, x["action"]))
                anchor = gates.identifier_anchor(x["question"], s)
                topical = ((F.size(x["topic"]) == 0) | F.exists(x["topic"], lambda w: F.contains(low, w))) & F.coalesce(anchor, F.lit(True))
                return (
                    F.when(F.startswith(x["q"], F.lit("when ")), F.when(dated & fits, F.nullif(y["year"], F.lit("")))).when(F.startswith(x["q"], F.lit("who ")), F.when(named & fits, F.get(names, F.lit(0))))
                    .when(F.regexp_like(x["q"], F.lit("^what (?:is|was) ")), F.when(topical & fits, s)).when(F.startswith(x["q"], F.lit("where ")), F.nullif(y["place"], F.lit("")))
                    .when(F.regexp_like(x["q"], F.lit("^(?:what|which|how long) ")), F.when(F.coalesce(anchor, F.lit(False)), s))
                )

            place = F.regexp_extract(s, r"\b(?:located|situated|found) (?:in|at|on) ([A-Z][A-Za-z' -]*[A-Za-z])", 1)
            one = {"low": F.lower(s), "year": F.regexp_extract(s, r"\b([12]\d{3})\b", 1), "names": F.regexp_extract_all(s, F.lit(r"\b[A-Z][a-z]+(?: [A-Z][a-z]+){1,3}\b"), F.lit(0)), "place": place}
            return R.let(F.struct(*(v.alias(k) for k, v in one.items())), read)

        return F.coalesce(first(F.transform(x["ss"], lambda s: rule_extract(x["question"], s))), first(F.transform(x["ss"], about)))

    return R.let(F.struct(*(v.alias(k) for k, v in parts.items())), found)


#: Sentences that a factual answer is put in, by relation.
FORMS = {"born": "{subject} was born in {answer}.", "founded": "{subject} was founded in {answer}.", "established": "{subject} was established in {answer}.", "released": "{subject} was released in {answer}.", "published": "{subject} was published in {answer}.", "named_after": "{subject} was named after {answer}."}


def formatted(question: Column, answer: Column) -> Column:
    """The answer as a sentence, by the question's form: a relation with its subject, a fall, a cause; else the answer itself."""
    tidy = F.regexp_replace(F.replace(F.trim(answer), F.lit(" - "), F.lit("-")), r"\s+", " ")
    parts = {"q": F.trim(question), "a": tidy, "core": F.regexp_replace(tidy, r"\.+$", ""), "subject": T.capitalized(ranking.relation_subject(question)), "kind": ranking.relation(question)}

    def said(x: Column) -> Column:
        form = R.template(x["kind"], FORMS, subject=x["subject"], answer=x["core"])
        born_on = F.when((x["kind"] == "born") & ~F.regexp_like(x["core"], F.lit(r"^\d{4}$")), F.concat(x["subject"], F.lit(" was born on "), x["core"], F.lit(".")))
        stopped = F.when(F.endswith(x["a"], F.lit(".")), x["a"]).otherwise(F.concat(x["a"], F.lit(".")))
        given = F.when(F.startswith(F.lower(x["q"]), F.lit("why ")) & F.regexp_like(F.lower(x["a"]), F.lit("^(?:because |it was due to |it happened as a result of )")), stopped)
        group = lambda p: T.capitalized(F.nullif(F.regexp_extract(x["q"], p, 1), F.lit("")))
        fall = F.concat(group(r"(?i)^why did (.+?) fall\??$"), F.lit(" fell after "), F.regexp_replace(x["core"], "(?i)^first ", ""), F.lit("."))
        cause = F.concat(group(r"(?i)^what caused (.+?)\??$"), F.lit(" was caused by "), x["core"], F.lit("."))
        return F.when(x["a"].isNotNull(), F.coalesce(born_on, form, given, fall, cause, T.capitalized(stopped)))

    return R.let(F.struct(*(v.alias(k) for k, v in parts.items())), said)


def themes(text: Column) -> Column:
    return F.filter(F.array(*(F.when(T.any_substring(text, marks), name) for name, marks in THEMES)), lambda x: x.isNotNull())


def compressed(sentence: Column, kind: Kind) -> Column:
    """The first clause of the kind that stands for the sentence, else the sentence without bracketed asides and leading connectives, in at
    most so many words."""
    found = []
    for pattern, form in kind.clauses:
        parts = [F.trim(F.regexp_extract(sentence, pattern, g)) for g in range(1, form.count("$") + 1)]
        text = F.lit(form)
        for g, part in enumerate(parts, 1):
            text = F.replace(text, F.lit(f"${g}"), part)
        found.append(F.when(F.regexp_like(sentence, F.lit(pattern)), text))
    s = F.regexp_replace(sentence, r"\s*\([^)]*\)", "")
    s = F.regexp_replace(s, r"(?i)^(?:however|moreover|furthermore|therefore|thus|in addition|for example|as a result),\s+", "")
    short = R.let(F.trim(s), lambda x: T.shortened(compression.shortest(x), kind.words)) if kind.by_clauses else T.shortened(F.trim(s), kind.words)
    return T.capitalized(T.display(F.coalesce(*found, short)))


def kind_score(sentence: Column, question: Column, subject: Column, kind: Kind) -> Column:
    """Points of marks, patterns, noise and length, and for summaries of the subject and the question's words."""

    def points(x: Column) -> Column:
        score = x["marks"] + F.when(x["marks"] == 0, kind.unmarked).otherwise(0.0)
        for pattern, w in (*kind.strong, *kind.noise):
            score = score + F.when(F.regexp_like(x["low"], F.lit(pattern)), w).otherwise(0.0)
        for lo, hi, w in kind.bands:
            score = score + F.when(x["n"].between(lo, hi), w).otherwise(0.0)
        score = score + F.when(x["n"] > kind.long[0], kind.long[1]).otherwise(0.0)
        if kind.common:
            score = score + kind.common * T.overlap(x["terms"], T.terms(question))
        if kind.named or kind.unnamed:
            score = score + F.when(T.overlap(x["terms"], T.terms(subject)) > 0, kind.named).otherwise(kind.unnamed)
        if kind.leaning:
            score = score + F.when(F.regexp_like(x["low"], F.lit(LEANING)), kind.leaning).otherwise(0.0)
        return score

    low = F.lower(sentence)
    parts = F.struct(low.alias("low"), T.mark_points(low, kind.marks).alias("marks"), F.size(T.space_words(sentence)).alias("n"), T.terms(sentence).alias("terms"))
    return R.let(parts, points)


def chosen(name: str, question: Column, subject: Column, sentences: Column) -> Column:
    """The best sentences of a kind with a score above zero, the earlier of equals first: array<struct<o, i, s>> in order of score."""
    kind = KINDS[name]
    scored = F.transform(sentences, lambda s, i: F.struct((-kind_score(s, question, subject, kind)).alias("o"), i.alias("i"), s.alias("s")))
    best = F.array_sort(F.filter(scored, lambda x: x["o"] < 0))
    return compression.with_key_terms(best, kind.most, T.terms(question), T.terms(subject)) if kind.key_terms else F.slice(best, 1, kind.most)


def synthesized(name: str, question: Column, subject: Column, sentences: Column) -> Column:
    """A kind's best sentences, back in document order, without near copies, compressed, and introduced; null without any.

    ``sentences`` is a question's selected evidence, so the array is short."""
    from .selection import greedy_distinct

    kind = KINDS[name]
    placed = F.transform(F.array_sort(F.transform(chosen(name, question, subject, sentences), lambda x: F.struct(x["i"].alias("i"), x["s"].alias("s")))), lambda x: x["s"])
    texts = greedy_distinct(F.transform(greedy_distinct(placed, kind.near), lambda s: compressed(s, kind)), kind.near)

    def said(t: Column) -> Column:
        opening = T.capitalized(F.replace(F.lit(kind.opening), F.lit("{subject}"), subject))
        bare = (F.size(t) == 1) if kind.several else F.startswith(F.lower(F.get(t, F.lit(0))), F.lower(subject)) if kind.unless_named else F.lit(not kind.opening)
        body = F.array_join(t, " ")
        return F.when(F.size(t) > 0, F.when(bare, body).otherwise(F.concat(opening, body)))

    return R.let(texts, said)


def causal(question: Column, subject: Column, sentences: Column) -> Column:
    """From the best sentences a because-clause, else an after-clause, else themes, else the best sentence; the verb is the question's."""
    best = F.transform(chosen("cause", question, subject, sentences), lambda x: x["s"])
    relation = R.first_match(questions.bare(question), questions.CAUSAL_QUESTIONS)
    verb = F.lit("declined")
    for name, past in PAST.items():
        verb = F.when(relation == name, past).otherwise(verb)

    def said(b: Column) -> Column:
        clause = lambda *ps: F.get(F.filter(F.transform(b, lambda s: F.coalesce(*(F.nullif(F.trim(F.regexp_extract(s, p, 1)), F.lit("")) for p in ps))), lambda x: x.isNotNull()), F.lit(0))
        because = clause(r"(?i)\bbecause of (.+?)(?:\.|$)", r"(?i)\bbecause (.+?)(?:\.|$)", r"(?i)\bdue to (.+?)(?:\.|$)", r"(?i)\bcaused by (.+?)(?:\.|$)")
        after = F.regexp_replace(clause(r"(?i)\bfell after (.+?)(?:\.|$)", r"(?i)\bcollapsed after (.+?)(?:\.|$)"), "(?i)^first ", "")
        named = themes(F.array_join(b, " "))
        of = F.coalesce(because, F.when(after.isNull() & (F.size(named) > 0), T.natural_list(named)))
        told = lambda word, x: F.concat(T.capitalized(subject), F.lit(" "), verb, F.lit(f" {word} "), T.display(x), F.lit("."))
        return F.coalesce(told("because of", because), told("after", after), told("because of", of), T.capitalized(F.get(b, F.lit(0))))

    return R.let(best, said)


_BECAUSE = (r"(?i)\bbecause of (.+?)(?:\.|$)", r"(?i)\bbecause (.+?)(?:\.|$)", r"(?i)\bdue to (.+?)(?:\.|$)", r"(?i)\bcaused by (.+?)(?:\.|$)")


def stated_cause(sentences: Column) -> Column:
    """The first because-clause of the sentences, or null."""
    found = F.transform(sentences, lambda s: F.coalesce(*(F.nullif(F.trim(F.regexp_extract(s, p, 1)), F.lit("")) for p in _BECAUSE)))
    return F.get(F.filter(found, lambda x: x.isNotNull()), F.lit(0))


def entity_list(subject: Column, sentences: Column) -> Column:
    """Up to four distinct names, the subject's own left out, from the two first sentences that name people in a leading role."""
    led = F.slice(F.filter(sentences, lambda s: (F.size(T.person_names(s)) > 0) & T.any_substring(s, gates.INTENT_MARKS["entity_list"])), 1, 2)
    names = F.filter(F.flatten(F.transform(led, T.person_names)), lambda n: ~F.contains(F.lower(subject), F.lower(n)))
    once = F.filter(names, lambda n, i: ~F.exists(F.slice(names, F.lit(1), i), lambda m: F.lower(m) == F.lower(n)))
    return F.when(F.size(once) > 0, F.concat(F.lit("Key figures of "), subject, F.lit(" included "), T.natural_list(F.slice(once, 1, 4)), F.lit(".")))


def compared(left: Column, right: Column, left_sentences: Column, right_sentences: Column, fall: Column | None = None) -> Column:
    """Shared and own themes of both sides with the stated cause of each, or the first two sentences of each. ``fall``: whether themes are asked for at all."""
    a, b = themes(F.array_join(left_sentences, " ")), themes(F.array_join(right_sentences, " "))
    both, only_a, only_b = F.array_intersect(a, b), F.array_except(a, b), F.array_except(b, a)
    parts = F.array(
        F.when(F.size(both) > 0, F.concat(F.lit("Both show "), T.natural_list(both), F.lit("."))), F.when(F.size(only_a) > 0, F.concat(left, F.lit(" shows "), T.natural_list(only_a), F.lit("."))),
        F.when(F.size(only_b) > 0, F.concat(right, F.lit(" shows "), T.natural_list(only_b), F.lit("."))),
    )
    because = [F.concat(name, F.lit(" fell because of "), stated_cause(ss), F.lit(".")) for name, ss in ((left, left_sentences), (right, right_sentences))]
    said = F.filter(F.concat(parts, F.array(*because)), lambda x: x.isNotNull())
    plain = F.concat(left, F.lit(": "), F.array_join(F.slice(left_sentences, 1, 2), " "), F.lit(" "), right, F.lit(": "), F.array_join(F.slice(right_sentences, 1, 2), " "))
    return F.when((F.size(left_sentences) > 0) & (F.size(right_sentences) > 0), F.when((F.size(said) > 0) & (F.lit(True) if fall is None else fall), F.array_join(said, " ")).otherwise(plain))


def answered(question: Column, intent: Column, subject: Column, sentences: Column, support: Column, conflict: Column) -> Column:
    """struct(answer, kind, ok): the gates and candidates in order.

    Conflict first; then, for a question without a special intent, an extracted answer, where a rule's one is sure enough; then the
    synthesis of its intent, if the evidence suffices; else abstention."""
    context = F.array_join(sentences, " ")
    found = F.when(intent == "general", F.struct(sentence_answer(question, sentences).alias("direct"), rule_extract(question, context).alias("ruled")))
    direct = R.let(found, lambda x: F.when(x["ruled"].isNull() | (gates.extraction_confidence(question, context, x["ruled"]) >= gates.CONFIDENT), formatted(question, x["direct"])))
    made = F.when(intent == "cause", causal(question, subject, sentences)).when(intent == "entity_list", entity_list(subject, sentences))
    for kind in ("change", "effect", "structure", "significance", "process", "features"):
        made = made.when(intent == kind, synthesized(kind, question, subject, sentences))
    low = F.lower(questions.normalized(question))
    told = (intent == "general") & ~R.any_match(low, questions.FACTUAL) & (R.first_match(low, questions.SUMMARY_MODES, "none") != "none")
    made = made.when(told, synthesized("summary", question, subject, sentences))  # a factual question without an answer is not told about

    def decided(x: Column) -> Column:
        use_direct, use_made = x["direct"].isNotNull(), x["made"].isNotNull() & x["support"]
        answer = F.when(x["conflict"], gates.CONFLICT).when(use_direct, x["direct"]).when(use_made, x["made"]).otherwise(gates.REFUSAL)
        kind = F.when(x["conflict"], "conflict").when(use_direct, "extracted").when(use_made, "synthesized").otherwise("system")
        return F.struct(answer.alias("answer"), kind.alias("kind"), (~x["conflict"] & (use_direct | use_made)).alias("ok"))

    return R.let(F.struct(direct.alias("direct"), made.alias("made"), support.alias("support"), conflict.alias("conflict")), decided)


def polish_route(question: Column, supported: Column) -> Column:
    """Where a language model, if one is plugged in, would be asked."""
    from .questions import UI_INTENTS

    kind = R.first_match(F.lower(F.trim(question)), UI_INTENTS, "hybrid")
    return F.when(kind == "lookup", "rag_only").when((kind == "generative") & ~supported, "generative").otherwise("hybrid")
