"""Training examples from declarative text: questions and answers, contexts, filters, caps, triples."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T
from . import gates, index

_YEAR = r"(1[0-9]{3}|20[0-9]{2})(?:[ ,.;]|$)"
#: Type, pattern with subject and answer, question; tried in order.
MINING = (
    ("born_year", rf"(?i)^(.{{2,120}}?) was born in {_YEAR}", "When was {s} born?"),
    ("born_date", r"(?i)^(.{2,120}?) was born on ([A-Za-z]+ \d{1,2} ?, ?(?:1[0-9]{3}|20[0-9]{2}))(?:[ ,.;]|$)", "When was {s} born?"),
    ("founded_year", rf"(?i)^(.{{2,120}}?) was founded in {_YEAR}", "When was {s} founded?"),
    ("established_year", rf"(?i)^(.{{2,120}}?) was established in {_YEAR}", "When was {s} established?"),
    ("release_year", rf"(?i)^(.{{2,120}}?) was released in {_YEAR}", "When was {s} released?"),
    ("published_year", rf"(?i)^(.{{2,120}}?) was published in {_YEAR}", "When was {s} published?"),
    ("opened_year", rf"(?i)^(.{{2,120}}?) opened in {_YEAR}", "When did {s} open?"),
    ("population", r"(?i)^(.{2,120}?) had a population of ([0-9][0-9,. ]*)(?:[.;]|$)", "What population did {s} have?"),
    ("capital", r"(?i)^(.{2,100}?) is the capital of (.{2,100}?)(?:[.;]|$)", "What is {s} the capital of?"),
    ("location", r"(?i)^(.{2,100}?) is located in ([A-Z][A-Za-z0-9' .-]{1,80})(?:[.;]|$)", "Where is {s} located?"),
    ("named_after", r"(?i)^(.{2,100}?) was named after (.{2,100}?)(?:[.;]|$)", "Who or what was {s} named after?"),
)
#: Reasons, the types that are kept, and words that make a subject vague.
REASONS = (("because", r"(?i)^(.{5,160}?) because ([^.;]{8,220})"), ("due_to", r"(?i)^(.{5,160}?) (?:was |were )?due to ([^.;]{8,220})"), ("result_of", r"(?i)^(.{5,160}?) as a result of ([^.;]{8,220})"), ("caused_by", r"(?i)^(.{5,160}?) was caused by ([^.;]{8,220})"))
ALLOWED = ("born_year", "born_date", "founded_year", "established_year", "release_year", "published_year", "named_after")
VAGUE = "he she it they their his her this that these those there which who previously following lying".split()
CAP = 20_000
#: Most words of an answer, by type.
LONGEST = {"location": 10, "capital": 12}
#: The five types of instructions of the third form.
INSTRUCTIONS = (
    MINING[0],
    MINING[1],
    MINING[2],
    ("founded_year", MINING[3][1], MINING[3][2]),
    MINING[8],
    MINING[4],
)
LEAST_LINE = 30


def _trimmed(t: Column) -> Column:
    return F.regexp_replace(t, r"^[ ,.;:-]+|[ ,.;:-]+$", "")


def mined(sentence: Column, rules: tuple = MINING) -> Column:
    """struct(type, question, answer) of the first pattern with a valid subject and answer, or null; 25 to 400 characters."""

    def tried(x: Column, *, kind: str, question: str) -> Column:
        subject, answer = x["subject"], x["answer"]
        words = T.space_words(subject)
        valid = F.length(subject).between(2, 120) & F.size(words).between(1, 14) & F.length(answer).between(1, 120)
        valid = valid & ~F.exists(words, lambda w: F.regexp_replace(F.lower(w), "[ ,.;:]+", "").isin(VAGUE)) & (F.length(subject) - F.length(F.replace(subject, F.lit(","), F.lit(""))) <= 1)
        valid = valid & (F.size(T.space_words(answer)) <= LONGEST[kind]) if kind in LONGEST else valid & (F.length(answer) <= 30) if kind == "population" else valid
        head, tail = question.split("{s}")
        return F.when(valid, F.struct(F.lit(kind).alias("type"), F.concat(F.lit(head), subject, F.lit(tail)).alias("question"), answer.alias("answer")))

    def first(s: Column) -> Column:
        parts = lambda p: F.struct(_trimmed(F.regexp_extract(s, p, 1)).alias("subject"), _trimmed(F.regexp_extract(s, p, 2)).alias("answer"))
        found = [R.let(parts(p), partial(tried, kind=kind, question=question)) for kind, p, question in rules]
        return F.when(F.length(s).between(25, 400), F.coalesce(*found))

    return R.let(F.trim(sentence), first)


def reasons(sentence: Column) -> Column:
    """struct(type, question, answer) of a stated reason, or null."""
    found = []
    for kind, pattern in REASONS:
        subject, answer = _trimmed(F.regexp_extract(sentence, pattern, 1)), _trimmed(F.regexp_extract(sentence, pattern, 2))
        found.append(F.when((subject != "") & F.length(answer).between(8, 220), F.struct(F.lit(kind).alias("type"), F.concat(F.lit("Why is it that "), subject, F.lit("?")).alias("question"), answer.alias("answer"))))
    return F.coalesce(*found)


def with_context(sentences: DataFrame, key: str, limit: int = 1200) -> DataFrame:
    """Adds the sentence before, itself and the one after, cut at ``limit``. Needs key, idx, sentence."""
    by = Window.partitionBy(key).orderBy("idx")
    joined = F.concat_ws(" ", F.lag("sentence").over(by), F.col("sentence"), F.lead("sentence").over(by))
    return sentences.withColumn("context", F.left(joined, F.lit(limit)))


def examples(texts: DataFrame, key: str, mine=mined, limit: int = 1200) -> DataFrame:
    """key, idx, type, question, answer, context of all sentences that a rule mines; the answer is in the context."""
    s = texts.select(key, F.posexplode(T.sentences(F.col("text"))).alias("idx", "sentence"))
    s = with_context(s, key, limit).withColumn("m", mine(F.col("sentence"))).where("m is not null")
    s = s.select(key, "idx", "m.*", "context")
    return s.where(F.contains(F.lower("context"), F.lower("answer")))


def first_examples(found: DataFrame, key: str, cap: int | None = CAP) -> DataFrame:
    """The first ``cap`` in scan order, which is the feature here, or all; then the first of each question and answer. Needs key and idx."""
    kept = found if cap is None else found.orderBy(key, "idx").limit(cap)
    return kept.groupBy(F.lower("question").alias("_q"), F.lower("answer").alias("_a")).agg(F.min_by(F.struct(*found.columns), F.struct(key, "idx")).alias("r")).select("r.*")


def filtered(found: DataFrame) -> DataFrame:
    """Allowed types that read well and are covered by their context."""
    good = gates.example_kept(F.col("question"), F.col("answer")) & (gates.answer_overlap(F.col("answer"), F.col("context"), 1) >= 0.75)
    return found.where(F.col("type").isin(*ALLOWED)).where(good)


def prompt(context: Column, question: Column, answer: Column) -> Column:
    return F.concat(F.lit("<CONTEXT>\n"), context, F.lit("\n<QUESTION>\n"), question, F.lit("\n<ANSWER>\n"), answer)


def instructions(texts: DataFrame, key: str, times: int = 3) -> DataFrame:
    """``times`` sentences of each text, picked by a hash of text and number: key, i, instruction, response."""
    s = texts.select(key, T.sentences(F.col("text")).alias("s")).where(F.size("s") > 0)
    i = s.select(key, "s", F.explode(F.sequence(F.lit(1), F.lit(times))).alias("i"))
    pick = F.pmod(F.xxhash64(key, "i"), F.size("s").cast("long")).cast("int")
    return i.select(key, "i", F.lit("Continue or explain this passage.").alias("instruction"), F.get("s", pick).alias("response"))


def result_prompt(context: Column, question: Column) -> Column:
    return F.concat(F.lit("<RESULT>\n"), context, F.lit("\n\n<ANSWER>\nQuestion: "), question, F.lit("\nAnswer:"))


def instruction_question(sentence: Column) -> Column:
    """"What is <subject>?" or "What was <subject>?" for a subject of 3 to 12 words before the first " is " or " was ", else a question
    about the first five words of five letters or more."""
    subject = lambda verb: T.trimmed(F.split(sentence, f" {verb} ", 2)[0])
    asked = lambda verb: F.when(F.contains(F.lower(sentence), F.lit(f" {verb} ")) & F.size(T.space_words(subject(verb))).between(3, 12), F.concat(F.lit(f"What {verb} "), subject(verb), F.lit("?")))
    useful = F.slice(F.filter(T.training_tokens(sentence), lambda w: F.length(w) >= 5), 1, 5)
    topic = F.when(F.size(useful) > 0, F.array_join(useful, " ")).otherwise("this topic")
    return F.coalesce(asked("is"), asked("was"), F.concat(F.lit("According to the context, what information is given about "), topic, F.lit("?")))


def evidence_instructions(texts: DataFrame, key: str, times: int | None = 3) -> DataFrame:
    """The second form: key, i, prompt and answer of ``times`` sentences of each text, picked as in ``instructions``, or of every sentence."""
    s = texts.select(key, "text", T.sentences(F.col("text")).alias("s")).where(F.size("s") > 0)
    if times is None:
        s = s.select(key, "text", F.posexplode("s").alias("i", "answer"))
    else:
        pick = F.pmod(F.xxhash64(key, "i"), F.size("s").cast("long")).cast("int")
        s = s.select(key, "text", "s", F.explode(F.sequence(F.lit(1), F.lit(times))).alias("i")).select(key, "text", "i", F.get("s", pick).alias("answer"))
    return s.select(key, "i", result_prompt(F.col("text"), instruction_question(F.col("answer"))).alias("prompt"), "answer")


def mined_instructions(lines: DataFrame, key: str) -> DataFrame:
    """The third form: examples of five types from lines of 30 characters or more, the first of each question and answer, with prompts; all
    of the table, however many."""
    e = examples(lines.where(F.length("text") >= LEAST_LINE), key, partial(mined, rules=INSTRUCTIONS))
    return first_examples(e, key, None).withColumn("prompt", result_prompt(F.col("context"), F.col("question")))


def shuffled(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """A fixed order that has nothing to do with the rows' own."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key)


def triples(texts: DataFrame, key: str) -> DataFrame:
    """query (three keyphrases), positive and negative key."""
    phrases = index.keyphrases(texts, key, 3).groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]), " ").alias("query"))
    return phrases.join(index.negative_samples(texts, key), key).select(key, "query", "negative")
