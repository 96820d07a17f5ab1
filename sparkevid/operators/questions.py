"""Understanding of questions by ordered rule tables: intent, subject, route, expansion, relations, hops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T

#: Intents in the order in which they are tried, and the phrases that show them (lower case).
INTENTS = (
    ("comparison", r"\bcompare\b|\bdifferences? between\b|\bversus\b|\bvs\b|\bwhat (?:separates|distinguishes|differentiates) .+ from .+|\bwhat differs between .+ and .+|\b(?:how|in what ways) (?:is|are) .+ different\b.*|\bhow (?:do|does) .+ differ from .+|\b(?:how|in what ways) (?:do|does) .+ and .+ differ\b|\b(?:describe|explain) how .+ (?:differs|is different) from\b|\bhow do .+ and .+ compare\b|\bhow does .+ compare (?:with|to)\b"),
    ("significance", r"\b(?:significance|importance) of\b|\bhistorical (?:importance|significance)\b|\bwhy (?:was|is) .+ important\b|\bwhy has .+ been considered important\b|\bwhy (?:does|did) .+ matter\b|\bwhat (?:impact )?made .+ significant\b|\bwhat (?:was|is) (?:historically )?(?:important|significant) about\b|\bhow (?:was|is) .+ historically significant\b"),
    ("effect", r"\b(?:effects?|consequences?) of\b|\bimpact of\b|\bresulted from\b|\bwhat happened after\b|\bwhat followed\b|\bwhat came after\b|\b(?:changes|developments|consequences) followed\b|\bwhat (?:was|is) one result of\b|\bwhat (?:were the results|was the result) of\b|\bas a result of\b|\bhow did (?:conditions|things|life) change after\b"),
    ("change", r"\bchanges? over time\b|\bhow did .+ (?:change|transform|develop|evolve)\b|\bhow has .+ changed\b|\bhow was .+ different later\b|\bdescribe how .+ changed\b|\bdescribe the changes in\b|\bin what ways did .+ change\b|\bdevelop over\b|\bdevelopment of\b|\bevolution of\b|\btransition over time\b|\bwhat changes occurred in\b|\bwhat developments changed\b"),
    ("features", r"\b(?:features|characteristics) of\b|\bwhat (?:features |institutions )?(?:characterized|characterizes|defined|defines)\b|\bwhat (?:features|characteristics) did .+ have\b|\bwhat political features did\b"),
    ("structure", r"\bstructure of\b|\bstructured\b|\borgani[sz](?:ed|ation)\b|\b(?:components|parts) of\b|\bmade of\b|\bmakes? up\b|\bcomponents form\b|\bwhat units (?:made up|form(?:ed)?)\b|\bhow .+ (?:arranged|divided)\b|\bhierarchy of\b"),
    ("entity_list", r"\b(?:main|major|key) leaders of\b|\bleaders were prominent\b|\bkey figures (?:of|from)\b|\bmain figures of\b|\b(?:important|notable|major political) figures\b|\b(?:important|key) people\b|\bwhich people were important\b|\bplayed major roles\b|\bname .+ figures\b|\blist .+ leaders\b"),
    ("process", r"\bhow .+ (?:works?|operates?)\b|\bwhat happens (?:during|when)\b|\bwhat occurs in\b|\bwhat does .+ do\b|\b(?:process|mechanism|stages|steps) of\b|\bmain steps involved in\b|\bhow is .+ converted during\b|\bhow does .+ convert\b|\bexplain how\b"),
    ("cause", r"^why\b|^explain why\b|^what (?:caused|made|led|drove|contributed|brought about|was behind)\b|^which factors led\b|^what factors (?:contributed|caused)\b|^for what reasons\b|^what were the reasons\b|^how did .+ come to decline\b"),
)
#: Subject patterns of a whole question by intent; the first that matches gives group 1. Without a match the whole question is the subject.
SUBJECTS = {
    "entity_list": (
        r"(?i)^who were (?:the )?(?:main|major|key|important|notable|major political) (?:leaders|figures|people) (?:of|in|from) (.+)$",
        r"(?i)^which (?:people were important|leaders were prominent) in (.+)$",
        r"(?i)^who played major roles in (.+)$",
        r"(?i)^(?:name|list|identify) (?:the )?(?:important|key|main) (?:leaders|figures|people) (?:of|in|from) (.+)$",
    ),
    "structure": (
        r"(?i)^(?:explain|describe) the (?:internal |molecular )?structure of (.+)$",
        r"(?i)^what (?:is|was|are|were) the (?:structure|hierarchy|parts|components) of (.+)$",
        r"(?i)^what does the structure of (.+) consist of$",
        r"(?i)^how are the parts of (.+) arranged$",
        r"(?i)^(?:how|in what way) (?:is|are|was|were) (.+?) (?:organi[sz]ed|structured|divided)(?: into units)?$",
        r"(?i)^what (?:components form|makes up|units made up|units form|units formed) (.+)$",
        r"(?i)^what (?:is|are) (.+) made of$",
    ),
    "process": (
        r"(?i)^(?:explain|describe) how (.+) works$",
        r"(?i)^how (?:exactly )?does (.+) (?:work|operate)$",
        r"(?i)^how (.+) operates$",
        r"(?i)^what happens during (.+)$",
        r"(?i)^what happens when (.+) takes place$",
        r"(?i)^(?:explain )?what occurs in (.+)$",
        r"(?i)^what does (.+) do$",
        r"(?i)^(?:what is|explain) the process of (.+)$",
        r"(?i)^describe the (?:mechanism|basic operation) of (.+)$",
        r"(?i)^what are the (?:stages|steps) of (.+)$",
        r"(?i)^what are the main steps involved in (.+)$",
        r"(?i)^explain the main process involved in (.+)$",
        r"(?i)^how is .+? converted during (.+)$",
        r"(?i)^how does (.+?) convert .+$",
    ),
    "features": (
        r"(?i)^what (?:are|were) (?:the )?(?:main |defining |key )?(?:features|characteristics) of (.+)$",
        r"(?i)^describe (?:the )?(?:main features|characteristics|important institutions) of (.+)$",
        r"(?i)^what (?:features |institutions )?(?:characterized|characterizes|defined|defines) (.+)$",
        r"(?i)^what political features did (.+) have$",
    ),
    "significance": (
        r"(?i)^what (?:is|was) the (?:significance|importance) of (.+)$",
        r"(?i)^why (?:was|is) (.+) important$",
        r"(?i)^why has (.+) been considered important$",
        r"(?i)^why does (.+?) matter(?: historically)?$",
        r"(?i)^what (?:impact )?made (.+) significant$",
        r"(?i)^what (?:was|is) (?:historically )?important about (.+)$",
        r"(?i)^what (?:was|is) historically significant about (.+)$",
        r"(?i)^how (?:was|is) (.+) historically significant$",
        r"(?i)^(?:explain the significance|describe the historical importance) of (.+)$",
    ),
    "cause": (
        r"(?i)^explain why (.+) declined$",
        r"(?i)^why was (.+) declining$",
        r"(?i)^why did (.+) (?:decline|weaken|lose strength|collapse|fall)$",
        r"(?i)^what (?:factors )?caused (.+) to (?:decline|weaken|collapse|fall)$",
        r"(?i)^what made (.+?) (?:eventually )?decline$",
        r"(?i)^what (?:led to|brought about|was behind) the decline of (.+)$",
        r"(?i)^what contributed to the weakening of (.+)$",
        r"(?i)^(?:what factors contributed to|what were the reasons for|which factors led to) (.+?)(?:'s)? decline$",
        r"(?i)^for what reasons did (.+) decline$",
        r"(?i)^how did (.+) come to decline$",
        r"(?i)^what drove (.+) into decline$",
        r"(?i)^what caused (.+)$",
    ),
    "effect": (
        r"(?i)^what (?:were|are|was|is) the effects of (.+?) on .+$",
        r"(?i)^what were the (?:effects|consequences) of (.+)$",
        r"(?i)^what was the (?:effect|consequence|impact) of (.+)$",
        r"(?i)^what (?:happened after|resulted from|came after|happened as a result of) (.+)$",
        r"(?i)^what (?:changes |developments |consequences )?followed (.+)$",
        r"(?i)^(?:describe the consequences|explain the effects) of (.+)$",
        r"(?i)^how did (?:conditions|things|life) change after (.+)$",
        r"(?i)^what was one result of (.+)$",
    ),
    "change": (
        r"(?i)^how did (.+?)(?:'s|’s) (?:decline|fall|collapse|weakening) (?:affect|influenced?|impact|shaped?|transform) .+$",
        r"(?i)^how did (.+?) (?:affect|influenced?|impact|shaped?|transform) (?:the )?(?:development|evolution|emergence) of .+$",
        r"(?i)^how did (.+?) change(?: over time)?$",
        r"(?i)^how did (.+) (?:transform|transition) over time$",
        r"(?i)^how has (.+) changed$",
        r"(?i)^describe how (.+) changed$",
        r"(?i)^explain how (.+) changed over time$",
        r"(?i)^describe the changes in (.+) over time$",
        r"(?i)^in what ways did (.+) change$",
        r"(?i)^how did (.+?) develop(?: over (?:the )?centuries)?$",
        r"(?i)^how did (.+?) evolve(?: through history)?$",
        r"(?i)^describe the historical development of (.+)$",
        r"(?i)^what changes occurred in (.+) over time$",
        r"(?i)^what developments changed (.+)$",
        r"(?i)^how was (.+) different later in its history$",
    ),
}
#: Both sides of a comparison; the first "and", "with" or "to" parts them.
PAIRS = (
    r"(?i)^(?:what (?:are|is) the |explain the |describe the )?(?:main |key )?differences? between (.+?) and (.+)$",
    r"(?i)^compare (.+?) (?:and|with|to) (.+)$",
    r"(?i)^how does (.+?) compare (?:with|to) (.+)$",
    r"(?i)^how do (.+?) and (.+) compare$",
    r"(?i)^what (?:separates|distinguishes|differentiates) (.+?) from (.+)$",
    r"(?i)^how (?:is|are) (.+?) different from (.+)$",
    r"(?i)^how are (.+?) and (.+) different$",
    r"(?i)^how (?:do|does) (.+?) differ from (.+)$",
    r"(?i)^how (?:do|does) (.+?) and (.+) differ$",
    r"(?i)^(?:describe|explain) how (.+?) (?:differs|is different) from (.+)$",
    r"(?i)^in what ways (?:are|do) (.+?) and (.+?) (?:different|differ)$",
    r"(?i)^what differs between (.+?) and (.+)$",
    r"(?i)^(.+?) (?:versus|vs\.?) (.+)$",
)
CANONICAL = {
    "comparison": "What are the differences between {left} and {right}?",
    "cause": "Why did {subject} decline?",
    "change": "How did {subject} change over time?",
    "effect": "What were the effects of {subject}?",
    "structure": "What is the structure of {subject}?",
    "process": "Explain how {subject} works.",
    "features": "What were the main features of {subject}?",
    "significance": "What is the significance of {subject}?",
    "entity_list": "Who were the key figures of {subject}?",
}
#: Expansion by intent in order, and those of them that are asked first, whatever the evidence.
EXPANSIONS = {
    "entity_list": ("{subject} leaders", "{subject} key figures", "{subject} political leaders", "{subject} important people", "{subject} notable figures", "{subject} major figures"),
    "structure": ("{subject} structure", "{subject} organization", "{subject} components", "{subject} parts", "{subject} hierarchy", "what {subject} consists of"),
    "process": ("{subject} process", "{subject} mechanism", "{subject} stages", "how {subject} works", "{subject} operation"),
    "features": ("{subject} main features", "{subject} features", "{subject} characteristics", "{subject} institutions", "{subject} structure government system"),
    "significance": ("{subject} significance", "{subject} importance", "{subject} impact influence", "{subject} historical importance", "{subject} historical significance"),
    "cause": ("{subject} causes", "{subject} reasons", "{subject} decline causes", "{subject} caused by", "reasons for {subject} decline", "factors behind {subject} decline"),
    "effect": ("{subject} effects", "{subject} consequences", "{subject} aftermath", "{subject} impact", "what happened after {subject}", "results of {subject}"),
    "change": ("{subject} change over time", "{subject} development", "{subject} evolution", "{subject} transition", "history of {subject} changes"),
    "comparison": ("{left} characteristics", "{right} characteristics", "{left} {right} differences", "{left} versus {right}", "difference between {left} and {right}"),
}
PRIMARY = {
    "entity_list": ("{subject} key figures", "{subject} leaders"),
    "structure": ("{subject} structure", "{subject} organization"),
    "process": ("{subject} process", "{subject} mechanism"),
    "features": ("{subject} main features", "{subject} characteristics"),
    "significance": ("{subject} significance", "{subject} importance"),
    "cause": ("{subject} decline causes", "{subject} caused by"),
    "effect": ("{subject} effects", "{subject} consequences"),
    "change": ("{subject} change over time", "{subject} development"),
    "comparison": ("{left} characteristics", "{right} characteristics", "{left} {right} differences"),
}
#: (intent, place, whether it is asked first, template) of all expansions; places 1 and 2 are the question and its canonical form.
TEMPLATES = tuple((name, i, text in PRIMARY[name], text) for name, texts in EXPANSIONS.items() for i, text in enumerate(texts, 3))
_DECLINE = "decline|collapse|rise|change|grow|expand|weaken|fail"
ANALYTICAL = (
    rf"\bwhy did .+ (?:{_DECLINE})\b", rf"\bwhat caused .+ to (?:{_DECLINE})\b", r"\bwhy (?:was|is) .+ important\b", r"\bwhat (?:is|was) the (?:significance|importance) of\b", r"\bexplain (?:why|how)\b",
    r"\bcompare\b", r"\bcontrast\b", r"\bwhat (?:is|are) the differences? between\b", r"\bhow are .+ different\b", r"\bhow (?:did|does) .+", r"\bdescribe how .+",
)
EXTRACTIVE = (
    r"\bwhy did .+ (?:fall|end)\b", r"\bwhen (?:was|is) .+ born\b", r"\bwhen was .+ (?:founded|established|released|published)\b", r"\bwhen (?:was|did) .+ open(?:ed)?\b", r"\bwho (?:or what )?was .+ named after\b",
    r"\bwhat was .+ named after\b", r"\bwhere is .+ located\b", r"\bwhat is (?:.+ )?the capital of\b", r"\bwhat is the population of\b", r"\bwhat caused .+", r"\bwhy was .+",
)
#: Relations that a question asserts, in the order in which they are tried: name, pattern with source and target.
ASSERTED = (
    ("cause", r"(?i)^(?:why|how) did (.+?) cause (.+)$"),
    ("cause", r"(?i)^(?:explain|describe) how (.+?) caused (.+)$"),
    ("structure_as", r"(?i)^how did (.+?) (?:establish|create|build|form) the structure of (.+)$"),
    ("create", r"(?i)^how did (.+?) (?:create|produce|generate|form|establish|establishes|established) (.+)$"),
    ("create", r"(?i)^(?:explain|describe) how (.+?) (?:creates?|created|produces?|produced|generates?|generated|forms?|formed|establish|establishes|established) (.+)$"),
    ("create", r"(?i)^(?:explain|describe) the process by which (.+?) (?:created|produced|generated|formed) (.+)$"),
    ("limit", r"(?i)^(?:describe|explain) how (.+?) (?:limited|restricted|constrained) (.+)$"),
    ("limit", r"(?i)^(?:how|why) did (.+?) (?:limit|restrict|constrain) (.+)$"),
    ("function_as", r"(?i)^(?:explain|describe) how (.+?) (?:functioned|acted|served) as (.+)$"),
    ("function_as", r"(?i)^how did (.+?) (?:function|act|serve) as (.+)$"),
    ("operate_as", r"(?i)^(?:explain|describe) how (.+?) (?:operated|operates|operate) as (.+)$"),
    ("operate_as", r"(?i)^how did (.+?) operate as (.+)$"),
    ("structure_as", r"(?i)^(?:describe|explain) the structure of (.+?) as (.+)$"),
    ("structure_as", r"(?i)^(?:describe|explain) how (.+?) was (?:structured|organi[sz]ed) as (.+)$"),
    ("describe_as", r"(?i)^(?:describe|explain) (.+?) as (.+)$"),
    ("govern", r"(?i)^(?:describe|explain) how (.+?) (?:governed|governs|govern) (.+)$"),
    ("govern", r"(?i)^how did (.+?) govern (.+)$"),
    ("organize", r"(?i)^(?:describe|explain) how (.+?) organi[sz](?:ed|es|e) (.+)$"),
    ("organize", r"(?i)^(?:how|why) did (.+?) organi[sz]e (.+)$"),
    ("replicate", r"(?i)^(?:describe|explain) how (.+?) (?:replicated|replicates|replicate) (.+)$"),
    ("replicate", r"(?i)^(?:how|why) did (.+?) replicate (.+)$"),
    ("separate", r"(?i)^(?:describe|explain) how (.+?) (?:separated|separates|separate) (.+)$"),
    ("separate", r"(?i)^(?:how|why) did (.+?) separate (.+)$"),
    ("overthrow", r"(?i)^(?:why|how) did (.+?) overthrow (.+)$"),
    ("overthrow", r"(?i)^what caused (.+?) to overthrow (.+)$"),
    ("sign", r"(?i)^(?:why|how) did (.+?) sign (.+)$"),
    ("invent", r"(?i)^(?:explain|describe) (?:why|how) (.+?) (?:invented|invents|invent) (.+)$"),
    ("perform", r"(?i)^(?:explain|describe) (?:why|how) (.+?) (?:performed|performs|perform) (.+)$"),
    ("split", r"(?i)^(?:explain|describe) how (.+?) (?:splits?|divides?|divided) (.+)$"),
    ("split", r"(?i)^(?:how|why) did (.+?) (?:split|divide) (.+)$"),
    ("create", r"(?i)^why did (.+?) (?:create|produce|generate|form|establish|established) (.+)$"),
    ("invent", r"(?i)^why did (.+?) (?:invent|discover|develop) (.+)$"),
    ("cause", r"(?i)^why did (.+?) lead (.+)$"),
)
PREDICATES = ("born", "founded", "established", "released", "published", "named after", "located", "located in", "capital", "capital of", "population", "invented", "discovered", "wrote", "written by", "signed", "built", "opened", "closed", "led", "led by", "won", "died", "married", "elected", "caused", "caused by")
_FALLS = ("decline", "collapse", "weaken", "fail", "fall", "end")
CAUSAL_QUESTIONS = tuple(
    [(k, rf"(?i)^why did (.+) {k}$") for k in _FALLS] + [(k, rf"(?i)^what caused (.+) to {k}$") for k in _FALLS]
    + [(k, rf"(?i)^what (?:led|factors contributed) to (?:the )?{k} of (.+)$") for k in ("decline", "collapse", "fall")]
)
#: Premises of summaries: the relation's family, by how a question says it ("how did X limit Y", "how X limited Y", "how does X limit Y").
PREMISE_VERBS = {
    "limit": "limit(?:s|ed)?|restrict(?:s|ed)?|constrain(?:s|ed)?", "protect": "protect(?:s|ed)?|guarantee(?:s|d)?|defend(?:s|ed)?", "influence": "influenc(?:e|es|ed)|shap(?:e|es|ed)|affect(?:s|ed)?",
    "create": "creat(?:e|es|ed)|establish(?:es|ed)?|found(?:s|ed)?", "cause": "caus(?:e|es|ed)", "change": "chang(?:e|es|ed)|transform(?:s|ed)?|reform(?:s|ed)?", "replace": "replac(?:e|es|ed)|succeed(?:s|ed)?", "support": "support(?:s|ed)?|strengthen(?:s|ed)?",
}
PREMISES = tuple((name, rf"(?i)^(?:{form}) (.+?) (?:{verbs}) (.+)$") for name, verbs in PREMISE_VERBS.items() for form in ("how did|how does|how do|why did", "(?:explain|describe) how"))
SUMMARY_MODES = (("significance", r"\bsignifican|\bimportan"), ("features", r"\bfeatures\b|\bcharacteri"), ("explain", r"^explain\b|\bhow (?:do|does) .+ work"), ("describe", r"^describe\b|^what (?:is|was|are|were)\b"))
FACTUAL = (r"^(?:who|when|where|what|which|how long)\b",)
EFFECT_QUESTIONS = (
    r"\bwhat (?:were|was|are|is) the effects? of\b", r"\bwhat (?:were|was|are|is) the consequences? of\b", r"\bwhat happened after\b", r"\b(?:what )?resulted from\b", r"\bwhat did .+ lead to\b", r"\bhow did .+ affect\b",
    r"\bimpact of\b", r"\bexplain the effects? of\b", r"\bdescribe the consequences? of\b",
)
CHANGE_QUESTIONS = (r"\bhow did .+ change\b", r"\bchanges? .*over time\b", r"\bhow did .+ develop\b", r"\bhow did .+ evolve\b", r"\bwhat changed about\b")
#: A second need: a clause that asks on, an aftermath beside something else, or the effect of one subject on another.
_ON = "effects?|impact|influence|consequences?"
HOPS = (
    r"\b(?:and|or) (?:how|why|when|where|who|what)\b", rf"\b(?:{_ON}) of .+ on .+", r"\band (?:its|their|his|her) .+", rf"\b(?:and|or) (?:the |what )?(?:{_ON}|aftermath|results?)\b", r"\b(?:afterwards?|after that|as a result)$",
    rf"\bwhat (?:{_ON}) did .+ have on .+", r"\bhow did .+ (?:affect|influence|shape|transform) the (?:development|evolution|emergence) of .+",
)
TYPES = (("factual", r"^(?:who|when|where|which)\b"), ("causal", r"^why\b|\bcaus"), ("comparison", r"\bcompare\b|\bdifference"), ("process", r"^how\b"), ("definition", r"^what (?:is|are|was|were)\b"))
UI_INTENTS = (("lookup", r"^(?:who|when|where|which)\b|\bhow many\b|\bdefine\b"), ("generative", r"\bwrite\b|\bcompose\b|\bstory\b|\bpoem\b|\bdraft\b"))


def normalized(question: Column) -> Column:
    return F.trim(F.regexp_replace(question, "[ \t\n]+", " "))


def bare(question: Column) -> Column:
    return F.regexp_replace(normalized(question), "[?.!]+$", "")


def intent(question: Column) -> Column:
    return R.first_match(F.lower(normalized(question)), INTENTS, "general")


def subject(question: Column, by: Column) -> Column:
    """The subject for an intent, its leading article kept; the whole question where no pattern matches."""
    out = F.lit(None).cast("string")
    for name, patterns in SUBJECTS.items():
        out = F.when(by == name, R.first_group(bare(question), patterns)).otherwise(out)
    return T.clean_subject(F.coalesce(out, bare(question)))


def pair(question: Column) -> tuple[Column, Column]:
    """Two different sides of a comparison, or nulls."""
    sides = F.struct(*(T.clean_subject(R.first_group(bare(question), PAIRS, g)).alias(k) for g, k in ((1, "l"), (2, "r"))))
    sides = R.let(sides, lambda s: F.when(F.lower(s["l"]) != F.lower(s["r"]), s))
    return sides["l"], sides["r"]


def effect_subject(text: Column) -> Column:
    """"X fell" and "X's fall" to "the fall of X"; likewise collapse."""
    for verb, noun in (("fell", "fall"), ("collapsed", "collapse")):
        text = F.regexp_replace(text, f"(?i)^(.+?) {verb}$", f"the {noun} of $1")
        text = F.regexp_replace(text, f"(?i)^(.+?)(?:'s|’s) {noun}$", f"the {noun} of $1")
    return text


def plan(questions: DataFrame) -> DataFrame:
    """qid, question, intent, subject, left, right, canonical. A comparison needs two sides, any other intent a subject; else it is general."""
    q = F.col("question")
    left, right = pair(q)
    d = questions.withColumns({"left": left, "right": right, "found": intent(q)})
    d = d.withColumn("intent", F.when((F.col("found") == "comparison") & F.col("left").isNull(), "general").otherwise(F.col("found")))
    own = subject(q, F.col("intent"))
    d = d.withColumn("subject", F.when(F.col("intent") == "effect", effect_subject(own)).otherwise(own))
    canonical = R.template(F.col("intent"), CANONICAL, subject=F.col("subject"), left=F.col("left"), right=F.col("right"))
    return d.select("qid", "question", "intent", "subject", "left", "right", canonical.alias("canonical"))


def expanded(plans: DataFrame) -> DataFrame:
    """qid, query_rank, is_primary, query: the question, its canonical form and the templates of its intent; equal queries count once, the first wins.

    General questions add their content words. Templates are literals within the row, so nothing is joined."""
    parts = {c: F.col(c) for c in ("subject", "left", "right")}

    def item(rank: int, primary: bool, text: Column) -> Column:
        return F.struct(F.lit(rank).alias("rank"), F.lit(primary).alias("primary"), text.alias("query"))

    items = [item(1, True, normalized(F.col("question"))), item(2, True, F.col("canonical"))]
    items += [item(rank, primary, R.template(F.col("intent"), {name: text}, **parts)) for name, rank, primary, text in TEMPLATES]
    items.append(item(3, False, F.when(F.col("intent") == "general", F.array_join(T.content_words(F.col("question")), " "))))
    rows = plans.select("qid", F.explode(F.filter(F.array(*items), lambda x: x["query"].isNotNull() & (x["query"] != ""))).alias("x")).select("qid", "x.*")
    once = rows.groupBy("qid", F.lower("query").alias("key")).agg(F.min_by(F.struct("rank", "primary", "query"), "rank").alias("x"))
    return once.select("qid", F.col("x.rank").alias("query_rank"), F.col("x.primary").alias("is_primary"), "x.query")


def route(question: Column) -> Column:
    """extractor for direct questions that are not analytical, unless a specialised intent is planned; else model."""
    q = F.lower(normalized(question))
    return F.when(R.any_match(q, ANALYTICAL), "model").when(R.any_match(q, EXTRACTIVE), "extractor").otherwise("model")


def hops(question: Column) -> tuple[Column, Column]:
    """Two concepts of a multi-hop question: both sides of "effects of A on B", else of and, or, because, since; a short second one gets the first's words."""
    q = bare(question)
    first = F.coalesce(R.first_group(q, (r"(?i)(effects? of .+?) on .+$",)), R.first_group(q, (r"(?i)^(.+?) (?:and|or|because|since|as a result of) .+$",)))
    second = F.coalesce(R.first_group(q, (r"(?i)effects? of .+? on (.+)$",)), R.first_group(q, (r"(?i)^.+? (?:and|or|because|since|as a result of) (.+)$",)))
    padded = F.when(F.size(T.space_words(second)) <= 3, F.concat(second, F.lit(" "), F.array_join(T.content_words(first), " "))).otherwise(second)
    return first, padded


def predicate(question: Column) -> Column:
    """The longest known predicate in the question, or null."""
    q = F.lower(question)
    found = F.filter(T.words_of(sorted(PREDICATES, key=lambda p: (-len(p), p))), lambda p: F.contains(q, p))
    return F.get(found, F.lit(0))


def asserted(question: Column) -> tuple[Column, Column, Column]:
    """(relation, source, target) that a question takes for granted."""
    q = bare(question)
    relation = R.first_match(q, ASSERTED)
    patterns = [p for _, p in ASSERTED]
    return relation, T.clean_subject(R.first_group(q, patterns, 1)), T.clean_subject(R.first_group(q, patterns, 2))
