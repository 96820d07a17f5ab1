"""Question rules against answers written by hand: one prompt for each form of question, none of them taken from the tables."""

import pytest
from pyspark.sql import functions as F

from sparkevid.operators import gates, ranking
from sparkevid.operators import questions as Q

#: Intent, and forms in which X is the subject.
FORMS = {
    "entity_list": """Who were the main leaders of X? | Who were the major leaders of X? | Who were the key leaders of X? | Who were the main figures of X? | Who were the key figures of X?
        Who were important people in X? | Which people were important in X? | Who were notable figures in X? | Who were major political figures in X? | Which leaders were prominent in X?
        Who played major roles in X? | Name the important figures in X. | Name important figures in X. | Name key figures from X. | Name key figures in X. | List important leaders of X. | Identify key people from X.""",
    "structure": """Explain the internal structure of X. | Describe the molecular structure of X. | Explain the structure of X. | What is the structure of X? | What was the structure of X?
        How were X organized into units? | How are X organised into units? | How were X organized? | How is X organised? | How are X structured? | How was X structured? | In what way was X structured?
        In what way is X structured? | What are the parts of X? | What are the components of X? | What components form X? | What makes up X? | What is X made of? | What are X made of? | What units made up X?
        What units form X? | What units formed X? | What was the hierarchy of X? | How was X divided? | How are X divided? | How are the parts of X arranged? | What does the structure of X consist of?""",
    "process": """Explain how X works. | Describe how X works. | How does X work? | How exactly does X operate? | How does X operate? | What happens during X? | What happens when X takes place? | What occurs in X?
        What does X do? | What is the process of X? | Explain the process of X. | Describe the mechanism of X. | What are the stages of X? | What are the steps of X?
        What are the main steps involved in X? | How is energy converted during X? | How does X convert energy? | How does X convert light into sugar? | Explain what occurs in X.""",
    "features": """What are the main features of X? | What were the features of X? | What were the characteristics of X? | Describe the main features of X. | Describe the characteristics of X. | What characterized X?
        What characterizes X? | What defined X? | What defines X? | What features characterized X? | What political features did X have? | What institutions characterized X? | What were key characteristics of X?
        What were the defining features of X?""",
    "significance": """What is the significance of X? | What was the importance of X? | Why was X important? | Why is X important? | Why has X been considered important? | Why does X matter historically? | Why does X matter?
        What made X significant? | What was historically important about X? | What is important about X? | How was X historically significant? | How is X historically significant?
        What is historically significant about X? | What impact made X significant? | Explain the significance of X. | Describe the historical importance of X.""",
    "cause": """Explain why X declined. | Why did X decline? | Why was X declining? | Why did X weaken? | Why did X lose strength? | What caused X to decline? | What caused X to weaken? | What led to the decline of X?
        What made X eventually decline? | What made X decline? | What factors caused X to weaken? | What factors contributed to X's decline? | For what reasons did X decline? | What were the reasons for X's decline?
        How did X come to decline? | What drove X into decline? | What contributed to the weakening of X? | What brought about the decline of X? | What was behind the decline of X? | Which factors led to X's decline?
        What caused X to collapse? | What caused X to fall? | Why did X collapse? | Why did X fall? | What caused X?""",
    "effect": """What were the effects of X on trade? | What were the effects of X? | What was the effect of X? | What were the consequences of X? | What was the consequence of X? | What was the impact of X? | What happened after X?
        What resulted from X? | What followed X? | What came after X? | What changes followed X? | What developments followed X? | What happened as a result of X? | Describe the consequences of X.
        Explain the effects of X. | How did conditions change after X? | How did things change after X? | How did life change after X? | What consequences followed X? | What was one result of X?""",
    "change": """How did X's decline affect the development of the coast? | How did X influence the development of the coast? | How did X change over time? | How did X change? | How has X changed? | Describe how X changed.
        Describe the changes in X over time. | In what ways did X change? | How did X transform over time? | How did X develop over the centuries? | How did X develop over centuries? | How did X develop?
        How did X evolve through history? | How did X evolve? | How did X transition over time? | Describe the historical development of X. | What changes occurred in X over time? | What developments changed X?
        How was X different later in its history?""",
}
COMPARISONS = """What are the main differences between L and R? | What are the key differences between L and R? | What is the difference between L and R? | Explain the differences between L and R. | Describe the differences between L and R.
    Differences between L and R | Compare L and R. | Compare L with R. | Compare L to R. | What separates L from R? | What distinguishes L from R? | What differentiates L from R? | How is L different from R? | How are L different from R?
    How do L differ from R? | How does L differ from R? | How do L and R differ? | Describe how L differs from R. | In what ways do L and R differ? | What differs between L and R? | L versus R | L vs. R | L vs R"""
ASSERTED = {
    "cause": "Why did X cause Y? | How did X cause Y? | Explain how X caused Y. | Why did X lead Y?",
    "create": "How did X create Y? | How did X produce Y? | Describe how X formed Y. | Explain how X generates Y. | Explain the process by which X produced Y. | Why did X establish Y?",
    "limit": "Describe how X limited Y. | How did X restrict Y? | Why did X constrain Y?",
    "function_as": "Explain how X served as Y. | How did X act as Y?",
    "operate_as": "Describe how X operates as Y. | How did X operate as Y?",
    "structure_as": "Describe the structure of X as Y. | Explain how X was organised as Y. | How did X establish the structure of Y? | How did X build the structure of Y?",
    "describe_as": "Describe X as Y. | Explain X as Y.",
    "govern": "Explain how X governed Y. | How did X govern Y?",
    "organize": "Describe how X organized Y. | How did X organise Y? | Why did X organize Y?",
    "replicate": "Explain how X replicates Y. | How did X replicate Y? | Why did X replicate Y?",
    "separate": "Describe how X separated Y. | How did X separate Y? | Why did X separate Y?",
    "overthrow": "Why did X overthrow Y? | How did X overthrow Y? | What caused X to overthrow Y?",
    "sign": "Why did X sign Y? | How did X sign Y?",
    "invent": "Explain why X invented Y. | Describe how X invented Y. | Why did X discover Y?",
    "perform": "Explain how X performed Y. | Describe why X performs Y.",
    "split": "Explain how X splits Y. | How did X split Y? | Why did X divide Y? | How did X divide Y? | Describe how X divided Y. | Why did X split Y?",
}
CAUSAL = {
    "decline": "Why did X decline? | What caused X to decline? | What led to the decline of X? | What factors contributed to decline of X?", "collapse": "Why did X collapse? | What caused X to collapse? | What led to collapse of X? | What factors contributed to the collapse of X?",
    "weaken": "Why did X weaken? | What caused X to weaken?", "fail": "Why did X fail? | What caused X to fail?", "fall": "Why did X fall? | What caused X to fall? | What led to the fall of X? | What factors contributed to the fall of X?", "end": "Why did X end? | What caused X to end?",
}
ROUTES = {
    "extractor": "When was X born? | When was X founded? | When was X established? | When did X open? | When was X released? | When was X published? | Who or what was X named after? | What was X named after? | Where is X located? | What is X the capital of? | What is the capital of X? | What is the population of X? | What caused X? | Why was X closed? | Why did X fall? | Why did X end?",
    "model": "Why did X decline? | Why did X rise? | Why did X fail? | What caused X to grow? | Why is X important? | What was the importance of X? | Explain why X closed. | Contrast X and Y. | What is the difference between X and Y? | How are X different? | How did X close? | How does X work? | Describe how X works. | Tell me about X.",
}
SUBJECT, OTHER = "the Velan League", "the Orsk Union"


def prompts(text):
    return [p.strip() for line in text.split("\n") for p in line.split("|") if p.strip()]


def filled(p):
    return p.replace("X", SUBJECT).replace("Y", OTHER)


def cases(table):
    return [(filled(p), name) for name, text in table.items() for p in prompts(text)]


def wrong(spark, rows, schema, **columns):
    """Questions whose columns are not what is wanted."""
    d = spark.createDataFrame([(q, *(want if isinstance(want, tuple) else (want,))) for q, want in rows], f"question string, {schema}")
    d = d.select("question", *(F.struct(F.col(k), c.alias("got")).alias(f"_{k}") for k, c in columns.items()))
    return [tuple(r) for r in d.collect() if any(x[0] != x[1] for x in r[1:])]


def test_every_form_has_its_intent_and_subject(spark):
    rows = [(q, (name, SUBJECT)) for q, name in cases(FORMS)]
    d = spark.createDataFrame([(i, q, *want) for i, (q, want) in enumerate(rows)], "qid long, question string, want string, of string")
    plan = Q.plan(d).drop("question").join(d, "qid").collect()
    assert [(r["question"], r["intent"], r["subject"]) for r in plan if (r["intent"], r["subject"]) != (r["want"], r["of"])] == []
    assert len(plan) > 150


def test_every_comparison_has_its_sides(spark):
    asked = [p.replace("L", "the Velan Lxague").replace("R", OTHER).replace("Lxague", "League") for p in prompts(COMPARISONS)]
    d = spark.createDataFrame(list(enumerate(asked)), "qid long, question string")
    got = [(r["question"], r["intent"], r["left"], r["right"]) for r in Q.plan(d).collect()]
    assert [x for x in got if x[1:] != ("comparison", SUBJECT, OTHER)] == []
    same = spark.createDataFrame([(1, "Compare salt and Salt"), (2, "Compare salt and iron and wool")], "qid long, question string")
    assert [tuple(r) for r in Q.plan(same).orderBy("qid").select("intent", "left", "right").collect()] == [("general", None, None), ("comparison", "salt", "iron and wool")]


def test_questions_without_a_form_are_their_own_subject(spark):
    d = spark.createDataFrame([(1, "Why did it end?"), (2, "Salt?")], "qid long, question string")
    assert [tuple(r) for r in Q.plan(d).orderBy("qid").select("intent", "subject").collect()] == [("cause", "Why did it end"), ("general", "Salt")]


def test_asserted_relations(spark):
    rows = [(q, (name, SUBJECT, OTHER)) for q, name in cases(ASSERTED)] + [("How does it work?", (None, None, None))]
    relation, source, target = Q.asserted(F.col("question"))
    assert wrong(spark, rows, "relation string, source string, target string", relation=relation, source=source, target=target) == []


def test_causal_questions_and_routes(spark):
    from sparkevid.functions import rules as R

    bare = Q.bare(F.col("question"))
    rows = [(q, (name, SUBJECT)) for q, name in cases(CAUSAL)] + [("Why was it so?", (None, None))]
    assert wrong(spark, rows, "relation string, subject string", relation=R.first_match(bare, Q.CAUSAL_QUESTIONS), subject=R.first_group(bare, [p for _, p in Q.CAUSAL_QUESTIONS])) == []
    assert wrong(spark, cases(ROUTES), "route string", route=Q.route(F.col("question"))) == []


def test_expansions_ask_the_primary_ones_first(spark):
    d = spark.createDataFrame([(1, "Why did salt decline?"), (2, "Salt and iron")], "qid long, question string")
    got = {(r["qid"], r["query_rank"]): (r["is_primary"], r["query"]) for r in Q.expanded(Q.plan(d)).collect()}
    assert [got[1, k] for k in (1, 3, 4, 5, 6, 7, 8)] == [(True, "Why did salt decline?"), (False, "salt causes"), (False, "salt reasons"), (True, "salt decline causes"), (True, "salt caused by"), (False, "reasons for salt decline"), (False, "factors behind salt decline")]
    assert got[2, 1] == (True, "Salt and iron") and got[2, 3] == (False, "salt iron")


@pytest.mark.parametrize(
    ("intent", "sentence", "want"),
    [
        ("structure", "The organism grew.", False), ("structure", "An organization of boats.", True), ("structure", "Centurions marched.", False), ("structure", "A consistent answer.", False), ("structure", "It consists of two.", True),
        ("entity_list", "A leader spoke.", True), ("cause", "It was due to rain.", True), ("effect", "It resulted in rain.", True), ("general", "Nothing.", True), ("comparison", "Nothing.", True), ("change", "It stayed.", False),
    ],
)
def test_marks_of_intents(spark, intent, sentence, want):
    assert spark.range(1).select(gates.intent_supported(F.lit(sentence), F.lit(intent))).first()[0] is want


def test_chunk_rules(spark):
    rows = [
        ("What is it?", "It does not replace the pump.", -8.0), ("Does it replace the pump?", "It does not replace the pump.", 0.0), ("What is it?", "It is different from a pump.", -3.0), ("How is it different?", "It is different from a pump.", 0.0),
        ("What is it?", "A pump.", 0.0),
    ]
    d = spark.createDataFrame(rows, "q string, c string, want double")
    assert [tuple(r) for r in d.select("q", "c", "want", ranking.phrase_bonus(F.col("q"), F.col("c")).alias("got")).collect() if r["want"] != r["got"]] == []
