"""Compression against all deletions, key terms, side confidence, hops: by hand and by brute force."""

import random
from itertools import product

import pytest
from pyspark.sql import functions as F

from sparkevid.functions import text as T
from sparkevid.operators import answering, compression, gates, synthesis
from sparkevid.operators import questions as Q

WORDS = "river mill gate tide salt wool iron rope pier dock boat sail".split()


def python_terms(text):
    import re

    stop = set(T.STOPWORDS + T.MORE_STOPWORDS)
    return {w for w in re.findall("[a-z0-9']+", text.lower()) if len(w) >= 3 and w not in stop}


def brute(sentence, most):
    import re

    parts = [x for x in re.sub("([,;]) +", "\\1\x02", re.sub("[.!? ]+$", "", sentence)).split("\x02") if x]
    n = len(parts)
    if n > most:
        parts = [" ".join(p for i, p in enumerate(parts) if i * most // n == g) for g in range(most)]
        n = most
    if n < 2:
        return sentence
    every, found = python_terms(sentence), []
    for bits in product((0, 1), repeat=n):
        mask = sum(b << i for i, b in enumerate(bits))
        kept = " ".join(p for p, b in zip(parts, bits, strict=True) if b)
        text = re.sub("[,;]$", "", kept)
        if mask and len(python_terms(kept)) >= 0.65 * len(every):
            found.append((len(text), mask, text))
    return min(found)[2] + "."


def test_shortest_form_against_all_deletions(spark):
    rng = random.Random(7)
    data = ["", "One clause only.", "A, b; c.", "The the, of and."]
    for _ in range(60):
        data.append("; ".join(", ".join(" ".join(rng.choice(WORDS + ["the", "of"]) for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 3))) + ".")
    d = spark.createDataFrame([(x,) for x in data], "s string")
    for most in (10, 4):
        got = {r[0]: r[1] for r in d.select("s", compression.shortest(F.col("s"), most=most)).collect()}
        assert got == {x: brute(x, most) for x in data}


def test_key_terms_take_the_last_place(spark):
    rows = [(["The gate is old.", "The gate is tall.", "The gate has three leaves."], "what leaves has the gate", 2), (["The gate is old.", "Leaves of the gate.", "The gate has three leaves."], "what leaves has the gate", 2), (["Old.", "Tall."], "gate", 1)]
    d = spark.createDataFrame(rows, "ss array<string>, q string, k int")
    scored = F.transform("ss", lambda s, i: F.struct((i - 10.0).alias("o"), i.alias("i"), s.alias("s")))
    got = [[x["s"] for x in r[0]] for r in d.select(compression.with_key_terms(scored, 2, T.terms(F.col("q")), T.terms(F.lit("the gate")))).collect()]
    assert got == [["The gate is old.", "The gate has three leaves."], ["The gate is old.", "Leaves of the gate."], ["Old.", "Tall."]]


@pytest.mark.parametrize(
    ("sentences", "fall", "want"),
    [
        (["The Orsk Union was small.", "Taxes were low."], False, (0.95, True)), (["Taxes were low."], False, (0.05, False)), (["The Orsk Union fell."], True, (0.9, True)), (["The Orsk Union sang."], True, (0.5, False)), ([], False, (0.0, False)),
    ],
)
def test_side_confidence(spark, sentences, fall, want):
    d = spark.createDataFrame([(sentences, "the Orsk Union", fall)], "ss array<string>, e string, f boolean")
    score, enough = d.select(gates.side_confidence(F.col("ss"), F.col("e"), F.col("f")).alias("x")).select("x.*").first()
    coverage = min(1, len(sentences) / 3)
    hit, shown = any("Orsk Union" in s for s in sentences), want[1]
    weights = (0.45, 0.40, 0.15) if fall else (0.50, 0.35, 0.15)
    assert score == pytest.approx(weights[0] * hit + weights[1] * shown + weights[2] * coverage, abs=1e-6) and enough == want[1]


def test_causes_of_both_sides(spark):
    d = spark.createDataFrame([(["Vela lost a war because its fleet was old."], ["Orsk had an economic crisis due to debts."])], "l array<string>, r array<string>")
    said = d.select(synthesis.compared(F.lit("Vela"), F.lit("Orsk"), F.col("l"), F.col("r"))).first()[0]
    assert said == "Vela shows military pressure. Orsk shows economic problems. Vela fell because of its fleet was old. Orsk fell because of debts."


@pytest.mark.parametrize(
    ("question", "want"),
    [
        ("Who led the guild and when was the leader born?", True), ("What were the effects of the drought on trade?", True), ("What caused the fall and its aftermath?", True), ("What happened to the mill and the consequences?", True),
        ("What impact did the drought have on trade?", True), ("Who led the guild?", False), ("Compare mills and presses.", False), ("What effects did the drought have?", False),
    ],
)
def test_questions_of_two_hops(spark, question, want):
    from sparkevid.functions import rules as R

    d = spark.createDataFrame([(question,)], "q string")
    assert d.select(R.any_match(F.lower(Q.bare(F.col("q"))), Q.HOPS)).first()[0] == want


@pytest.mark.parametrize(("question", "relation"), [("How did X limit Y?", "limit"), ("Explain how X protected Y.", "protect"), ("How does X influence Y?", "influence"), ("How did X establish Y?", "create"), ("Why did X cause Y?", "cause"), ("How did X transform Y?", "change"), ("Describe how X replaced Y.", "replace"), ("How do X support Y?", "support"), ("What is X?", None)])
def test_premise_families(spark, question, relation):
    from sparkevid.functions import rules as R

    d = spark.createDataFrame([(question,)], "q string")
    b = Q.bare(F.col("q"))
    got = d.select(R.first_match(b, Q.PREMISES), R.first_group(b, [p for _, p in Q.PREMISES], 1), R.first_group(b, [p for _, p in Q.PREMISES], 2)).first()
    assert tuple(got) == ((relation, "X", "Y") if relation else (None, None, None))


def test_second_hop_asks_for_names_of_the_first(spark):
    """No retrieval of the question alone finds when the leader was born: the text of it names no guild."""
    from sparkevid.plans import rule_queries as P

    chunks = spark.createDataFrame(P.CORPUS, "chunk_id long, text string, runtime boolean")
    rows = [(1, "Who led the Quern Guild and when was the leader born?", ["The Quern Guild was led by Ivo Brandt, its leader for years."]), (2, "Who led the Quern Guild?", ["The Quern Guild was led by Ivo Brandt, its leader for years."])]
    found = answering.second_hops(spark.createDataFrame(rows, "qid long, question string, sentences array<string>"), chunks).collect()
    assert [(r["qid"], r["second"]) for r in found] == [(1, "when was the leader born")]
    assert found[0]["hop_sentences"][0] == "Ivo Brandt was born in 1832 in Moor."
    none = answering.second_hops(spark.createDataFrame(rows[1:], "qid long, question string, sentences array<string>"), chunks)
    assert none.collect() == []


def marks_by_hand(sentence, intent, subject):
    import re

    low = sentence.lower()
    hits = sum(m in low for m in gates.INTENT_MARKS.get(intent, ()))
    points = hits * (2.5 if intent in ("process", "change", "features") else 3.0)
    if intent == "structure":
        points += 5.0 * (hits >= 2) + 5.0 * (hits >= 3)
    if intent == "entity_list":
        names = re.findall(r"\b[A-Z][a-z]+(?:-[A-Z][a-z]+)? [A-Z][a-z]+(?:-[A-Z][a-z]+)?\b", sentence)
        points += min(8.0, 4.0 * len(names)) + 6.0 * bool(names and any(m in low for m in ("member", "government", "leader"))) - 8.0 * sum(m in low for m in ("newspaper", "museum", "painting", "collection"))
    if intent == "comparison":
        points += 2.0 * len(python_terms(sentence) & python_terms(subject))
    return points


def test_marks_of_sentences_by_hand(spark):
    said = [
        "A gate consists of parts.", "The gate is divided into parts, a component of its structure.", "It was red.", "", "Mara Tolle and Ivo Brandt were members of the board.", "A museum shows a painting of Mara Tolle.",
        "Ana-Lise Roe, Ivo Brandt and Mara Tolle met.", "It fell because of a revolt and was defeated.", "The mill uses water and works in stages.", "Trade declined, moved and became small.", "The gate and the mill differ.",
    ]
    rows = [(x, i, "the gate and the mill") for x in said for i in (*gates.INTENT_MARKS, "comparison", "general")]
    d = spark.createDataFrame(rows, "s string, i string, t string")
    got = d.select("s", "i", answering.intent_marks(F.col("s"), F.col("i"), F.col("t")).alias("p")).collect()
    assert [(r["s"], r["i"], r["p"]) for r in got] == [(s, i, marks_by_hand(s, i, t)) for s, i, t in rows]
