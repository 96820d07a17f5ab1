"""Quality rules: a learned decision list over text statistics, applied as ordered Spark conditionals.

Statistics are built-in functions over whole texts, within a row, so nothing is shuffled. The list is learned by
sequential covering: a conjunction of thresholds is grown by FOIL gain on two thirds of a labelled
sample, pruned on the last third, and kept while it is precise there; the rows it covers go, and the next is grown.
The sample holds at most ``max_labelled`` labelled documents, those of the smallest hash of the id; all else
covers all rows. Rules reject; a document that no rule covers is kept.

Null text: no words, base_failed. Empty labels, or labels of one kind: no rules. A repeated label of a document counts
once, with its lowest quality. Extra columns are not read, or kept by ``apply_rules``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import table
from .substring_dedup import words

#: Fixed values of the base rules.
SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: Documents at most that the list is learned from.
MAX_LABELLED = 20_000
_SPACE = " \t\n\x0b\x0c\r"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_MARKS = "!?;:=_~^@\\/+{}[]()\"'`"


def _without(text: Column, characters: str) -> Column:
    """Code points of the text that are one of these."""
    return F.length(text) - F.length(F.translate(text, characters, ""))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once a row, wherever the optimizer moves the expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeated(windows: Column) -> Column:
    """Words covered by windows that occur at least twice, from the windows' hashes in order."""

    def covered(placed: Column) -> Column:
        twice = F.filter(placed, lambda x, k: F.coalesce(F.get(placed, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(placed, k + 1)["h"] == x["h"], F.lit(False)))
        return _let(F.sort_array(F.transform(twice, lambda x: x["i"])), lengths)

    def lengths(at: Column) -> Column:
        own = F.transform(at, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - p, F.lit(WINDOW))))
        return F.aggregate(own, F.lit(0).cast("long"), lambda n, x: n + x)

    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), _let(placed, covered)).otherwise(F.lit(0).cast("long"))


def with_statistics(documents: DataFrame) -> DataFrame:
    """The documents with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed.

    Words of 5-word windows are compared by 64-bit hashes within a text."""
    text = F.coalesce("text", F.lit(""))

    def of_words(w: Column) -> Column:
        window = F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(WINDOW))))
        windows = F.when(F.size(w) >= WINDOW, window).otherwise(F.array().cast("array<bigint>"))
        return F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("distinct"), _let(windows, _repeated).alias("repeated"))

    def of_lines(x: Column) -> Column:
        return F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("distinct"))

    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, _SPACE, "")) > 0)
    d = documents.withColumns({"_w": _let(words(text), of_words), "_l": _let(lines, of_lines)})
    d = d.withColumns({
        "n_words": F.col("_w.n").cast("long"),
        "word_chars": F.length(F.translate(text, _SPACE, "")).cast("long"),
        "n_symbols": _without(text, SYMBOLS).cast("long"),
        "n_dup_lines": (F.col("_l.n") - F.col("_l.distinct")).cast("long"),
        "n_repeat_words": F.col("_w.repeated"),
        "_n_lines": F.col("_l.n"),
        "_n_upper": _without(text, _UPPER),
        "_n_marks": _without(text, _MARKS),
        "_n_distinct": F.col("_w.distinct"),
    })
    return d.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))).drop("_w", "_l")


def features() -> dict[str, Column]:
    """What rules may look at, by name; all are defined for a row of any size."""
    per_word = lambda c: F.col(c) / F.greatest(F.col("n_words"), F.lit(1))
    per_char = lambda c: F.col(c) / F.greatest(F.col("word_chars"), F.lit(1))
    return {
        "n_words": F.col("n_words").cast("double"),
        "word_length": per_word("word_chars"),
        "symbols_per_word": per_word("n_symbols"),
        "repeat_share": per_word("n_repeat_words"),
        "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("_n_lines"), F.lit(1)),
        "upper_share": per_char("_n_upper"),
        "marks_per_word": per_word("_n_marks"),
        "distinct_share": per_word("_n_distinct"),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    threshold: float

    def holds(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        v = x[:, names.index(self.feature)]
        return v >= self.threshold if self.at_least else v < self.threshold

    def column(self) -> Column:
        v = features()[self.feature]
        return v >= F.lit(self.threshold) if self.at_least else v < F.lit(self.threshold)


Rule = tuple[Condition, ...]


def _covers(rule: Rule, x: np.ndarray, names: list[str]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for c in rule:
        out &= c.holds(x, names)
    return out


def _best_condition(x: np.ndarray, bad: np.ndarray, names: list[str]) -> Condition | None:
    """Of the most FOIL gain: bad rows kept, times the bits gained on their share; thresholds halve the gap between values."""
    p, n = bad.sum(), (~bad).sum()
    if not p or not n:
        return None
    base, best = np.log2(p / (p + n)), (1e-9, None)
    for k, name in enumerate(names):
        order = np.argsort(x[:, k], kind="stable")
        v, b = x[order, k], bad[order]
        cuts = np.flatnonzero(v[1:] > v[:-1]) + 1
        if not len(cuts):
            continue
        below, total = np.cumsum(b)[cuts - 1], np.cumsum(np.ones(len(b)))[cuts - 1]
        for at_least, pos, size in ((False, below, total), (True, p - below, len(b) - total)):
            gain = pos * (np.log2(np.maximum(pos, 1e-12) / size) - base)
            i = int(np.argmax(gain))
            if gain[i] > best[0]:
                best = (gain[i], Condition(name, at_least, float((v[cuts[i] - 1] + v[cuts[i]]) / 2)))
    return best[1]


def learn(x: np.ndarray, bad: np.ndarray, names: list[str], prune: np.ndarray, max_rules: int = 12, max_conditions: int = 4, precision: float = 0.9) -> list[Rule]:
    """Sequential covering. ``prune`` marks the rows that rules are pruned and judged on; the others grow them."""
    rules: list[Rule] = []
    left = np.ones(len(x), bool)
    while len(rules) < max_rules:
        grow, judge = left & ~prune, left & prune
        rule: Rule = ()
        inside = grow.copy()
        while len(rule) < max_conditions and (c := _best_condition(x[inside], bad[inside], names)):
            rule += (c,)
            inside &= c.holds(x, names)
        if not rule:
            break

        def worth(r: Rule, judge: np.ndarray = judge) -> float:
            hit = _covers(r, x, names) & judge
            return (bad[hit].sum() - (~bad[hit]).sum()) / max(1, hit.sum())

        while len(rule) > 1:
            shorter = max((rule[:i] + rule[i + 1 :] for i in range(len(rule))), key=worth)
            if worth(shorter) < worth(rule):
                break
            rule = shorter
        hit = _covers(rule, x, names) & judge
        if not hit.sum() or bad[hit].mean() < precision:
            break
        rules.append(rule)
        left &= ~_covers(rule, x, names)
    return rules


def labelled_sample(documents: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """Features, label and split of at most ``max_labelled`` labelled documents."""
    picked = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    picked = picked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(picked), "doc_id")
    rows = with_statistics(rows)
    return rows.select("base_failed", (F.col("quality") == 0).alias("bad"), (F.pmod(F.xxhash64(F.col("doc_id"), F.lit("split")), F.lit(3)) == 0).alias("prune"), *(c.alias(k) for k, c in features().items()))


def learn_rules(documents: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> list[Rule]:
    names = list(features())
    rows = [r for r in labelled_sample(documents, labels, max_labelled).collect() if not r["base_failed"]]
    if not rows:
        return []
    x = np.array([[r[k] for k in names] for r in rows], float)
    order = np.lexsort((*x.T, [r["bad"] for r in rows]))  # the rows come in any order
    bad, prune = (np.array([bool(r[k]) for r in rows])[order] for k in ("bad", "prune"))
    return learn(x[order], bad, names, prune)


def verdict(rules: list[Rule]) -> Column:
    """false from the first rule that covers a row, else true."""
    out = F.when(F.col("base_failed"), False)
    for rule in rules:
        condition = rule[0].column()
        for c in rule[1:]:
            condition &= c.column()
        out = out.when(condition, False)
    return out.otherwise(True)


def apply_rules(documents: DataFrame, rules: list[Rule]) -> DataFrame:
    """The documents with their statistics, base_failed and kept, which replace columns of these names."""
    d = with_statistics(documents).withColumn("kept", verdict(rules))
    return d.drop("_n_lines", "_n_upper", "_n_marks", "_n_distinct")


def kept_documents(documents: DataFrame, rules: list[Rule]) -> DataFrame:
    """The documents that are kept, with all their columns as they were."""
    rows = documents.select(F.struct(*documents.columns).alias("_row"), F.col("text").alias("text"))
    return apply_rules(rows, rules).where("kept").select("_row.*")


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    rules = learn_rules(documents, table(spark, sf_dir, "labels"))
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return apply_rules(documents.select("doc_id", "text"), rules).select(*columns)
