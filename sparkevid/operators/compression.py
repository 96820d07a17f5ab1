"""Compression of a sentence under a coverage bound: the shortest choice of its clauses that keeps most of its content words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T

#: Share of the content words that must stay.
SHARE = 0.65
#: Clauses that are searched over; of a sentence with more, neighbours go together so that there are no more.
CLAUSES = 10


def clauses(sentence: Column) -> Column:
    """The sentence cut behind commas and semicolons, its end mark left out."""
    body = F.regexp_replace(sentence, "[.!? ]+$", "")
    return F.filter(F.split(F.regexp_replace(body, "([,;]) +", "$1\u0002"), "\u0002"), lambda x: x != "")


def grouped(parts: Column, most: int = CLAUSES) -> Column:
    """The clauses, in at most ``most`` runs of neighbours."""
    n = F.size(parts)
    group = lambda i: F.floor(i * most / n)
    runs = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda g: F.array_join(F.filter(parts, lambda x, i: group(i) == g), " "))
    return F.when(n <= most, parts).otherwise(F.filter(runs, lambda x: x != ""))


def shortest(sentence: Column, share: float = SHARE, most: int = CLAUSES) -> Column:
    """The fewest characters among all deletions of clauses that keep ``share`` of the distinct content words, the earlier clauses of equals.

    All 2 ** n - 1 choices are tried; a sentence of one clause stays as it is."""

    def search(x: Column) -> Column:
        def choice(mask: Column) -> Column:
            kept = F.filter(x["parts"], lambda p, i: F.getbit(mask, i) == 1)
            text = F.regexp_replace(F.array_join(F.transform(kept, lambda p: p["text"]), " "), "[,;]$", "")
            covered = F.size(F.array_distinct(F.flatten(F.transform(kept, lambda p: p["terms"]))))
            return F.struct(F.length(text).alias("n"), mask.alias("mask"), text.alias("text"), (covered >= share * x["all"]).alias("ok"))

        masks = F.sequence(F.lit(1).cast("long"), F.pow(F.lit(2), F.size(x["parts"])).cast("long") - 1)
        best = F.array_min(F.filter(F.transform(masks, choice), lambda c: c["ok"]))["text"]
        return F.when(F.size(x["parts"]) < 2, sentence).otherwise(F.concat(best, F.lit(".")))

    parts = F.transform(grouped(clauses(sentence), most), lambda p: F.struct(p.alias("text"), T.terms(p).alias("terms")))
    return R.let(F.struct(parts.alias("parts"), F.size(T.terms(sentence)).alias("all")), search)


def with_key_terms(scored: Column, most: int, asked: Column, subject: Column) -> Column:
    """The first ``most`` of scored sentences (o, i, s; in order). If none of them has a word that the question asks for beside its subject,
    the best of the others that has one takes the last place."""

    def chosen(x: Column) -> Column:
        has = lambda y: T.overlap(T.terms(y["s"]), x["keys"]) > 0
        first, rest = F.slice(x["scored"], 1, most), F.slice(x["scored"], most + 1, F.greatest(F.size(x["scored"]), F.lit(1)))
        other = F.slice(F.filter(rest, has), 1, 1)
        swap = (F.size(x["keys"]) > 0) & (F.size(other) > 0) & ~F.exists(first, has)
        return F.when(swap, F.concat(F.slice(first, 1, most - 1), other)).otherwise(first)

    return R.let(F.struct(scored.alias("scored"), F.array_except(asked, subject).alias("keys")), chosen)
