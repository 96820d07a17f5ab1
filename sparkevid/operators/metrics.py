"""Evaluation: case support, recall and rejection rates, reliability, four definitions of the 95th percentile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Rows of a group up to which all of its values are placed.
WHOLE = 10_000


def any_term_rank(hits: Column, terms: Column) -> Column:
    """Place (from 1) of the first text that contains any of the terms, or null."""
    places = F.transform(hits, lambda t, i: F.when(F.exists(terms, lambda e: F.contains(F.lower(t), F.lower(e))), i + 1))
    return F.array_min(F.filter(places, lambda p: p.isNotNull()))


def all_terms_anywhere(hits: Column, terms: Column) -> Column:
    joined = F.lower(F.array_join(hits, " "))
    return F.forall(terms, lambda e: F.contains(joined, F.lower(e)))


def rate(condition: Column, within: Column | None = None) -> Column:
    """Share of rows that meet a condition, of those within; 0 for none."""
    value = F.when(condition, 1.0).otherwise(0.0)
    return F.round(F.coalesce(F.avg(value if within is None else F.when(within, value)), F.lit(0.0)), 4)


def right() -> Column:
    """Whether a case is right at 5: support among the first five; of an unsupported case nothing, or a contradiction among the first five."""
    rank = F.col("support_rank")
    return F.when(F.col("supported"), rank.isNotNull() & (rank <= 5)).otherwise(rank.isNull() | F.coalesce(F.col("contradiction_rank") <= 5, F.lit(False)))


def retrieval_aggregates() -> list[Column]:
    """Recall at 1, 3 and 5, accuracy, rejection, and two reciprocal ranks: over found cases only, and with misses as 0.

    Of rows with supported, support_rank, contradiction_rank."""
    supported, rank = F.col("supported"), F.col("support_rank")
    found = [rate(F.coalesce(rank <= k, F.lit(False)), supported).alias(f"recall_at_{k}") for k in (1, 3, 5)]
    return [
        F.count("*").alias("cases"), *found, rate(right()).alias("accuracy_at_5"), rate(right(), ~supported).alias("rejection_at_5"),
        F.round(F.avg(F.when(supported, 1 / rank)), 4).alias("mrr_found"), F.round(F.avg(F.when(supported, F.coalesce(1 / rank, F.lit(0.0)))), 4).alias("mrr_all"),
    ]


def retrieval_summary(cases: DataFrame) -> DataFrame:
    """``retrieval_aggregates`` of all cases."""
    return cases.agg(*retrieval_aggregates())


def verdict(error: Column, expected: Column, actual: Column, content: Column) -> Column:
    """Why a case failed, or null: api_error, false_rejection, wrong_content, false_support."""
    return F.when(error.isNotNull(), "api_error").when(expected & ~actual, "false_rejection").when(expected & ~content, "wrong_content").when(~expected & actual, "false_support")


def content_check(answer: Column, must_all: Column, must_any: Column, must_not: Column) -> Column:
    has = lambda t: F.contains(F.lower(answer), F.lower(t))
    return F.forall(must_all, has) & ((F.size(must_any) == 0) | F.exists(must_any, has)) & ~F.exists(must_not, has)


def groups_satisfied(answer: Column, groups: Column) -> Column:
    """Each group by any of its alternatives."""
    return F.forall(groups, lambda g: F.exists(g, lambda t: F.contains(F.lower(answer), F.lower(t))))


def p95(values: DataFrame, by: str, value: str) -> DataFrame:
    """Four percentiles of each group: nearest rank (banker's rounding), floor index, linear, and the exclusive quantile of twentieths.

    All four read places near 0.95 of the sorted group. In a group above WHOLE rows, two approximate percentiles, whose rank error is bounded
    by 1 / 100,000 of the rows, enclose these places; what lies below is only counted, what lies above is dropped, and the
    thousandths between are counted by value, before any shuffle. A running sum then gives exact places."""
    from pyspark.sql import Window

    v = values.where(F.col(value).isNotNull())
    whole = F.col("n") <= WHOLE
    around = v.groupBy(by).agg(F.count("*").alias("n"), F.percentile_approx(value, 0.949, 100_000).alias("lo"), F.percentile_approx(value, 0.951, 100_000).alias("hi"))
    near = v.join(around, by).where(whole | (F.col(value) <= F.col("hi"))).select(by, "n", F.when(whole | (F.col(value) >= F.col("lo")), F.col(value)).alias(value))
    counted = near.groupBy(by, "n", value).agg(F.count("*").alias("c"))
    run = Window.partitionBy(by).orderBy(F.col(value).asc_nulls_first())
    upto = F.sum("c").over(run.rowsBetween(Window.unboundedPreceding, 0))
    rows = counted.select(by, value, upto.alias("upto"), (upto - F.col("c")).alias("before"), "n")

    def at(place: Column) -> Column:
        """The value at a place counted from 0."""
        return F.max(F.when((F.col("before") <= place) & (place < F.col("upto")), F.col(value)))

    last = F.col("n") - 1
    exact = 0.95 * last
    out = 0.95 * (F.col("n") + 1) - 1  # from 0
    places = rows.groupBy(by).agg(
        F.max("n").alias("n"), at(F.bround(exact, 0)).alias("nearest"), at(F.least(last, F.floor(F.lit(0.95) * F.col("n")))).alias("floor"),
        at(F.floor(exact)).alias("l0"), at(F.least(last, F.floor(exact) + 1)).alias("l1"),
        at(F.least(last, F.floor(out))).alias("e0"), at(F.least(last, F.floor(out) + 1)).alias("e1"), F.max(value).alias("most"),
    )
    last, exact, out = F.col("n") - 1, 0.95 * (F.col("n") - 1), 0.95 * (F.col("n") + 1) - 1
    between = lambda a, b, x: F.col(a) + (F.col(b) - F.col(a)) * (x - F.floor(x))
    return places.select(
        by, "n", F.round("nearest", 6).alias("p95_nearest"), F.round("floor", 6).alias("p95_floor"), F.round(between("l0", "l1", exact), 6).alias("p95_linear"),
        F.round(F.when(F.col("n") < 20, F.col("most")).otherwise(between("e0", "e1", out)), 6).alias("p95_exclusive"),
    )
