"""Queries of evaluation metrics, and joins of sides, fallbacks and entities."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as M
from ..session import small, spread, table
from .common import literal, of_documents, of_documents_sql

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


CASES = [
    (1, True, ["alpha beta", "gamma delta", "alpha"], ["gamma"], "any_term", None), (2, True, ["one", "two", "three", "four", "needle"], ["needle"], "any_term", None), (3, True, ["one"], ["absent"], "any_term", None),
    (4, True, ["red fox", "blue hen"], ["red", "hen"], "all_terms_anywhere", None), (5, True, ["red fox"], ["red", "hen"], "all_terms_anywhere", None), (6, False, ["x", "y"], ["zeta"], "any_term", None),
    (7, False, ["x", "zeta"], ["zeta"], "any_term", 2), (8, False, ["zeta"], ["zeta"], "any_term", None), (9, True, [], ["zeta"], "any_term", None), (10, True, ["Zeta!"], ["zeta"], "any_term", None),
]
CS = of_documents_sql(CASES, "id, supported, hits, terms, mode, contradiction_rank")
_RANK = """list_min(list_filter(list_transform(range(1, len(hits) + 1), lambda i: CASE WHEN len(list_filter(terms, lambda t: contains(lower(hits[i]), lower(t)))) > 0 THEN i END), lambda p: p IS NOT NULL))"""
_CASES = f"""c AS (SELECT id, supported, contradiction_rank, CASE WHEN mode = 'any_term' OR len(list_filter(terms, lambda t: NOT contains(lower(array_to_string(hits, ' ')), lower(t)))) = 0 THEN {_RANK} END AS support_rank FROM {CS})"""


def _cases(spark, sf_dir):
    c = of_documents(spark, sf_dir, CASES, "id long, supported boolean, hits array<string>, terms array<string>, mode string, contradiction_rank int")
    hits, terms = F.col("hits"), F.col("terms")
    rank = F.when((F.col("mode") == "any_term") | M.all_terms_anywhere(hits, terms), M.any_term_rank(hits, terms))
    return c.select("id", "supported", "contradiction_rank", rank.alias("support_rank"))


@query(f"WITH {_CASES} SELECT id, support_rank FROM c")
def case_support(spark, sf_dir):
    return _cases(spark, sf_dir).select("id", "support_rank")


@query(
    f"""WITH {_CASES}, r AS (SELECT *, CASE WHEN supported THEN support_rank IS NOT NULL AND support_rank <= 5 ELSE support_rank IS NULL OR coalesce(contradiction_rank <= 5, false) END AS good FROM c)
SELECT count(*) AS cases, {", ".join(f"round(coalesce(avg(CASE WHEN coalesce(support_rank <= {k}, false) THEN 1.0 ELSE 0.0 END) FILTER (supported), 0.0), 4) AS recall_at_{k}" for k in (1, 3, 5))},
round(avg(good::INT), 4) AS accuracy_at_5, round(avg(good::INT) FILTER (NOT supported), 4) AS rejection_at_5, round(avg(1 / support_rank) FILTER (supported), 4) AS mrr_found, round(avg(coalesce(1 / support_rank, 0)) FILTER (supported), 4) AS mrr_all FROM r"""
)
def recall_mrr(spark, sf_dir):
    return M.retrieval_summary(_cases(spark, sf_dir))


@query(
    """WITH n AS (SELECT item_id, text, length(text) AS n FROM benchmark), d AS (SELECT doc_id, text FROM documents)
SELECT item_id, count(*) AS n_docs, min(doc_id) AS first_doc FROM n JOIN d ON contains(d.text, n.text) GROUP BY item_id"""
)
def benchmark_passages(spark, sf_dir):
    """Documents that hold a benchmark passage. Of a passage of eight words or more the second run of six is its key, which a
    document that holds the passage has as whole words too; a shorter one goes by its longest inner word, and without inner words it is
    looked for in every document. Documents' keys join with the few of the passages, and the passage is looked for in what meets."""
    from ..functions import rules as R

    split = lambda t: F.filter(F.split(t, r"[^\p{L}\p{N}]+"), lambda x: x != "")
    run = lambda w, i: F.xxhash64(*(F.get(w, i + k) for k in range(6)))

    def passage_key(w):
        inner = F.slice(w, 2, F.greatest(F.size(w) - 2, F.lit(0)))
        longest = F.get(F.sort_array(F.transform(inner, lambda x: F.struct((-F.length(x)).alias("n"), x.alias("x")))), F.lit(0))["x"]
        return F.when(F.size(w) >= 8, run(w, F.lit(1))).otherwise(F.xxhash64(longest, F.lit("word"))), F.size(inner) > 0

    def keys_of(w):
        runs = F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - 6, F.lit(0))), lambda i: run(w, i))
        return F.array_distinct(F.concat(runs, F.transform(F.array_distinct(w), lambda x: F.xxhash64(x, F.lit("word")))))

    b = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("passage"), split(F.col("text")).alias("w"))
    key, has_key = passage_key(F.col("w"))
    b = b.select("item_id", "passage", F.when((F.size("w") >= 8) | has_key, key).alias("key"), (F.size("w") >= 8).alias("long"))
    d = spread(table(spark, sf_dir, "documents")).select("doc_id", "text")
    short = b.where("key is not null and not long").limit(1).count() > 0  # words are keys only where a passage needs them
    keyed = d.select("doc_id", "text", F.explode(R.let(split(F.col("text")), keys_of if short else lambda w: F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - 6, F.lit(0))), lambda i: run(w, i))))).alias("key"))
    hits = keyed.join(small(b.where("key is not null").select("item_id", "passage", "key")), "key").where(F.contains("text", "passage")).select("item_id", "doc_id")
    bare = b.where("key is null").select("item_id", "passage")
    if bare.limit(1).count():
        hits = hits.unionByName(d.join(small(bare), F.contains("text", "passage")).select("item_id", "doc_id"))
    return hits.groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_docs"), F.min("doc_id").alias("first_doc"))


RESULTS = [
    (1, "fact", True, True, True, 0.8, None), (2, "fact", True, False, False, 1.2, None), (3, "fact", False, False, True, 0.4, None), (4, "cause", True, True, False, 2.6, None), (5, "cause", False, True, True, 0.9, None),
    (6, "cause", True, False, False, 3.0, "timeout"), (7, "process", False, False, True, 0.2, None), (8, "process", True, True, True, 1.1, None),
]
RS = of_documents_sql(RESULTS, "id, category, expected, actual, content, latency, error")
_V = "CASE WHEN error IS NOT NULL THEN 'api_error' WHEN expected AND NOT actual THEN 'false_rejection' WHEN expected AND NOT content THEN 'wrong_content' WHEN NOT expected AND actual THEN 'false_support' END"


def results(spark, sf_dir):
    r = of_documents(spark, sf_dir, RESULTS, "id long, category string, expected boolean, actual boolean, content boolean, latency double, error string")
    return r.withColumn("reason", M.verdict(F.col("error"), F.col("expected"), F.col("actual"), F.col("content")))


@query(f"SELECT id, {_V} AS reason FROM {RS}")
def case_verdict(spark, sf_dir):
    return results(spark, sf_dir).select("id", "reason")


@query(f"WITH r AS (SELECT *, {_V} AS reason FROM {RS}) SELECT coalesce(category, '(all)') AS category, count(*) AS cases, count(*) FILTER (reason IS NULL) AS passed FROM r GROUP BY ROLLUP (category)")
def category_rollup(spark, sf_dir):
    r = results(spark, sf_dir).rollup("category").agg(F.count("*").alias("cases"), F.count_if(F.col("reason").isNull()).alias("passed"))
    return r.select(F.coalesce("category", F.lit("(all)")).alias("category"), "cases", "passed")


@query(
    f"""WITH r AS (SELECT *, {_V} AS reason FROM {RS})
SELECT round(avg((reason IS NULL)::INT) FILTER (expected), 4) AS supported_correct, round(avg((NOT actual)::INT) FILTER (NOT expected), 4) AS rejection, round(avg((actual)::INT) FILTER (NOT expected), 4) AS false_support,
round(avg((NOT actual)::INT) FILTER (expected), 4) AS false_rejection, round(avg(latency), 4) AS latency_mean, round(quantile_cont(latency, 0.5), 4) AS latency_p50, count(*) FILTER (latency > 2.5) AS slow FROM r"""
)
def reliability(spark, sf_dir):
    r, e, a = results(spark, sf_dir), F.col("expected"), F.col("actual")
    return r.agg(
        M.rate(F.col("reason").isNull(), e).alias("supported_correct"), M.rate(~a, ~e).alias("rejection"), M.rate(a, ~e).alias("false_support"), M.rate(~a, e).alias("false_rejection"),
        F.round(F.avg("latency"), 4).alias("latency_mean"), F.round(F.percentile("latency", 0.5), 4).alias("latency_p50"), F.count_if(F.col("latency") > 2.5).alias("slow"),
    )


@query("SELECT coalesce(lang, '(all)') AS lang, count(*) AS n, sum(quality)::BIGINT AS good, sum(toxic)::BIGINT AS toxic, round(avg(n_chars), 2) AS mean_chars FROM labels JOIN documents USING (doc_id) GROUP BY ROLLUP (lang)")
def quality_rollup(spark, sf_dir):
    j = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    r = j.rollup("lang").agg(F.count("*").alias("n"), F.sum("quality").cast("long").alias("good"), F.sum("toxic").cast("long").alias("toxic"), F.round(F.avg("n_chars"), 2).alias("mean_chars"))
    return r.withColumn("lang", F.coalesce("lang", F.lit("(all)")))


@query(
    """WITH e AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL),
p AS (SELECT event_type, any_value(n) AS n, max(value) AS most, max(CASE WHEN i = round_even(0.95 * (n - 1), 0) THEN value END) AS nearest, max(CASE WHEN i = least(n - 1, floor(0.95 * n)) THEN value END) AS fl,
max(CASE WHEN i = floor(0.95 * (n + 1) - 1) THEN value END) AS e0, max(CASE WHEN i = least(n - 1, floor(0.95 * (n + 1) - 1) + 1) THEN value END) AS e1 FROM e GROUP BY event_type)
SELECT event_type, n, round(nearest, 6) AS p95_nearest, round(fl, 6) AS p95_floor, round((SELECT quantile_cont(value, 0.95) FROM e WHERE e.event_type = p.event_type), 6) AS p95_linear,
round(CASE WHEN n < 20 THEN most ELSE e0 + (e1 - e0) * ((0.95 * (n + 1) - 1) - floor(0.95 * (n + 1) - 1)) END, 6) AS p95_exclusive FROM p"""
)
def latency_percentiles(spark, sf_dir):
    return M.p95(table(spark, sf_dir, "events"), "event_type", "value")


@query("SELECT event_type, count(*) AS runs, round(avg(value), 4) AS mean, round(min(value), 4) AS least, round(max(value), 4) AS most FROM events GROUP BY event_type")
def profile_runs(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("runs"), F.round(F.avg("value"), 4).alias("mean"), F.round(F.min("value"), 4).alias("least"), F.round(F.max("value"), 4).alias("most"))


CHECKS = [
    (1, "Salt and iron were traded in 1902.", ["salt", "1902"], ["iron", "wool"], ["gold"], [["salt", "rope"], ["1902"]]), (2, "Salt only.", ["salt"], ["iron"], ["gold"], [["iron"], ["salt"]]),
    (3, "Gold and salt.", ["salt"], ["salt"], ["gold"], [["gold"]]), (4, "Wool.", ["wool"], ["wool"], ["salt"], [["rope", "wool"]]),
]


@query(
    f"""SELECT id, len(list_filter(a, lambda t: NOT contains(lower(s), lower(t)))) = 0 AND len(list_filter(b, lambda t: contains(lower(s), lower(t)))) > 0 AND len(list_filter(c, lambda t: contains(lower(s), lower(t)))) = 0 AS content,
len(list_filter(g, lambda x: len(list_filter(x, lambda t: contains(lower(s), lower(t)))) = 0)) = 0 AS held_out FROM {of_documents_sql(CHECKS, "id, s, a, b, c, g")}"""
)
def content_check(spark, sf_dir):
    c = of_documents(spark, sf_dir, CHECKS, "id long, s string, a array<string>, b array<string>, c array<string>, g array<array<string>>")
    return c.select("id", M.content_check(F.col("s"), F.col("a"), F.col("b"), F.col("c")).alias("content"), M.groups_satisfied(F.col("s"), F.col("g")).alias("held_out"))


@query(f"SELECT round(coalesce(avg((NOT actual)::INT) FILTER (category IN ('fact', 'cause') AND NOT expected), 0), 4) AS false_premise_rejection, round(coalesce(avg(actual::INT) FILTER (expected), 0), 4) AS acceptance, round(coalesce(avg(actual::INT) FILTER (category = 'none'), 0), 4) AS of_none FROM {RS}")
def premise_rates(spark, sf_dir):
    a, e, c = F.col("actual"), F.col("expected"), F.col("category")
    return results(spark, sf_dir).agg(M.rate(~a, c.isin("fact", "cause") & ~e).alias("false_premise_rejection"), M.rate(a, e).alias("acceptance"), M.rate(a, c == "none").alias("of_none"))


@query("SELECT l.doc_id, l.source AS left_source, r.source AS right_source FROM (SELECT doc_id // 2 AS k, * FROM documents WHERE doc_id % 2 = 0) l JOIN (SELECT doc_id // 2 AS k, * FROM documents WHERE doc_id % 2 = 1) r USING (k)")
def two_sided_join(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("k", F.floor(F.col("doc_id") / 2))
    left = d.where("doc_id % 2 = 0").select("k", "doc_id", F.col("source").alias("left_source"))
    right = d.where("doc_id % 2 = 1").select("k", F.col("source").alias("right_source"))
    return left.join(right, "k").drop("k")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def fallback_anti_join(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query(f"SELECT doc_id FROM documents WHERE len(list_filter({literal(['thing', 'que para'])}, lambda t: contains(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), t))) > 0")
def entity_semi_join(spark, sf_dir):
    from ..functions import text as T

    key = T.dedup_key(F.col("text"))
    return spread(table(spark, sf_dir, "documents")).where(F.contains(key, F.lit("thing")) | F.contains(key, F.lit("que para"))).select("doc_id")


@query("SELECT 'documents' AS name, count(*) AS n FROM documents UNION ALL SELECT 'conversations', count(*) FROM conversations UNION ALL SELECT 'embeddings', count(*) FROM embeddings UNION ALL SELECT 'labels', count(*) FROM labels")
def table_stats(spark, sf_dir):
    parts = [table(spark, sf_dir, n).agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n") for n in ("documents", "conversations", "embeddings", "labels")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("SELECT event_id AS id, CASE WHEN v IN (-1, 0, 1) THEN v ELSE 0 END AS vote FROM (SELECT event_id, CASE WHEN event_id % 11 > 0 THEN event_id % 7 - 3 END AS v FROM events)")
def feedback_votes(spark, sf_dir):
    from ..sources.exports import vote

    v = F.when(F.col("event_id") % 11 > 0, (F.col("event_id") % 7 - 3).cast("int"))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), vote(v).alias("vote"))
