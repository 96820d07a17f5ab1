"""The jobs as queries: run twice on the whole tables into a new folder, whose output is returned; the stored index and the evaluation."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from jobs import evaluate_retrieval, ingest_index

from ..operators import evaluation, inverted, metrics
from ..session import folder, table
from .common import CONTENT, CORPUS_QUESTIONS, KEY, PLAIN, TOKENS, WORDS, frame, values

QUERIES, ORACLE = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return add


def new_folder(spark, name: str) -> str:
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


_WINDOWS = f"""w AS (SELECT doc_id, {WORDS.format("text")} AS w FROM documents WHERE doc_id IS NOT NULL),
s AS (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 51, 0) + 1, 450)) AS start_word FROM w WHERE len(w) > 0),
c AS (SELECT doc_id, start_word, array_to_string(w[start_word + 1:start_word + 500], ' ') AS text FROM s),
posted AS (SELECT doc_id, start_word, term, count(*) AS tf FROM (SELECT doc_id, start_word, unnest({TOKENS.format("text")}) AS term FROM c) GROUP BY ALL)"""


@query(f"WITH {_WINDOWS} SELECT doc_id, start_word, term, tf FROM posted")
def job1_ingest_index(spark, sf_dir):
    """The index of all documents after two runs of the stream, of which the second finds nothing new."""
    root = new_folder(spark, "job1")
    for _ in range(2):  # as a glob, since the table may be one file
        ingest_index.run(spark, f"{sf_dir}/documents.parque[t]", f"{root}/index", f"{root}/checkpoint")
    return ingest_index.postings(spark, f"{root}/index")


_ASKED = f"SELECT qid, term, count(*) AS qtf FROM (SELECT qid, unnest({CONTENT.format('question')}) AS term FROM {values(CORPUS_QUESTIONS, 'qid, question')}) GROUP BY ALL"


@query(
    f"""WITH {_WINDOWS}, q AS ({_ASKED}), df AS (SELECT term, count(*) AS df FROM posted WHERE term IN (SELECT term FROM q) GROUP BY term),
lex AS (SELECT qid, doc_id, start_word, round(sum(least(tf, 3) * qtf * (1 + ln(((SELECT count(*) FROM c) + 1) / (df + 1)))), 6) AS lexical FROM q JOIN posted USING (term) JOIN df USING (term) GROUP BY ALL)
SELECT qid, lexical, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY lexical DESC) AS rank FROM lex) WHERE rank <= 20 GROUP BY ALL"""
)
def stored_index_topk(spark, sf_dir):
    """Scores of each question's twenty best windows, from an index in two batches. Ties go by hashed ids, so scores are compared."""
    root = new_folder(spark, "index")
    d = table(spark, sf_dir, "documents").select("doc_id", "text").where("doc_id is not null")
    for k in (0, 1):
        inverted.write_batch(ingest_index.windows(d.where(F.pmod("doc_id", F.lit(2)) == k), 500, 50), root, k)
    found = inverted.Index(spark, root).search(frame(spark, CORPUS_QUESTIONS, "qid long, question string"))
    return found.groupBy("qid", "lexical").agg(F.count("*").alias("n"))


_KEYED = KEY.format("text")
_CASES = f"""b AS (SELECT item_id, string_split({_KEYED}, ' ') AS w FROM benchmark),
b2 AS (SELECT item_id, array_to_string(w[1:{evaluation.ASKED}], ' ') AS question, w[{evaluation.FROM + 1}:{evaluation.FROM + evaluation.RUN}] AS run FROM b WHERE len(w) >= {evaluation.FROM + evaluation.RUN}),
b3 AS (SELECT item_id, question, array_to_string(run, ' ') AS ahead, array_to_string(list_reverse(run), ' ') AS back FROM b2),
cases AS (SELECT item_id * 2 AS qid, item_id, 'passage' AS category, question, true AS supported, ahead AS expected, NULL::VARCHAR AS contradiction FROM b3 WHERE ahead <> back
  UNION ALL SELECT item_id * 2 + 1, item_id, 'reversed', question, false, back, ahead FROM b3 WHERE ahead <> back),
qt AS (SELECT qid, term, count(*) AS qtf FROM (SELECT qid, unnest({CONTENT.format("question")}) AS term FROM cases) GROUP BY ALL),
p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({TOKENS.format("text")}) AS term FROM documents) WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
lex AS (SELECT qid, doc_id, round(sum(least(tf, 3) * qtf * (1 + ln(((SELECT count(*) FROM documents) + 1) / (df + 1)))), 6) AS score FROM qt JOIN p USING (term) JOIN df USING (term) GROUP BY ALL),
kq AS (SELECT qid, term, count(*) AS qtf FROM (SELECT qid, unnest({PLAIN.format("question")}) AS term FROM cases) GROUP BY ALL),
kp AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({PLAIN.format("text")}) AS term FROM documents) WHERE term IN (SELECT term FROM kq) GROUP BY ALL),
kw AS (SELECT qid, doc_id, sum(tf * qtf)::DOUBLE AS score FROM kq JOIN kp USING (term) GROUP BY ALL),
hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY system, qid ORDER BY score DESC, doc_id) AS rank FROM (SELECT 'lexical' AS system, * FROM lex UNION ALL SELECT 'keyword', * FROM kw)) WHERE rank <= 5),
met AS (SELECT system, qid, min(rank) FILTER (contains(' ' || {_KEYED} || ' ', ' ' || expected || ' ')) AS support_rank, min(rank) FILTER (contains(' ' || {_KEYED} || ' ', ' ' || contradiction || ' ')) AS contradiction_rank
  FROM hits JOIN cases USING (qid) JOIN documents USING (doc_id) GROUP BY ALL),
results AS (SELECT cases.*, s.system, support_rank, contradiction_rank, CASE WHEN supported AND support_rank IS NULL THEN 'false_rejection' WHEN NOT supported AND support_rank IS NOT NULL THEN 'false_support' END AS reason,
  CASE WHEN supported THEN coalesce(support_rank <= 5, false) ELSE support_rank IS NULL OR coalesce(contradiction_rank <= 5, false) END AS good
  FROM cases CROSS JOIN (VALUES ('keyword'), ('lexical')) AS s(system) LEFT JOIN met USING (system, qid)),
summary AS (SELECT system, category, count(*) AS cases, {", ".join(f"round(coalesce(avg(coalesce(support_rank <= {k}, false)::INT) FILTER (supported), 0), 4) AS recall_at_{k}" for k in (1, 3, 5))},
  round(avg(good::INT), 4) AS accuracy_at_5, round(coalesce(avg(good::INT) FILTER (NOT supported), 0), 4) AS rejection_at_5, round(avg(1 / support_rank) FILTER (supported), 4) AS mrr_found,
  round(avg(coalesce(1 / support_rank, 0)) FILTER (supported), 4) AS mrr_all, round(coalesce(avg((support_rank IS NOT NULL)::INT) FILTER (NOT supported), 0), 4) AS false_support,
  round(coalesce(avg((support_rank IS NULL)::INT) FILTER (supported), 0), 4) AS false_rejection, count(*) FILTER (NOT good) AS failed
  FROM (SELECT * REPLACE (unnest([category, '(all)']) AS category) FROM results) GROUP BY ALL)"""


@query(f"WITH {_CASES} SELECT r.* EXCLUDE (good), s.* EXCLUDE (system, category) FROM results r JOIN summary s USING (system, category)")
def job2_evaluate_retrieval(spark, sf_dir):
    """Every case of both systems, with the figures of its category, after two runs into the same folder."""
    root = new_folder(spark, "job2")
    for _ in range(2):
        evaluate_retrieval.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/benchmark.parquet", root)
    return evaluate_retrieval.report(spark, root)


def results(spark, sf_dir):
    chunks = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    return evaluation.evaluate(chunks, table(spark, sf_dir, "benchmark"))


@query(f"WITH {_CASES} SELECT * FROM summary")
def retrieval_systems(spark, sf_dir):
    """Both systems' metrics by category and overall."""
    return evaluation.by_system(results(spark, sf_dir))


@query(f"""WITH {_CASES}, x AS (SELECT category, qid, bool_and(good) FILTER (system = 'keyword') AS b, bool_and(good) FILTER (system = 'lexical') AS n FROM results GROUP BY ALL)
SELECT category, count(*) AS cases, count(*) FILTER (b AND n) AS "both", count(*) FILTER (b AND NOT n) AS only_base, count(*) FILTER (NOT b AND n) AS only_new, count(*) FILTER (NOT b AND NOT n) AS neither FROM x GROUP BY category""")
def paired_systems(spark, sf_dir):
    """Cases that both, one or neither system got right."""
    return evaluation.paired(results(spark, sf_dir), "keyword", "lexical")


@query(f"WITH {_CASES} SELECT category, count(*) FILTER (system = 'keyword' AND good) AS keyword, count(*) FILTER (system = 'lexical' AND good) AS lexical FROM results GROUP BY category")
def system_comparison(spark, sf_dir):
    """Right cases by category, a column for each system."""
    return results(spark, sf_dir).groupBy("category").pivot("system", ["keyword", "lexical"]).agg(F.count_if(metrics.right()))


@query(f"WITH {_CASES} SELECT system, reason, string_agg(qid::VARCHAR, ',' ORDER BY qid) AS ids FROM results WHERE reason IS NOT NULL GROUP BY ALL")
def failure_groups(spark, sf_dir):
    """A failure's list of cases is the report itself; there are two cases for each benchmark passage."""
    r = results(spark, sf_dir).where("reason is not null").groupBy("system", "reason").agg(F.sort_array(F.collect_list("qid")).alias("ids"))
    return r.select("system", "reason", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))
