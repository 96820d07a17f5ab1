"""Queries over the text corpus: preparation, index, ranking, dedup."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import containment, index, ranking, selection, similarity
from ..session import small, spread, stored, table, top
from .common import CLEAN, CONTENT, CORPUS_QUESTIONS, KEY, PLAIN, SENTENCES, SIGNATURE, TERMS, TOKENS, WORDS, frame, values

QUERIES, ORACLE = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return add


def documents(spark, sf_dir) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def chunks(spark, sf_dir) -> DataFrame:
    return documents(spark, sf_dir).select(F.col("doc_id").alias("chunk_id"), "text")


def questions(spark) -> DataFrame:
    return frame(spark, CORPUS_QUESTIONS, "qid long, question string")


Q_SQL = values(CORPUS_QUESTIONS, "qid, question")


@query(f"""SELECT lang, count(*) AS n_lines, sum(length(l))::BIGINT AS n_chars FROM
(SELECT lang, {CLEAN.format("l")} AS l FROM (SELECT lang, unnest(string_split(text, chr(10))) AS l FROM documents)) WHERE length(l) >= 80 GROUP BY lang""")
def corpus_scan(spark, sf_dir):
    lines = documents(spark, sf_dir).select("lang", F.explode(F.split("text", "\n")).alias("l")).select("lang", T.clean_markup(F.col("l")).alias("l"))
    return lines.where(F.length("l") >= 80).groupBy("lang").agg(F.count("*").alias("n_lines"), F.sum(F.length("l")).alias("n_chars"))


@query(f"SELECT lang, count(*) AS n_docs, sum(len({TOKENS.format('text')}))::BIGINT AS n_tokens, sum(len(list_distinct({TOKENS.format('text')})))::BIGINT AS n_distinct FROM documents GROUP BY lang")
def token_stats_by_lang(spark, sf_dir):
    t = documents(spark, sf_dir).select("lang", T.tokens(F.col("text")).alias("t"))
    return t.groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum(F.size("t")).alias("n_tokens"), F.sum(F.size(F.array_distinct("t"))).alias("n_distinct"))


@query(f"SELECT doc_id, len({PLAIN.format('text')}) AS n_plain, len(regexp_extract_all(text, '[a-zA-Z][a-zA-Z0-9''-]*')) AS n_training, len({CONTENT.format('text')}) AS n_content, len({TERMS.format('text')}) AS n_terms, len({SIGNATURE.format('text')}) AS n_signature FROM documents")
def token_variants(spark, sf_dir):
    c = F.col("text")
    kinds = {"n_plain": T.plain_tokens(c), "n_training": T.training_tokens(c), "n_content": T.content_words(c), "n_terms": T.terms(c), "n_signature": T.signature(c)}
    return documents(spark, sf_dir).select("doc_id", *(F.size(v).cast("long").alias(k) for k, v in kinds.items()))


@query(f"SELECT lang, sum(len({SENTENCES.format('text')}))::BIGINT AS n_sentences, sum(list_sum(list_transform({SENTENCES.format('text')}, lambda x: length(x))))::BIGINT AS n_chars FROM documents GROUP BY lang")
def sentence_stats(spark, sf_dir):
    s = documents(spark, sf_dir).select("lang", T.sentences(F.col("text")).alias("s"))
    return s.groupBy("lang").agg(F.sum(F.size("s")).alias("n_sentences"), F.sum(F.length(F.array_join("s", ""))).alias("n_chars"))


@query(f"""WITH s AS (SELECT doc_id, {SENTENCES.format("text")} AS s FROM documents),
p AS (SELECT doc_id, list_reduce(s, lambda a, x: CASE WHEN a.len > 0 AND a.len + length(x.cur) > 900
  THEN {{'done': list_append(a.done, a.cur), 'cur': x.cur, 'len': length(x.cur) + 1}}
  ELSE {{'done': a.done, 'cur': CASE WHEN a.len = 0 THEN x.cur ELSE a.cur || ' ' || x.cur END, 'len': a.len + length(x.cur) + 1}} END,
  {{'done': []::VARCHAR[], 'cur': '', 'len': 0::BIGINT}}) AS a
  FROM (SELECT doc_id, list_transform(s, lambda x: {{'done': []::VARCHAR[], 'cur': x, 'len': 0::BIGINT}}) AS s FROM s)),
c AS (SELECT doc_id, unnest(list_filter(CASE WHEN a.len > 0 THEN list_append(a.done, a.cur) ELSE a.done END, lambda x: length(x) >= 80)) AS c FROM p)
SELECT doc_id, count(*) AS n_chunks, sum(length(c))::BIGINT AS n_chars, max(length(c)) AS longest, md5(string_agg(c, '|' ORDER BY c)) AS digest FROM c GROUP BY doc_id""")
def chunk_pack_900(spark, sf_dir):
    c = documents(spark, sf_dir).select("doc_id", T.pack_sentences(T.sentences(F.col("text"))).alias("c")).where(F.size("c") > 0)
    size = F.aggregate("c", F.lit(0).cast("long"), lambda a, x: a + F.length(x))
    return c.select("doc_id", F.size("c").cast("long").alias("n_chunks"), size.alias("n_chars"), F.array_max(F.transform("c", F.length)).cast("long").alias("longest"), F.md5(F.array_join(F.array_sort("c"), "|")).alias("digest"))


def _windows(size: int, overlap: int):
    step = size - overlap
    sql = f"""WITH w AS (SELECT doc_id, {WORDS.format("text")} AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(0, greatest(len(w) - {overlap + 1}, 0) + 1, {step})) AS s FROM w WHERE len(w) > 0)
SELECT doc_id, s AS start_word, s + len(w[s + 1:s + {size}]) AS end_word, md5(array_to_string(w[s + 1:s + {size}], ' ')) AS digest FROM s"""

    def run(spark, sf_dir):
        w = documents(spark, sf_dir).select("doc_id", T.space_words(F.col("text")).alias("w"))
        w = w.select("doc_id", F.explode(T.word_windows(F.col("w"), size, overlap)).alias("x"))
        return w.select("doc_id", F.col("x.start_word").cast("long").alias("start_word"), F.col("x.end_word").cast("long").alias("end_word"), F.md5("x.text").alias("digest"))

    run.__name__ = f"chunk_windows_{size}_{overlap}"
    query(sql)(run)


_windows(120, 25)
_windows(500, 50)


@query(f"SELECT doc_id, md5({KEY.format('text')}) AS dedup_form, md5(trim(regexp_replace(lower(text), '[^a-z0-9'']+', ' ', 'g'))) AS quote_form FROM documents")
def normal_forms(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.md5(T.dedup_key(F.col("text"))).alias("dedup_form"), F.md5(T.quote_key(F.col("text"))).alias("quote_form"))


def _display_sql(c: str) -> str:
    for pattern, replacement in T.DISPLAY:
        c = f"regexp_replace({c}, '{pattern.replace(chr(39), chr(39) * 2)}', '{replacement.replace('$', chr(92)).replace(chr(39), chr(39) * 2)}', 'g')"
    return f"trim({c})"


@query(f"SELECT doc_id, md5({_display_sql('text')}) AS digest FROM documents")
def display_text(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.md5(T.display(F.col("text"))).alias("digest"))


@query(f"""WITH t AS (SELECT doc_id, unnest({CONTENT.format("text")}) AS term, generate_subscripts({CONTENT.format("text")}, 1) AS pos FROM documents),
c AS (SELECT doc_id, term, count(*) AS n, min(pos) AS first FROM t GROUP BY ALL)
SELECT doc_id, rank, term, n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS rank FROM c) WHERE rank <= 8""")
def doc_keyphrases(spark, sf_dir):
    return index.keyphrases(documents(spark, sf_dir), "doc_id")


@query(f"SELECT term, count(*) AS df, sum(tf)::BIGINT AS n FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({TOKENS.format('text')}) AS term FROM documents) GROUP BY ALL) GROUP BY term ORDER BY df DESC, term LIMIT 100")
def term_df_top(spark, sf_dir):
    posted = index.postings(chunks(spark, sf_dir))
    return posted.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("n")).orderBy(F.desc("df"), "term").limit(100)


@query(f"SELECT doc_id AS chunk_id, count(*) AS n_terms, max(tf) AS max_tf FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({TOKENS.format('text')}) AS term FROM documents) GROUP BY ALL) GROUP BY ALL")
def term_index(spark, sf_dir):
    return index.postings(chunks(spark, sf_dir)).groupBy("chunk_id").agg(F.count("*").alias("n_terms"), F.max("tf").alias("max_tf"))


@query(f"SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({TOKENS.format('text')}) AS term FROM documents) GROUP BY term")
def ingest_incremental(spark, sf_dir):
    """Statistics of two batches, added; the oracle builds them over all documents at once."""
    c = chunks(spark, sf_dir)
    batches = [index.term_stats(index.postings(c.where(F.pmod("chunk_id", F.lit(2)) == k))) for k in (0, 1)]
    return index.merged_stats(*batches)


def _lex_sql(asked: str) -> str:
    return f"""q AS (SELECT qid, term, count(*) AS qtf FROM (SELECT qid, unnest({CONTENT.format("question")}) AS term FROM {asked}) GROUP BY ALL),
p AS (SELECT chunk_id, term, count(*) AS tf FROM (SELECT doc_id AS chunk_id, unnest({TOKENS.format("text")}) AS term FROM documents) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
d AS (SELECT term, count(*) AS df FROM p GROUP BY term),
lex AS (SELECT qid, chunk_id, round(sum(least(tf, 3) * qtf * (1 + ln(((SELECT count(*) FROM documents) + 1) / (df + 1)))), 6) AS lexical FROM q JOIN p USING (term) JOIN d USING (term) GROUP BY ALL)"""


_LEX = _lex_sql(Q_SQL)


@query(f"WITH {_LEX} SELECT qid, chunk_id, lexical, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY lexical DESC, chunk_id) AS rank FROM lex) WHERE rank <= 20")
def lexical_topk(spark, sf_dir):
    scored = ranking.lexical_scores(chunks(spark, sf_dir), questions(spark)).withColumn("score", F.col("lexical"))
    return ranking.candidates(scored).select("qid", "chunk_id", "lexical", "rank")


_KW = f"""kq AS (SELECT qid, term, count(*) AS qtf FROM (SELECT qid, unnest({PLAIN.format("question")}) AS term FROM {Q_SQL}) GROUP BY ALL),
kp AS (SELECT chunk_id, term, count(*) AS tf FROM (SELECT doc_id AS chunk_id, unnest({PLAIN.format("text")}) AS term FROM documents) WHERE term IN (SELECT term FROM kq) GROUP BY ALL),
kw AS (SELECT qid, chunk_id, sum(tf * qtf)::BIGINT AS keyword FROM kq JOIN kp USING (term) GROUP BY ALL)"""


@query(f"WITH {_KW} SELECT qid, chunk_id, keyword, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY keyword DESC, chunk_id) AS rank FROM kw) WHERE rank <= 5")
def keyword_topk(spark, sf_dir):
    return top(ranking.keyword_scores(chunks(spark, sf_dir), questions(spark)), 5, ["qid"], F.desc("keyword"), F.asc("chunk_id"))


_COS = """v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
cos AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(q.e, v.e), 6) AS cosine FROM v JOIN (SELECT * FROM v WHERE vec_id % 100 = 0) q ON q.vec_id <> v.vec_id)"""


@query(f"WITH {_COS} SELECT query_id, vec_id, cosine, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS rank FROM cos) WHERE rank <= 10")
def cosine_topk(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    return similarity.nearest(v, v.where("vec_id % 100 = 0"), 10)


@query(f"""WITH {_KW}, {_COS}, j AS (SELECT qid, chunk_id, keyword, cosine FROM kw JOIN (SELECT query_id / 100 + 1 AS qid, vec_id AS chunk_id, cosine FROM cos) USING (qid, chunk_id)),
k AS (SELECT qid, chunk_id, (keyword - min(keyword) OVER w) / nullif(max(keyword) OVER w - min(keyword) OVER w, 0) AS k FROM kw WINDOW w AS (PARTITION BY qid)),
c AS (SELECT query_id // 100 + 1 AS qid, vec_id AS chunk_id, (cosine - min(cosine) OVER w) / nullif(max(cosine) OVER w - min(cosine) OVER w, 0) AS v FROM cos WINDOW w AS (PARTITION BY query_id)),
s AS (SELECT qid, chunk_id, round(0.7 * coalesce(k, 0) + 0.3 * coalesce(v, 0), 6) AS score FROM k JOIN c USING (qid, chunk_id))
SELECT qid, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM s) WHERE rank <= 5""")
def hybrid_topk(spark, sf_dir):
    """Question i goes with vector 100 (i - 1); vectors and documents share ids by construction only."""
    v = table(spark, sf_dir, "embeddings")
    keyword = ranking.keyword_scores(chunks(spark, sf_dir), questions(spark)).withColumn("qid", (F.col("qid") - 1) * 100)
    scored = ranking.hybrid(keyword, v, v.where("vec_id % 100 = 0"))
    return top(scored.withColumn("qid", (F.col("qid") / 100 + 1).cast("long")), 5, ["qid"], F.desc("score"), F.asc("chunk_id"))


@query(f"""SELECT any_value(lang) AS lang, min(doc_id) AS doc_id, md5({KEY.format("text")}) AS key FROM documents GROUP BY {KEY.format("text")}, lang""")
def dedup_keep_first(spark, sf_dir):
    d = documents(spark, sf_dir).select("lang", "doc_id", F.md5(T.dedup_key(F.col("text"))).alias("key"))
    return selection.keep_first(d, [F.col("key"), F.col("lang")], [F.col("doc_id")])


@query(f"""WITH s AS (SELECT doc_id, unnest({SENTENCES.format("text")}) AS s, generate_subscripts({SENTENCES.format("text")}, 1) AS idx FROM documents),
w AS (SELECT doc_id, idx, concat_ws(' ', lag(s) OVER o, s, lead(s) OVER o) AS c FROM s WINDOW o AS (PARTITION BY doc_id ORDER BY idx))
SELECT doc_id, count(*) AS n, sum(length(left(c, 1200)))::BIGINT AS chars FROM w GROUP BY doc_id""")
def neighbor_context(spark, sf_dir):
    s = documents(spark, sf_dir).select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("idx", "s"))
    by = Window.partitionBy("doc_id").orderBy("idx")
    c = F.left(F.concat_ws(" ", F.lag("s").over(by), F.col("s"), F.lead("s").over(by)), F.lit(1200))
    return s.withColumn("c", c).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("c")).alias("chars"))


@query("SELECT count(*) AS n, count(DISTINCT doc_id) AS n_keys, true AS all_differ FROM documents")
def negative_sampling(spark, sf_dir):
    """Each document gets another one; which one is a matter of the hash."""
    s = index.negative_samples(documents(spark, sf_dir), "doc_id")
    return s.agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_keys"), F.bool_and(F.col("doc_id") != F.col("negative")).alias("all_differ"))


@query("""SELECT doc_id, n_chars, running FROM (SELECT doc_id, n_chars, sum(n_chars) OVER (ORDER BY doc_id)::BIGINT AS running FROM documents) WHERE running - n_chars < 1000000""")
def corpus_cutoff(spark, sf_dir):
    """Documents in id order until a million characters are reached; the one that crosses stays.

    Ranges of ids are summed first, and ranges of ranges, so that only the sums of these meet in one task; windows then run within a range."""
    most, past = 1_000_000, Window.unboundedPreceding
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.floor(F.col("doc_id") / 4096).alias("block"), F.floor(F.col("doc_id") / (1 << 24)).alias("range"))
    blocks = d.groupBy("range", "block").agg(F.sum("n_chars").alias("s"))
    before = lambda *by: F.coalesce(F.sum("s").over((Window.partitionBy(*by[:-1]) if by[:-1] else Window).orderBy(by[-1]).rowsBetween(past, -1)), F.lit(0))
    ranges = blocks.groupBy("range").agg(F.sum("s").alias("s")).select("range", before("range").alias("lower")).where(F.col("lower") < most)
    blocks = blocks.join(ranges, "range").select("range", "block", (F.col("lower") + before("range", "block")).alias("lower")).where(F.col("lower") < most)
    own = F.sum("n_chars").over(Window.partitionBy("range", "block").orderBy("doc_id").rowsBetween(past, 0))
    d = d.join(blocks, ["range", "block"]).select("doc_id", "n_chars", (F.col("lower") + own).alias("running"))
    return d.where(F.col("running") - F.col("n_chars") < most)


_SENT = f"""sent AS (SELECT chunk_id, unnest({SENTENCES.format("text")}) AS sentence, generate_subscripts({SENTENCES.format("text")}, 1) - 1 AS idx FROM (SELECT doc_id AS chunk_id, text FROM documents)),
hits AS (SELECT qid, question, chunk_id, rank AS chunk_rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY lexical DESC, chunk_id) AS rank FROM lex) JOIN {Q_SQL} USING (qid) WHERE rank <= 12),
scored AS (SELECT qid, chunk_rank, idx, sentence,
  CASE WHEN len({TERMS.format("sentence")}) = 0 THEN 0.0 ELSE 2.0 * len(list_intersect({TERMS.format("sentence")}, {TERMS.format("question")})) + 3.0 * len(list_intersect({TERMS.format("sentence")}, {TERMS.format("'thing'")})) + greatest(0.0, 3 - 0.25 * (chunk_rank - 1))
  + CASE WHEN len({WORDS.format("sentence")}) BETWEEN 8 AND 45 THEN 1.0 ELSE 0.0 END - CASE WHEN len({WORDS.format("sentence")}) > 70 THEN 2.0 ELSE 0.0 END END AS score
  FROM hits JOIN sent USING (chunk_id)),
uniq AS (SELECT qid, chunk_rank, idx, sentence, score FROM (SELECT *, row_number() OVER (PARTITION BY qid, {KEY.format("sentence")} ORDER BY chunk_rank, idx) AS r FROM scored) WHERE r = 1)"""


def scored_sentences(spark, sf_dir):
    """Sentences of each question's first twelve chunks, exact copies dropped, with their score."""
    c, q = chunks(spark, sf_dir), questions(spark)
    hits = ranking.candidates(ranking.lexical_scores(c, q).withColumn("score", F.col("lexical")), 12)
    s = c.join(small(hits.select("qid", "chunk_id", F.col("rank").alias("chunk_rank")), of=q, times=12), "chunk_id").join(small(q), "qid")
    s = s.select("qid", "question", "chunk_rank", F.posexplode(T.sentences(F.col("text"))).alias("idx", "sentence"))
    score = ranking.sentence_score(F.col("sentence"), F.col("question"), F.lit("thing"), F.col("chunk_rank"), F.lit(0.0))
    s = s.select("qid", "chunk_rank", "idx", "sentence", score.alias("score"))
    return selection.keep_first(s, [F.col("qid"), T.dedup_key(F.col("sentence"))], [F.col("chunk_rank"), F.col("idx")])


@query(f"WITH {_LEX}, {_SENT} SELECT qid, count(*) AS n, round(sum(score), 4) AS total FROM uniq GROUP BY qid")
def exact_sentence_dedup(spark, sf_dir):
    return scored_sentences(spark, sf_dir).groupBy("qid").agg(F.count("*").alias("n"), F.round(F.sum("score"), 4).alias("total"))


def _select_sql(most: int, chars: int) -> str:
    """The greedy choice as a recursive query over each question's ranked sentences."""
    return f"""WITH RECURSIVE {_LEX}, {_SENT},
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_rank, idx) AS i FROM uniq WHERE score > 0),
g AS (SELECT qid, 0::BIGINT AS i, 0::BIGINT AS n, 0::BIGINT AS c, false AS take FROM (SELECT DISTINCT qid FROM r)
  UNION ALL SELECT g.qid, r.i, g.n + t::INT, g.c + CASE WHEN t THEN length(r.sentence) ELSE 0 END, t FROM (
    SELECT g.qid, g.n, g.c, r.i, r.sentence, g.n < {most} AND (g.n = 0 OR g.c + length(r.sentence) <= {chars}) AS t FROM g JOIN r ON r.qid = g.qid AND r.i = g.i + 1 WHERE g.n < {most}) AS x JOIN r USING (qid, i) JOIN g ON g.qid = x.qid AND g.i = x.i - 1)
SELECT qid, pos, score, chunk_rank, idx, md5(sentence) AS digest FROM (SELECT r.*, row_number() OVER (PARTITION BY qid ORDER BY i) AS pos FROM r JOIN g USING (qid, i) WHERE take)"""


@query(_select_sql(5, 2600))
def evidence_select(spark, sf_dir):
    s = selection.budget_selection(scored_sentences(spark, sf_dir))
    return s.select("qid", "pos", "score", "chunk_rank", "idx", F.md5("sentence").alias("digest"))


@query(_select_sql(6, 2200).replace("ORDER BY i) AS pos", "ORDER BY chunk_rank, idx) AS pos"))
def evidence_select_v3(spark, sf_dir):
    s = selection.budget_selection(scored_sentences(spark, sf_dir), 6, 2200, document_order=True)
    return s.select("qid", "pos", "score", "chunk_rank", "idx", F.md5("sentence").alias("digest"))


@query(f"""WITH {_LEX}, {_SENT}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_rank, idx) AS pos FROM uniq WHERE score > 0)
SELECT qid, pos, chunk_rank, idx FROM r WHERE pos <= 5""")
def side_context(spark, sf_dir):
    s = scored_sentences(spark, sf_dir).where("score > 0")
    return top(s, 5, ["qid"], F.desc("score"), F.asc("chunk_rank"), F.asc("idx"), rank="pos").select("qid", "pos", "chunk_rank", "idx")


@query(f"""WITH {_LEX}, {_SENT} SELECT qid, count(*) AS selected, count(*) FILTER (len(list_intersect({TERMS.format("sentence")}, ['thing'])) >= 1) AS with_subject,
count(*) FILTER (contains(lower(sentence), 'ation') OR contains(lower(sentence), 'ened')) AS with_intent, max(score) AS best FROM uniq WHERE score > 0 GROUP BY qid""")
def evidence_stats(spark, sf_dir):
    s = scored_sentences(spark, sf_dir).where("score > 0")
    return selection.evidence_stats(s, selection.mentions(F.col("sentence"), F.lit("thing")), T.any_substring(F.col("sentence"), ("ation", "ened")))


@query(f"""WITH {_LEX}, h AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY lexical DESC, chunk_id) AS rank FROM lex)
SELECT qid, rank, chunk_id AS id, left(text, 240) AS preview, round(lexical, 3) AS score FROM h JOIN documents ON doc_id = chunk_id WHERE rank <= 5""")
def source_list(spark, sf_dir):
    c, q = chunks(spark, sf_dir), questions(spark)
    hits = ranking.candidates(ranking.lexical_scores(c, q).withColumn("score", F.col("lexical")), 5)
    return ranking.source_list(c.join(small(hits, of=q, times=5), "chunk_id"))


#: Three queries of each question: the question, its first four words, and its last three.
FUSION = [(10 * q + r, " ".join(part)) for q, text in CORPUS_QUESTIONS for r, part in enumerate((text.split(), text.split()[:4], text.split()[-3:]), 1)]
_FUSED = f"""{_lex_sql(values(FUSION, "qid, question"))},
hits AS (SELECT qid // 10 AS qid, qid % 10 AS query_rank, rank, chunk_id, text, lexical AS base, chunk_id % 4 = 0 AS runtime
  FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY lexical DESC, chunk_id) AS rank FROM lex) JOIN documents ON doc_id = chunk_id WHERE rank <= 5),
"""


def _fusion_sql(qs: float, qm: float, rs: float, rm: float, step: float, k: int) -> str:
    return f"""WITH {_FUSED} m AS (SELECT qid, {KEY.format("text")} AS key, max(base + greatest(0, {qm} - {qs} * (query_rank - 1)) + greatest(0, {rm} - {rs} * (rank - 1)) + CASE WHEN runtime THEN 5.0 ELSE 0 END) AS best,
max(base) AS base, count(*) AS query_hits, count(DISTINCT query_rank) AS queries, min(chunk_id) AS chunk_id FROM hits GROUP BY ALL),
s AS (SELECT *, round(best + least(5.0, {step} * (query_hits - 1)), 6) AS merged FROM m)
SELECT qid, chunk_id, merged, query_hits, queries, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY merged DESC, query_hits DESC, base DESC, chunk_id) AS rank FROM s) WHERE rank <= {k}"""


def _hits(spark, sf_dir):
    """Five hits of each query of each question; a fourth of the documents counts as ingested."""
    c, asked = chunks(spark, sf_dir), frame(spark, FUSION, "qid long, question string")
    found = ranking.candidates(ranking.lexical_scores(c, asked).withColumn("score", F.col("lexical")), 5)
    found = found.select(F.floor(F.col("qid") / 10).alias("qid"), (F.col("qid") % 10).alias("query_rank"), "rank", "chunk_id", F.col("lexical").alias("base"))
    return c.join(small(found, of=asked, times=5), "chunk_id").withColumn("runtime", F.col("chunk_id") % 4 == 0)


@query(_fusion_sql(0.25, 3.0, 0.4, 2.5, 1.2, 12))
def fusion_rank(spark, sf_dir):
    return ranking.merged_rank(ranking.fused(_hits(spark, sf_dir))).select("qid", "chunk_id", "merged", "query_hits", "queries", "rank")


@query(_fusion_sql(0.4, 3.0, 0.3, 2.0, 1.0, 8))
def side_fusion(spark, sf_dir):
    fused = ranking.fused(_hits(spark, sf_dir), 0.4, 3.0, 0.3, 2.0)
    return ranking.merged_rank(fused, 8, step=1.0).select("qid", "chunk_id", "merged", "query_hits", "queries", "rank")


@query(f"SELECT doc_id, {' + '.join(f'CASE WHEN contains(lower(text), {chr(39)}{p}{chr(39)}) THEN {d} ELSE 0.0 END' for p, d in (('haed', -8.0), ('ation', -3.0), ('thing', 4.0)))} AS bonus FROM documents")
def phrase_rules(spark, sf_dir):
    rules = ((("!never asked",), ("haed",), -8.0), (("!nor this",), ("ation",), -3.0), (("thing",), ("thing",), 4.0))
    return documents(spark, sf_dir).select("doc_id", ranking.phrase_bonus(F.lit("a thing"), F.col("text"), rules).alias("bonus"))


@query(f"""WITH s AS (SELECT conv_id, turn, unnest({SENTENCES.format("text")}) AS a, generate_subscripts({SENTENCES.format("text")}, 1) AS i FROM conversations),
p AS (SELECT x.conv_id, x.turn, len(list_intersect({SIGNATURE.format("x.a")}, {SIGNATURE.format("y.a")})) / least(len({SIGNATURE.format("x.a")}), len({SIGNATURE.format("y.a")})) AS c FROM s x JOIN s y ON x.conv_id = y.conv_id AND x.turn = y.turn AND x.i < y.i WHERE least(len({SIGNATURE.format("x.a")}), len({SIGNATURE.format("y.a")})) > 0)
SELECT conv_id, turn, count(*) AS n_pairs, count(*) FILTER (c >= 0.65) AS n_near FROM p GROUP BY ALL""")
def near_dup_pairs(spark, sf_dir):
    """Sentence pairs of a turn that hold most of each other's words. Pairs without a common word are counted, not made: the others
    meet on their words."""
    s = spread(table(spark, sf_dir, "conversations")).select("conv_id", "turn", F.posexplode(T.sentences(F.col("text"))).alias("i", "s"))
    s = s.select("conv_id", "turn", "i", T.signature(F.col("s")).alias("w")).where("size(w) > 0")
    word = s.select("conv_id", "turn", "i", F.size("w").alias("n"), F.explode("w").alias("word"))
    met = word.join(word.select("conv_id", "turn", F.col("i").alias("j"), F.col("n").alias("m"), "word"), ["conv_id", "turn", "word"]).where("i < j")
    near = met.groupBy("conv_id", "turn", "i", "j").agg((F.count("*") / F.least(F.first("n"), F.first("m"))).alias("c")).where("c >= 0.65").groupBy("conv_id", "turn").agg(F.count("*").alias("n_near"))
    pairs = s.groupBy("conv_id", "turn").agg(F.count("*").alias("n")).where("n >= 2").select("conv_id", "turn", F.expr("n * (n - 1) div 2").alias("n_pairs"))
    return pairs.join(near, ["conv_id", "turn"], "left").select("conv_id", "turn", "n_pairs", F.coalesce("n_near", F.lit(0)).alias("n_near"))


def said_sentences(spark, sf_dir):
    """id, w: the words of every sentence of the conversations; ids follow conversation, turn and place."""
    s = spread(table(spark, sf_dir, "conversations")).select("conv_id", "turn", F.posexplode(T.sentences(F.col("text"))).alias("i", "s"))
    return s.select((F.col("conv_id") * 100_000_000 + F.col("turn") * 10_000 + F.col("i")).alias("id"), T.signature(F.col("s")).alias("w"))


_SAID = f"""s AS (SELECT conv_id, turn, unnest({SENTENCES.format("text")}) AS s, generate_subscripts({SENTENCES.format("text")}, 1) - 1 AS i FROM conversations),
w AS (SELECT conv_id * 100000000 + turn * 10000 + i AS id, list_sort({SIGNATURE.format("s")}) AS w FROM s),
m AS (SELECT id, CASE WHEN len(w) > 0 THEN min(id) OVER (PARTITION BY w) ELSE id END AS class_id, w FROM w),
r AS (SELECT id, len(w) AS n, unnest(w) AS word FROM m WHERE id = class_id AND len(w) > 0),
l AS (SELECT a.id AS x, b.id AS y FROM r a JOIN r b ON a.word = b.word AND a.id < b.id GROUP BY a.id, b.id HAVING count(*) >= ceil(0.65 * min(least(a.n, b.n)) - 1e-9))"""


@query(f"""WITH {_SAID}, c AS (SELECT id, count(*) AS n FROM (SELECT x AS id FROM l UNION ALL SELECT y FROM l) GROUP BY id)
SELECT m.id, class_id, coalesce(c.n, 0) AS n_links FROM m LEFT JOIN c ON c.id = m.class_id""")
def near_dup_links(spark, sf_dir):
    """Every sentence with its class and the number of classes that it is near to."""
    rows = stored(said_sentences(spark, sf_dir), "said")
    members = stored(containment.classes(rows), "classes")
    return members.join(containment.link_counts(rows, members), "class_id", "left").select("id", "class_id", F.coalesce("n", F.lit(0)).alias("n_links"))


def near_dup_kept(spark, sf_dir):
    """Sentences that stay of all conversations, in order of their ids, if near copies of those that stay go."""
    rows = stored(said_sentences(spark, sf_dir), "said")
    members = stored(containment.classes(rows), "classes")
    return containment.kept(rows, members)


QUERIES["near_dup_kept"] = near_dup_kept


@query(f"""SELECT conv_id, turn, len(list_reduce(list_transform({SENTENCES.format("text")}, lambda x: [x]), lambda a, x: CASE WHEN len(list_filter(a, lambda y: least(len({SIGNATURE.format("x[1]")}), len({SIGNATURE.format("y")})) > 0 AND len(list_intersect({SIGNATURE.format("x[1]")}, {SIGNATURE.format("y")})) >= 0.65 * least(len({SIGNATURE.format("x[1]")}), len({SIGNATURE.format("y")})))) > 0 THEN a ELSE list_concat(a, x) END, []::VARCHAR[])) AS n_kept FROM conversations""")
def near_dup_greedy(spark, sf_dir):
    c = spread(table(spark, sf_dir, "conversations"))
    return c.select("conv_id", "turn", F.size(selection.greedy_distinct(T.sentences(F.col("text")))).cast("long").alias("n_kept"))


@query(f"""WITH s AS (SELECT conv_id, turn, unnest({SENTENCES.format("text")}) AS sentence, generate_subscripts({SENTENCES.format("text")}, 1) - 1 AS idx FROM conversations),
x AS (SELECT *, 2.0 * len(list_intersect({TERMS.format("sentence")}, ['thing', 'and', 'haed', 'ened'])) AS score FROM s),
r AS (SELECT *, max(score) OVER (PARTITION BY conv_id, turn) AS most, row_number() OVER (PARTITION BY conv_id, turn ORDER BY score DESC, idx) AS a, row_number() OVER (PARTITION BY conv_id, turn ORDER BY idx) AS b FROM x)
SELECT conv_id, turn, count(*) AS n, sum(idx)::BIGINT AS places FROM r WHERE CASE WHEN most > 0 THEN score > 0 AND a <= 3 ELSE b <= 3 END GROUP BY ALL""")
def context_selector(spark, sf_dir):
    s = spread(table(spark, sf_dir, "conversations")).select(F.struct("conv_id", "turn").alias("qid"), F.posexplode(T.sentences(F.col("text"))).alias("idx", "sentence"))
    asked = F.array(*map(F.lit, ("thing", "and", "haed", "ened")))
    s = s.withColumn("score", 2.0 * T.overlap(T.terms(F.col("sentence")), asked))
    return selection.context_sentences(s).groupBy("qid.conv_id", "qid.turn").agg(F.count("*").alias("n"), F.sum("idx").alias("places"))


@query("""SELECT conv_id, count(*) AS n_turns, md5(string_agg('**' || role || ':** ' || text, chr(10) || chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id""")
def conversation_export(spark, sf_dir):
    from ..sources import exports

    m = exports.markdown(table(spark, sf_dir, "conversations"), "conv_id", "turn")
    return m.select("conv_id", "n_turns", F.md5("markdown").alias("digest"))


@query("""SELECT conv_id, md5('{"messages":[' || string_agg('{"role":' || to_json(role) || ',"content":' || to_json(text) || '}', ',' ORDER BY turn) || ']}') AS digest FROM conversations GROUP BY conv_id""")
def conversation_json(spark, sf_dir):
    from ..sources import exports

    return exports.as_json(table(spark, sf_dir, "conversations"), "conv_id", "turn").select("conv_id", F.md5("json").alias("digest"))


@query(f"""SELECT doc_id, len(list_filter(list_transform(string_split_regex(text, '\\.[ \\t]+|\\n+'), lambda x: trim(x)), lambda x: x <> '')) AS n_naive,
len({SENTENCES.format("regexp_replace(trim(text), '(^|[^A-Za-z0-9])([A-Z])\\.[ ]+([A-Z])', '\\1\\2' || chr(1) || '\\3', 'g')")}) AS n_initials FROM documents""")
def sentence_variants(spark, sf_dir):
    d = documents(spark, sf_dir)
    return d.select("doc_id", F.size(T.lines_or_stops(F.col("text"))).cast("long").alias("n_naive"), F.size(T.sentences_keeping_initials(F.col("text"))).cast("long").alias("n_initials"))
