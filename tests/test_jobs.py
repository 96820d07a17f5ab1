"""The two jobs, on copies of the smallest tables: growing input, reruns, their command lines; the stored index against scores over all chunks."""

import json
import re
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from jobs import evaluate_retrieval, ingest_index
from sparkevid.operators import answering, evaluation, inverted, ranking
from sparkevid.operators import index as index_of

ROOT = Path(__file__).resolve().parent.parent


@pytest.fixture()
def grown(spark, small, tmp_path):
    """A folder with the first half of the documents, and a function that adds the rest."""
    d = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    source = str(tmp_path / "in")
    part = lambda k: d.where(F.pmod("doc_id", F.lit(2)) == k).coalesce(1).write.mode("append").parquet(source)
    part(0)
    return source, lambda: part(1)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def whole_index(spark, documents, tmp_path):
    inverted.write_batch(ingest_index.windows(documents, 500, 50), f"{tmp_path}/whole", 0)
    return rows(ingest_index.postings(spark, f"{tmp_path}/whole"))


def test_ingestion_takes_only_what_is_new(spark, small, grown, tmp_path):
    source, grow = grown
    target, mark = str(tmp_path / "index"), str(tmp_path / "mark")
    n = spark.read.parquet(source).count()
    first = ingest_index.run(spark, source, target, mark)
    assert (first["batches"], first["documents"]) == (1, n)
    before = rows(ingest_index.postings(spark, target))
    again = ingest_index.run(spark, source, target, mark)
    assert again == {"batches": 0, "documents": 0, "chunks": 0, "rejected": 0}
    assert rows(ingest_index.postings(spark, target)) == before
    grow()
    d = spark.read.parquet(f"{small}/documents.parquet")
    second = ingest_index.run(spark, source, target, mark)
    assert (second["batches"], second["documents"]) == (1, d.count() - n)
    assert rows(ingest_index.postings(spark, target)) == whole_index(spark, d, tmp_path)


def test_a_batch_that_runs_again_replaces_itself(spark, grown, tmp_path):
    """Without its checkpoint, as after a failure before the commit, the batch is written a second time."""
    source, _ = grown
    target = str(tmp_path / "index")
    ingest_index.run(spark, source, target, str(tmp_path / "a"))
    before = rows(ingest_index.postings(spark, target))
    ingest_index.run(spark, source, target, str(tmp_path / "b"))
    assert rows(ingest_index.postings(spark, target)) == before


def test_documents_that_cannot_be_indexed_are_told(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "index")
    data = [(1, "two words"), (1, "two words"), (None, "no id"), (2, None), (3, " \n"), (4, "!!! ???"), (5, "w " * 3000)]
    spark.createDataFrame(data, "doc_id long, text string").coalesce(1).write.parquet(source)
    done = ingest_index.run(spark, source, target, str(tmp_path / "mark"))
    assert (done["documents"], done["rejected"]) == (7, 3)
    assert rows(spark.read.parquet(f"{target}/rejected").select("reason")) == [("no id",), ("no words",), ("no words",)]
    found = ingest_index.postings(spark, target)
    assert found.where("doc_id = 5").count() == 7 and found.where("doc_id = 4").count() == 0


def test_empty_folder_of_one_empty_file(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "index")
    spark.createDataFrame([], "doc_id long, text string").coalesce(1).write.parquet(source)
    done = ingest_index.run(spark, source, target, str(tmp_path / "mark"))
    assert done["documents"] == 0
    if done["batches"]:
        assert inverted.Index(spark, target).size() == 0


QUESTIONS = [(1, "the thing and the other thing that there is"), (2, "que para ción los"), (3, "nothingmatchesthis"), (4, "lower than ation edon thing haed")]


@pytest.fixture(scope="module")
def index(spark, small, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("index"))
    d = spark.read.parquet(f"{small}/documents.parquet").select(F.col("doc_id").alias("chunk_id"), "text")
    for k in range(3):
        inverted.write_batch(d.where(F.pmod("chunk_id", F.lit(3)) == k), root, k)
    return inverted.Index(spark, root), d


def test_scores_and_search_equal_those_over_all_chunks(spark, index):
    found, d = index
    asked = spark.createDataFrame(QUESTIONS, "qid long, question string")
    want = ranking.lexical_scores(d, asked)
    assert rows(found.scores(asked).select("qid", "chunk_id", "lexical")) == rows(want.select("qid", "chunk_id", "lexical"))
    for k in (1, 3, 20, 1000):
        best = ranking.candidates(want.withColumn("score", F.col("lexical")), k)
        assert rows(found.search(asked, k).select("qid", "chunk_id", "lexical", "rank")) == rows(best.select("qid", "chunk_id", "lexical", "rank"))


def test_blocks_are_left_out(spark, tmp_path):
    """One block holds the asked rare word; no other can reach its score."""
    data = [(i, "common words here") for i in range(20 * inverted.BLOCK)] + [(5, "rare rare rare common words")]
    chunks = spark.createDataFrame([(i, t) for i, t in data if (i, t) != (5, "common words here")], "chunk_id long, text string")
    inverted.write_batch(chunks, str(tmp_path / "i"), 0)
    found = inverted.Index(spark, str(tmp_path / "i"))
    weights = found.weights(spark.createDataFrame([(1, "rare common")], "qid long, question string"))
    assert rows(found.promising(weights, 1)) == [(1, 0, 0)]
    assert [tuple(r)[:2] for r in found.search(spark.createDataFrame([(1, "rare common")], "qid long, question string"), 1).collect()] == [(1, 5)]


def test_only_asked_buckets_are_read(spark, index, capsys):
    found, _ = index
    weights = found.weights(spark.createDataFrame(QUESTIONS[:1], "qid long, question string"))
    found._of("postings", weights).explain("formatted")
    plan = capsys.readouterr().out
    assert "bucket" in plan.split("PartitionFilters:")[1].split("\n")[0] and "In(term" in plan


def test_compacted_index_is_the_same(spark, index, tmp_path):
    found, _ = index
    asked = spark.createDataFrame(QUESTIONS, "qid long, question string")
    one = inverted.compacted(found, str(tmp_path / "one"))
    assert rows(one.search(asked)) == rows(found.search(asked))
    assert one.table("sizes").count() == 1 and rows(one.statistics()) == rows(found.statistics())


def test_segments_hold_the_postings_of_odd_texts(spark):
    """Texts that touch each other, cases that fold to ASCII, bytes that are no UTF-8, apostrophes, empty texts and none; in one slice and in many."""
    texts = ["ab", "cd ab", "", None, "!!!", "'tis IT's", "\u212aelvin \u0130stanbul \u017fo", "a\u00e9b \u4e2d1\u4e2d2", "x" * 3000, "ab " * 400, "", "ab"]
    chunks = spark.createDataFrame([(i, i // 3, t) for i, t in enumerate(texts)], "chunk_id long, block long, text string").coalesce(1)
    chunks = chunks.unionByName(spark.sql("SELECT 99L AS chunk_id, CAST(NULL AS BIGINT) AS block, CAST(unhex('6162FF63C3') AS STRING) AS text"))
    want = rows(index_of.postings(chunks).join(chunks.select("chunk_id", "block"), "chunk_id").select("chunk_id", "block", "term", "tf"))
    assert len(want) > 15
    for size in (1, 8, 5000, inverted.SEGMENT):
        made = inverted.segments(chunks, size)
        assert rows(made.select(F.inline("hits"), "term").select("chunk_id", "block", "term", F.col("tf").cast("long"))) == want
        assert made.where("df <> size(hits) OR most <> array_max(hits.tf)").count() == 0
    assert inverted.segments(chunks.where("chunk_id IN (2, 3, 4)")).count() == 0


def test_rows_of_the_same_chunk_are_one_posting(spark, tmp_path):
    data = [(1, "a b"), (1, "b c b"), (1, "b"), (2, "b"), (None, "b d"), (None, "d"), (3, None), (3, "")]
    chunks = spark.createDataFrame(data, "chunk_id long, text string")
    inverted.write_batch(chunks, str(tmp_path / "i"), 0)
    found = inverted.Index(spark, str(tmp_path / "i"))
    assert rows(found.table("postings").select("chunk_id", "term", "tf")) == rows(index_of.postings(chunks))
    assert rows(found.statistics()) == [("a", 1), ("b", 3), ("c", 1), ("d", 1)] and found.size() == 8


def test_a_batch_sorts_segments_not_single_postings(spark, tmp_path):
    """200 chunks of the same 50 words: 10,000 postings and as many block maxima were rows of two tables."""
    chunks = spark.range(200).select(F.col("id").alias("chunk_id"), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(49)), lambda x: F.concat(F.lit("w"), x)), " ").alias("text"))
    inverted.write_batch(chunks, str(tmp_path / "i"), 0)
    assert sorted(p.name for p in (tmp_path / "i").iterdir()) == ["chunks", "segments", "sizes", "terms"]
    found = inverted.Index(spark, str(tmp_path / "i"))
    assert found.table("segments").count() <= 50 * 8
    assert found.table("postings").count() == 10_000
    assert found.table("blocks").agg(F.sum("n"), F.max("most"), F.count("*")).first()[:] == (10_000, 1, 50 * 4)


def test_answers_over_an_index(spark, tmp_path):
    from sparkevid.plans import rule_queries as Q

    chunks = spark.createDataFrame(Q.CORPUS, "chunk_id long, text string, runtime boolean")
    asked = spark.createDataFrame(Q.ASKED, "qid long, question string")
    for k, part in enumerate(("chunk_id % 2 = 0", "chunk_id % 2 = 1")):
        inverted.write_batch(chunks.where(part), str(tmp_path / "i"), k)
    found = answering.indexed_answers(asked, inverted.Index(spark, str(tmp_path / "i")))
    assert rows(found) == rows(answering.answers(asked, chunks.withColumn("runtime", F.lit(True))))


def test_evaluation_reruns_with_the_same_result(spark, small, tmp_path):
    target = str(tmp_path / "out")
    paths = (f"{small}/documents.parquet", f"{small}/benchmark.parquet", target)
    done = evaluate_retrieval.run(spark, *paths)
    before = rows(evaluate_retrieval.report(spark, target))
    assert len(before) == done["rows"] > 0
    assert evaluate_retrieval.run(spark, *paths) == done
    assert rows(evaluate_retrieval.report(spark, target)) == before
    evaluate_retrieval.run(spark, *paths, systems=("lexical",))  # the other system's partitions stay
    assert rows(evaluate_retrieval.report(spark, target)) == before
    assert {r[0] for r in spark.read.parquet(f"{target}/cases").select("system").distinct().collect()} == {"keyword", "lexical"}


def test_cases_and_ranks_by_hand(spark):
    """Support at rank 2 of one system, none of the other; a contradiction; a passage that is too short."""
    passages = spark.createDataFrame([(1, "One two three four five six seven eight nine"), (2, "too short"), (3, None)], "item_id long, text string")
    asked = evaluation.cases(passages)
    assert [tuple(r) for r in asked.orderBy("qid").collect()] == [
        (2, 1, "passage", "one two three four five six seven eight nine", True, "three four five six seven eight", None),
        (3, 1, "reversed", "one two three four five six seven eight nine", False, "eight seven six five four three", "three four five six seven eight"),
    ]
    chunks = spark.createDataFrame([(1, "two nine"), (2, "So: three, four five SIX seven eight."), (3, "eight seven six five four three")], "chunk_id long, text string")
    found = spark.createDataFrame([("a", 2, 1, 1, 0.5), ("a", 2, 2, 2, 0.4), ("a", 3, 2, 1, 0.5), ("b", 3, 3, 1, 0.5)], "system string, qid long, chunk_id long, rank int, score double")
    got = evaluation.supports(chunks, asked, found, systems={"a": None, "b": None})
    got = got.withColumn("reason", evaluation.verdict(F.col("supported"), F.col("support_rank")))
    want = [("a", 2, 2, None, None), ("a", 3, None, 1, None), ("b", 2, None, None, "false_rejection"), ("b", 3, 1, None, "false_support")]
    assert rows(got.select("system", "qid", "support_rank", "contradiction_rank", "reason")) == want
    figures = {(r["system"], r["category"]): r for r in evaluation.by_system(got).collect()}
    assert figures["a", "(all)"]["accuracy_at_5"] == 1.0 and figures["a", "(all)"]["mrr_all"] == 0.5 and figures["b", "(all)"]["failed"] == 2
    assert rows(evaluation.paired(got, "a", "b")) == [("passage", 1, 0, 1, 0, 0), ("reversed", 1, 0, 1, 0, 0)]


def test_systems_score_by_blocks_as_by_pairs(spark, capsys, monkeypatch):
    """Several blocks of questions and of chunks, apostrophes, ties, a null id and a null text; no pair of a question and a chunk is shuffled."""
    from sparkevid.operators import similarity

    words = "the it's o'clock '' red don't don t alpha beta gamma delta of and x".split()
    texts = [(i, " ".join(words[(i * p) % 14] for p in range(1, 3 + i % 9))) for i in range(120)] + [(500, None), (None, "alpha beta don't"), (501, "Don't DON'T the 'the'")]
    chunks = spark.createDataFrame(texts, "chunk_id long, text string")
    asked = spark.createDataFrame([(i, " ".join(words[(i * p + 3) % 14] for p in range(4))) for i in range(9)] + [(90, "nothing"), (91, "'' don't")], "qid long, question string")
    monkeypatch.setattr(similarity, "STRIPE", 4)
    monkeypatch.setattr(similarity, "BLOCK_POSTINGS", 30)
    found = evaluation.hits(chunks, asked, 5)
    found.explain()
    assert not re.search(r"hashpartitioning\(qid#\d+L?, chunk_id#", capsys.readouterr().out)
    n = asked.groupBy("question").agg(F.min("qid").alias("qid"))
    some = chunks.withColumn("chunk_id", F.coalesce("chunk_id", F.lit(evaluation.NO_ID)))
    lexical = ranking.lexical_scores(some, n).withColumn("score", F.col("lexical"))
    keyword = ranking.keyword_scores(some, n).withColumn("score", F.col("keyword").cast("double")).withColumn("lexical", F.col("score"))
    for name, scored in (("lexical", lexical), ("keyword", keyword)):
        best = ranking.candidates(scored, 5).select("qid", F.nullif("chunk_id", F.lit(evaluation.NO_ID)).alias("chunk_id"), "rank", "score")
        want = n.select(F.col("qid").alias("first"), "question").join(asked, "question").join(best.withColumnRenamed("qid", "first"), "first").select("qid", "chunk_id", "rank", "score")
        assert rows(found.where(F.col("system") == name).select("qid", "chunk_id", "rank", "score")) == rows(want)


@pytest.mark.parametrize("job", ["ingest_index", "evaluate_retrieval"])
def test_command_line(small, tmp_path, job):
    settings = json.loads((ROOT / "jobs" / f"{job}.json").read_text())
    paths = {"source": f"{small}/documents.parque[t]", "target": f"{tmp_path}/out", "checkpoint": f"{tmp_path}/mark", "documents": f"{small}/documents.parquet", "benchmark": f"{small}/benchmark.parquet"}
    config = tmp_path / "config.json"
    config.write_text(json.dumps({k: paths.get(k, v) for k, v in settings.items()} | {"target": "/nowhere"}))
    done = subprocess.run([sys.executable, str(ROOT / "jobs" / f"{job}.py"), "--config", str(config), "--target", f"{tmp_path}/out"], capture_output=True, text=True, timeout=400)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "read" in done.stderr and "wrote" in done.stderr
    assert (tmp_path / "out").is_dir()
