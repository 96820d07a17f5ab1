"""Order-dependent operators against plain Python, properties that hold whatever the partitioning, and sources."""

import json
import random
import re

from pyspark.sql import functions as F

from sparkevid.functions import text as T
from sparkevid.operators import etl, gates, index, metrics, questions, selection, synthesis
from sparkevid.sources import corpus, exports
from sparkevid.streaming import ingest


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def sentences(t):
    return [s.strip() for s in re.split(r"(?<=[.!?])\s+", t.strip()) if s.strip()]


def packed(parts, limit=900, least=80):
    out, cur, size = [], [], 0
    for s in parts:
        if cur and size + len(s) > limit:
            out.append(" ".join(cur))
            cur, size = [], 0
        cur.append(s)
        size += len(s) + 1
    if cur:
        out.append(" ".join(cur))
    return [c for c in out if len(c) >= least]


def test_packing_against_python(spark, small):
    d = spark.read.parquet(f"{small}/documents.parquet")
    for r in d.select("text", T.pack_sentences(T.sentences(F.col("text"))).alias("c")).collect():
        assert r["c"] == packed(sentences(r["text"]))


def test_sentences_keep_digits_at_their_ends(spark):
    text = "0 is first 0. 1 follows, as does 11. 2 is 2 or 22. \u00a03 \u3000"
    want = ["0 is first 0.", "1 follows, as does 11.", "2 is 2 or 22.", "3"]
    assert one(spark, T.sentences(F.lit(text))) == one(spark, T.sentences_keeping_initials(F.lit(text))) == want
    assert one(spark, T.lines_or_stops(F.lit("0 a 0\n1 b 1\n1"))) == ["0 a 0", "1 b 1", "1"]
    assert one(spark, T.pack_sentences(T.sentences(F.lit(text)), least=1)) == [" ".join(want)]


def test_initials_do_not_end_sentences(spark):
    assert one(spark, T.sentences_keeping_initials(F.lit("It was J. Smith who came. He left."))) == ["It was J. Smith who came.", "He left."]


def test_mined_instructions_are_not_capped(spark):
    n = etl.CAP + 7
    lines = spark.range(n).select("id", F.concat(F.lit("The Harbor Board "), F.translate(F.col("id").cast("string"), "0123456789", "bcdfghjklm"), F.lit(" was founded in 1902.")).alias("text"))
    assert etl.mined_instructions(lines, "id").count() == n


def test_runs_of_initials_against_sql(spark):
    import duckdb

    from sparkevid.plans import corpus_queries

    text = "heing. A. A. A. A. Then J. R. Smith came. K. L."
    n = duckdb.sql(corpus_queries.ORACLE["sentence_variants"].replace("FROM documents", f"FROM (SELECT 1 AS doc_id, '{text}' AS text)")).fetchall()[0][2]
    got = one(spark, T.sentences_keeping_initials(F.lit(text)))
    assert got == ["heing.", "A. A.", "A. A.", "Then J. R.", "Smith came.", "K. L."] and len(got) == n


def test_greedy_keeps_by_order(spark):
    a, b, c = "alpha bravo charlie delta", "alpha bravo charlie xenon", "xenon yankee zulu charlie"
    keep = lambda x: one(spark, selection.greedy_distinct(F.array(*map(F.lit, x))))
    assert keep([a, b, c]) == [a, c]
    assert keep([b, a, c]) == [b, c]


def test_budget_skips_what_is_too_long_and_goes_on(spark):
    rows = [(1, 9.0, 1, 0, "a" * 2000), (1, 8.0, 1, 1, "b" * 700), (1, 7.0, 2, 0, "c" * 500), (1, 0.0, 1, 2, "never"), (2, 1.0, 1, 0, "d" * 5000)]
    s = spark.createDataFrame(rows, "qid long, score double, chunk_rank int, idx int, sentence string")
    got = [(r["qid"], r["pos"], r["sentence"][0]) for r in selection.budget_selection(s).orderBy("qid", "pos").collect()]
    assert got == [(1, 1, "a"), (1, 2, "c"), (2, 1, "d")]


def test_statistics_do_not_depend_on_batches_or_partitions(spark, small):
    d = spark.read.parquet(f"{small}/documents.parquet").select(F.col("doc_id").alias("chunk_id"), "text")
    whole = {r["term"]: r["df"] for r in index.term_stats(index.postings(d)).collect()}
    parts = [index.term_stats(index.postings(d.where(F.col("chunk_id") % 3 == k).repartition(3 + k))) for k in range(3)]
    merged = index.merged_stats(index.merged_stats(parts[0], parts[1]), parts[2])
    assert {r["term"]: r["df"] for r in merged.collect()} == whole


def test_percentiles_against_python(spark, monkeypatch):
    import statistics

    v = spark.range(30_000).select(F.lit("g").alias("g"), (F.xxhash64("id") % 1000).cast("double").alias("v"))
    whole = metrics.p95(v.repartition(3), "g", "v").first()
    monkeypatch.setattr(metrics, "WHOLE", 100_000)
    assert metrics.p95(v, "g", "v").first() == whole

    for n in (1, 2, 19, 20, 21, 40):
        v = [random.Random(n).randint(0, 50) / 2 for _ in range(n)]
        r = metrics.p95(spark.createDataFrame([("g", x) for x in v], "g string, v double"), "g", "v").first()
        s = sorted(v)
        assert r["p95_nearest"] == s[round(0.95 * (n - 1))]
        assert r["p95_floor"] == s[min(n - 1, int(0.95 * n))]
        assert r["p95_exclusive"] == (max(v) if n < 20 else round(statistics.quantiles(v, n=20)[18], 6))


def test_every_intent_is_reached(spark):
    asked = {"comparison": "Compare salt and iron", "significance": "Why was the charter important?", "effect": "What were the effects of rain?", "change": "How did trade evolve?", "features": "What characterized the union?", "structure": "What is salt made of?", "entity_list": "Who were the key people?", "process": "How does a mill work?", "cause": "Why did it end?", "general": "Salt"}
    d = spark.createDataFrame(list(asked.items()), "want string, q string")
    assert all(r["want"] == r["got"] for r in d.select("want", questions.intent(F.col("q")).alias("got")).collect())


def test_conflicts_need_a_shared_subject(spark):
    q = lambda a, b: one(spark, gates.numeric_conflict(F.lit(a), F.lit(b)))
    assert q("The pump pressure is 3 bar here", "The pump pressure is 5 bar here")
    assert not q("The pump pressure is 3 bar here", "The pump pressure is 3 bar here")
    assert not q("The pump pressure is 3 bar here", "Nobody ate 5 bar today")
    assert not q("The pump pressure is 3 bar here", "The pump pressure is 5 volts here")


def test_abstains_without_support_and_on_conflict(spark):
    args = [F.lit("Why did it end?"), F.lit("cause"), F.lit("the League"), F.array(F.lit("The League declined because its fleets were lost."))]
    said = lambda support, conflict: tuple(one(spark, synthesis.answered(*args, F.lit(support), F.lit(conflict))))
    assert said(True, True)[1:] == ("conflict", False)
    assert said(True, False)[2] is True
    none = tuple(one(spark, synthesis.answered(F.lit("Tell me"), F.lit("effect"), F.lit("rain"), F.array(F.lit("It was dry.")), F.lit(True), F.lit(False))))
    assert none == (gates.REFUSAL, "system", False)


def test_mined_examples_are_in_their_context(spark):
    d = spark.createDataFrame([(1, "Before. Port Ansel was founded in 1902. After that it grew and grew.")], "doc_id long, text string")
    r = etl.examples(d, "doc_id").first()
    assert (r["question"], r["answer"], r["context"]) == ("When was Port Ansel founded?", "1902", "Before. Port Ansel was founded in 1902. After that it grew and grew.")


def test_sources_and_sinks(spark, tmp_path):
    long = "This line is long enough to stay because it has more than eighty characters in it, surely."
    (tmp_path / "a.txt").write_text(f"short\n\n{long} It @-@ ends.\n")
    (tmp_path / "bad.xyz").write_text("x")
    (tmp_path / "cases.jsonl").write_text(json.dumps({"question": "q?", "expected_terms": ["a"]}) + "\n\n" + json.dumps({"question": "r?", "supported": False, "category": "c"}) + "\n")
    assert [r["text"] for r in corpus.corpus_lines(spark, [str(tmp_path / "a.txt"), str(tmp_path / "missing.txt")]).collect()] == [f"{long} It - ends."]
    up = {r["ext"]: r for r in corpus.uploads(spark, [str(tmp_path / "a.txt"), str(tmp_path / "bad.xyz")]).collect()}
    assert up["txt"]["error"] is None and up["xyz"]["text"] is None and "unsupported" in up["xyz"]["error"]
    c = {r["question"]: r for r in corpus.cases(spark, str(tmp_path / "cases.jsonl")).collect()}
    assert (c["q?"]["supported"], c["q?"]["required_terms"], c["r?"]["supported"], c["r?"]["match_mode"]) == (True, ["a"], False, "any_term")
    turns = spark.createDataFrame([(1, 2, "bot", "b"), (1, 1, "user", "a")], "conv_id long, turn long, role string, text string")
    assert exports.markdown(turns, "conv_id", "turn").first()["markdown"] == "**user:** a\n\n**bot:** b"
    assert json.loads(exports.as_json(turns, "conv_id", "turn").first()["json"])["messages"][1] == {"role": "bot", "content": "b"}


def test_streamed_ingestion_equals_a_rebuild(spark, tmp_path):
    src, root, check = (str(tmp_path / n) for n in ("src", "root", "check"))
    for k in range(2):
        spark.createDataFrame([(k * 10 + i, f"word{i} shared text {k}") for i in range(3)], ingest.DOCUMENT).coalesce(1).write.mode("append").parquet(src)
        ingest.start(spark, src, root, check).awaitTermination()
    whole = index.term_stats(index.postings(ingest.chunks(spark.read.schema(ingest.DOCUMENT).parquet(src))))
    assert {tuple(r) for r in ingest.statistics(spark, root).collect()} == {tuple(r) for r in whole.collect()}


def test_any_number_of_query_vectors(spark, monkeypatch):
    from sparkevid.operators import similarity

    many = spark.range(10_001).selectExpr("id AS vec_id", "array(1.0F, CAST(id AS FLOAT)) AS embedding")
    got = similarity.nearest(many.where("vec_id < 2"), many, 2)
    assert got.groupBy("query_id").count().count() == 10_001


def test_json_array_round_trip(spark, tmp_path):
    rows = [(k, f'text "{k}" é', k * 95, k * 95 + 120) for k in range(25)]
    path = str(tmp_path / "index")
    exports.write_json_array(spark.createDataFrame(rows, corpus.CHUNK).repartition(4), path, "id")
    assert sorted(map(tuple, corpus.json_chunks(spark, path).collect())) == rows
    (part,) = [p for p in (tmp_path / "index").iterdir() if p.name.startswith("part-")]
    assert [x["id"] for x in json.loads(part.read_text())] == list(range(25))
    exports.write_json_array(spark.createDataFrame([], corpus.CHUNK), path, "id")
    assert corpus.json_chunks(spark, path).collect() == []


def test_json_lines_round_trip(spark, tmp_path):
    rows = [("q é", "p", "n"), ("r", None, "m")]
    exports.write_jsonl(spark.createDataFrame(rows, corpus.TRIPLE), str(tmp_path / "t"))
    assert sorted(map(tuple, corpus.json_lines(spark, str(tmp_path / "t"), corpus.TRIPLE).collect())) == rows


def test_knowledge_paths_from_the_session(spark):
    assert corpus.knowledge_paths(spark, ["a", "b"]) == ["a", "b"]
    spark.conf.set("spark.sparkevid.knowledge", " /x/one.txt, ,/y/two.txt")
    try:
        assert corpus.knowledge_paths(spark, ["a"]) == ["/x/one.txt", "/y/two.txt"]
    finally:
        spark.conf.unset("spark.sparkevid.knowledge")


def test_parsers_of_word_and_pdf(spark, tmp_path, monkeypatch):
    import io
    import sys
    import types
    import zipfile

    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("word/document.xml", '<w:document><w:body><w:p w:x="1"><w:r><w:t>First </w:t></w:r><w:r><w:t xml:space="preserve">part &amp; more</w:t></w:r></w:p><w:p><w:r><w:t>Second.</w:t></w:r></w:p></w:body></w:document>')
    (tmp_path / "a.docx").write_bytes(buffer.getvalue())
    (tmp_path / "broken.docx").write_bytes(b"no archive")
    up = {r["name"]: r for r in corpus.uploads(spark, [str(tmp_path / n) for n in ("a.docx", "broken.docx")]).collect()}
    assert up["a.docx"]["text"] == "First part & more\nSecond." and up["a.docx"]["error"] is None
    assert up["broken.docx"]["text"] is None and up["broken.docx"]["error"].startswith("BadZipFile")

    class Reader:
        def __init__(self, stream):
            assert stream.read() == b"%PDF"
            self.pages = [types.SimpleNamespace(extract_text=lambda t=t: t) for t in ("One.", None, "Two.")]

    monkeypatch.setitem(sys.modules, "PyPDF2", types.SimpleNamespace(PdfReader=Reader))
    assert corpus._parsed("pdf", b"%PDF") == ("One.\n\nTwo.", None)
    monkeypatch.setitem(sys.modules, "PyPDF2", None)
    assert corpus._parsed("pdf", b"%PDF")[0] is None


def test_requests_are_ingested_for_the_next_question(spark, tmp_path):
    from sparkevid.operators import ranking

    asked = spark.createDataFrame([(1, "The lighthouse was built of basalt."), (2, "  "), (3, "x" * 500_001), (4, None)], ingest.DOCUMENT)
    checked = {r["doc_id"]: r["error"] for r in ingest.accept(asked, str(tmp_path), 0).collect()}
    assert checked == {1: None, 2: "blank", 3: "too_long", 4: "blank"}
    ingest.accept(spark.createDataFrame([(5, "Basalt is dark.")], ingest.DOCUMENT), str(tmp_path), 1)
    chunks = ingest.ingested(spark, str(tmp_path))
    q = spark.createDataFrame([(1, "basalt lighthouse")], "qid long, question string")
    hits = chunks.join(ranking.lexical_scores(chunks, q), "chunk_id").orderBy(F.desc("lexical")).collect()
    assert [r["text"] for r in hits] == ["The lighthouse was built of basalt.", "Basalt is dark."] and all(r["runtime"] for r in hits)
    assert {r["term"]: r["df"] for r in ingest.statistics(spark, str(tmp_path)).collect()}["basalt"] == 2


def test_feedback_is_appended(spark, tmp_path):
    row = (1, 1.5, "2026-01-01", 7, "q", "a", "cause", "extracted", 0.9, True, [(1, 2, "p", "e", 1.5)], {"k": "v"})
    for vote in (7, -1):
        exports.append_feedback(spark.createDataFrame([(*row[:3], vote, *row[4:])], exports.FEEDBACK), str(tmp_path / "log"))
    log = spark.read.schema(exports.FEEDBACK).parquet(str(tmp_path / "log")).orderBy("vote").collect()
    assert [r["vote"] for r in log] == [-1, 0] and log[0]["extra"] == {"k": "v"} and log[0]["sources"][0]["preview"] == "p"


def test_log_files_rotate(tmp_path):
    from sparkevid.session import log_to

    path = str(tmp_path / "engine.log")
    log = log_to(path, "sparkevid.test", size=400, files=3)
    assert log_to(path, "sparkevid.test") is log and len(log.handlers) == 1
    for k in range(60):
        log.info("line %d", k)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["engine.log", "engine.log.1", "engine.log.2", "engine.log.3"]


def test_seeded_shuffle_is_a_fixed_order(spark):
    d = spark.range(50)
    once = [r["id"] for r in etl.shuffled(d, "id").collect()]
    assert once == [r["id"] for r in etl.shuffled(d.repartition(3), "id").collect()] and sorted(once) == list(range(50)) and once != list(range(50))
    assert once != [r["id"] for r in etl.shuffled(d, "id", 7).collect()]


def test_instruction_forms(spark):
    d = spark.createDataFrame([(1, "The old tidal gate is a barrier of oak. It was closed. The long siege of the town was over."), (2, "Boats moved quickly towards the distant harbour."), (3, "a b"), (4, "")], "doc_id long, text string")
    got = {(r["doc_id"], r["i"]): (r["prompt"].split("Question: ")[1].split("\n")[0], r["answer"]) for r in etl.evidence_instructions(d, "doc_id", None).collect()}
    assert got == {
        (1, 0): ("What is The old tidal gate?", "The old tidal gate is a barrier of oak."), (1, 1): ("According to the context, what information is given about closed?", "It was closed."),
        (1, 2): ("What was The long siege of the town?", "The long siege of the town was over."), (2, 0): ("According to the context, what information is given about Boats moved quickly towards distant?", "Boats moved quickly towards the distant harbour."),
        (3, 0): ("According to the context, what information is given about this topic?", "a b"),
    }
    three = etl.evidence_instructions(d, "doc_id").groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in three} == {1: 3, 2: 3, 3: 3}


def test_negative_samples_with_equal_keys(spark):
    texts = spark.createDataFrame([(k // 3,) for k in range(30)] + [(None,)], "k long")
    got = {r["k"]: r["negative"] for r in index.negative_samples(texts, "k").collect()}
    assert sorted(got) == list(range(10)) and all(k != v for k, v in got.items())
    assert index.negative_samples(texts.where("k = 1"), "k").collect() == []
    assert len(index.negative_samples(texts.where("k < 2"), "k").collect()) == 2


def test_passages_of_any_length_are_found(spark, tmp_path):
    from sparkevid.plans import registry

    passages = [(1, "alpha beta gamma delta epsilon zeta eta theta"), (2, "one two three four five six seven"), (3, "red fox"), (4, "pha bet"), (5, "mid the word cut"), (6, "...")]
    docs = [(1, "xalpha beta gamma delta epsilon zeta eta thetax"), (2, "so one two three four five six sevenths"), (3, "the red foxes"), (4, "amid the word cuts"), (5, "nothing...")]
    spark.createDataFrame(passages, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["item_id"]: (r["n_docs"], r["first_doc"]) for r in registry.QUERIES["benchmark_passages"](spark, str(tmp_path)).collect()}
    assert got == {i: (len(hit), min(hit)) for i, p in passages if (hit := [d for d, t in docs if p in t])} and set(got) == {1, 2, 3, 4, 5, 6}


def test_a_model_can_be_plugged_in(spark):
    from sparkevid.operators import generation

    def load():
        words = ["<end>", "the", "tide", "rises", "and", "falls"]
        follows = {1: 2, 2: 3, 3: 4, 4: 5, 5: 0}

        def scores(ids):
            return [1.0 if ids and follows.get(ids[-1]) == i else 0.0 for i in range(len(words))]

        return generation.Model(lambda t: [words.index(w) for w in t.split()], lambda ids: " ".join(words[i] for i in ids), scores, 0)

    d = spark.createDataFrame([(1, "the"), (2, "and"), (3, None), (4, "falls")], "id long, prompt string")
    assert {r["id"]: r["generated"] for r in generation.generated(d, load).collect()} == {1: "tide rises and falls", 2: "falls", 3: None, 4: ""}
    assert {r["id"]: r["generated"] for r in generation.generated(d, load, 2).collect()}[1] == "tide rises"


def test_keyphrases_shuffle_texts_once(spark, small):
    d = spark.read.parquet(f"{small}/documents.parquet")
    d = d.select(F.pmod("doc_id", F.lit(150)).alias("doc_id"), "text")  # ids that documents share
    k = index.keyphrases(d, "doc_id")
    assert k._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert k.groupBy("doc_id", "rank").count().where("count > 1").isEmpty()
