"""Sources: text files, JSON and JSON lines with fixed schemas, uploads with an error for each file, requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

CHUNK = "id bigint, text string, start_word int, end_word int"
CASE = "id string, category string, question string, expected_terms array<string>, supported boolean, contradiction_terms array<string>, required_terms array<string>, match_mode string"
SUITE = "name string, description string, documents array<struct<name:string,text:string>>, cases array<struct<id:string,question:string,supported:boolean,required_answer_groups:array<array<string>>,required_source_terms:array<string>>>"
TRIPLE = "query string, positive string, negative string"
EXAMPLE = "context string, question string, answer string, type string, prompt string"
LEAST_LINE = 80
MOST_REQUEST = 500_000


def existing(spark: SparkSession, paths: list[str]) -> list[str]:
    """The paths that are there; missing ones are skipped, in whatever store they are."""
    out = []
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
            out.append(path)
    return out


def knowledge_paths(spark: SparkSession, default: list[str], key: str = "spark.sparkevid.knowledge") -> list[str]:
    """Corpus paths from the session's configuration, comma-separated, else the default."""
    named = spark.conf.get(key, "")
    return [p.strip() for p in named.split(",") if p.strip()] or default


def corpus_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, text: cleaned lines of at least 80 characters."""
    found = existing(spark, paths)
    if not found:
        return spark.createDataFrame([], "path string, text string")
    lines = spark.read.text(found).select(F.input_file_name().alias("path"), T.clean_markup(F.col("value")).alias("text"))
    return lines.where(F.length("text") >= LEAST_LINE)


def packed_chunks(lines: DataFrame) -> DataFrame:
    """path, text: the lines packed in chunks of whole sentences."""
    return lines.select("path", F.explode(T.pack_sentences(T.sentences(F.col("text")))).alias("text"))


def json_chunks(spark: SparkSession, path: str) -> DataFrame:
    """A chunk index that is one JSON array."""
    return spark.read.schema(CHUNK).json(path, multiLine=True)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def cases(spark: SparkSession, path: str) -> DataFrame:
    """Retrieval cases with their defaults: category general, supported, any_term, required terms as expected ones."""
    c = json_lines(spark, path, CASE).where("question is not null")
    empty = F.array().cast("array<string>")
    return c.withColumns({
        "id": F.coalesce("id", F.concat(F.lit("case_"), F.lpad(F.monotonically_increasing_id().cast("string"), 3, "0"))),
        "category": F.coalesce("category", F.lit("general")),
        "expected_terms": F.coalesce("expected_terms", empty),
        "supported": F.coalesce("supported", F.lit(True)),
        "match_mode": F.coalesce("match_mode", F.lit("any_term")),
        "required_terms": F.coalesce("required_terms", "expected_terms", empty),
    })


def _parsed(kind: str, data: bytes) -> tuple[str | None, str | None]:
    """(text, error) of one file."""
    try:
        if kind == "txt":
            return data.decode("utf-8", errors="ignore"), None
        if kind == "docx":
            import io
            import re
            import zipfile
            from html import unescape

            xml = zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml").decode("utf-8")
            paragraphs = re.findall(r"<w:p[ >].*?</w:p>", xml, re.S)
            return "\n".join(unescape("".join(re.findall(r"<w:t(?: [^>]*)?>(.*?)</w:t>", p, re.S))) for p in paragraphs), None
        if kind == "pdf":
            import io

            from PyPDF2 import PdfReader  # optional; without it, the file's row has the error

            return "\n".join(page.extract_text() or "" for page in PdfReader(io.BytesIO(data)).pages), None
        return None, f"unsupported file type: {kind}"
    except Exception as error:  # noqa: BLE001  a bad upload is a row, not a failed job
        return None, f"{type(error).__name__}: {error}"


def uploads(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, name, ext, text, error of uploaded files; one bad file does not stop the others."""
    found = existing(spark, paths)
    if not found:
        return spark.createDataFrame([], "path string, name string, ext string, text string, error string")
    files = spark.read.format("binaryFile").load(found).select("path", "content")

    def parse(batches):
        for pdf in batches:
            kinds = pdf["path"].str.rsplit(".", n=1).str[-1].str.lower()
            rows = [_parsed(k, bytes(c)) for k, c in zip(kinds, pdf["content"], strict=True)]
            yield pdf.assign(name=pdf["path"].str.rsplit("/", n=1).str[-1], ext=kinds, text=[r[0] for r in rows], error=[r[1] for r in rows])[["path", "name", "ext", "text", "error"]]

    return files.mapInPandas(parse, "path string, name string, ext string, text string, error string")


def upload_chunks(uploaded: DataFrame) -> DataFrame:
    """Chunks of 500 words that overlap by 50, of the files without error, marked as ingested at run time."""
    w = uploaded.where("error is null").select("path", F.explode(T.word_windows(T.space_words(F.col("text")), 500, 50)).alias("w"))
    return w.select(F.xxhash64("path", "w.start_word").alias("chunk_id"), "path", "w.text", F.lit(True).alias("runtime"))


def requests(texts: DataFrame) -> DataFrame:
    """Ingestion requests with a reason for those that are refused: blank, or above 500,000 characters."""
    reason = F.when(F.coalesce(F.trim("text"), F.lit("")) == "", "blank").when(F.length("text") > MOST_REQUEST, "too_long")
    return texts.withColumn("error", reason)
