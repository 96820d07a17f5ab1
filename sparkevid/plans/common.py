"""Fixtures that Spark and DuckDB share, and fragments of DuckDB SQL."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import table


def literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, list | tuple):
        return "[" + ", ".join(map(literal, v)) + "]" + ("" if v else "::VARCHAR[]")
    return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)


def values(rows: Sequence[tuple], columns: str) -> str:
    """A DuckDB relation of rows."""
    return f"(VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) AS v({columns})"


def frame(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rows], schema)


STOP_SQL = literal(T.STOPWORDS)
MORE_SQL = literal(T.STOPWORDS + T.MORE_STOPWORDS)
TOKENS = "regexp_extract_all(lower({}), '[a-z0-9'']+')"
PLAIN = "regexp_extract_all(lower({}), '[a-z0-9]+')"
KEY = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"
CONTENT = "list_filter(" + TOKENS + ", lambda w: length(w) >= 2 AND NOT list_contains(" + STOP_SQL + ", w))"
TERMS = "list_distinct(list_filter(" + TOKENS + ", lambda w: length(w) >= 3 AND NOT list_contains(" + MORE_SQL + ", w)))"
SIGNATURE = "list_distinct(list_filter(" + PLAIN + ", lambda w: length(w) >= 4))"
WORDS = "list_filter(string_split_regex({}, '[ \\t\\n\\r\\f]+'), lambda x: x <> '')"
#: Sentences: RE2 has no lookbehind, so a sentinel marks the ends.
SENTENCES = "list_filter(list_transform(string_split(regexp_replace(trim({}), '([.!?])[ \\t\\n\\r\\f]+', '\\1' || chr(2), 'g'), chr(2)), lambda x: trim(x)), lambda x: x <> '')"
CLEAN = "trim(regexp_replace(replace(replace(replace({}, '@-@', '-'), '@.@', '.'), '@,@', ','), '[ \\t\\n\\r\\f]+', ' ', 'g'))"

#: Questions over the driver's documents, whose words are invented.
CORPUS_QUESTIONS = [
    (1, "the thing and the other thing that there is"),
    (2, "thing thing haed ened"),
    (3, "lower than ation edon"),
    (4, "que para ción los"),
    (5, "nothingmatchesthis"),
]

#: Names in the patterns below that stand for words of a document.
NAMES = ("Velan", "Harbor", "Orsk", "Tolle", "drought")
_WORD = "[A-Za-z]{4,12}"


def _named_sql(x: str) -> str:
    for i, name in enumerate(NAMES, 1):
        x = f"replace({x}, '{name}', 'Z{'bdfgh'[i - 1]}' || translate(lower(coalesce(w[{i}], '')), 'aeiou', 'zzzzz'))"
    return x


def _named(x: Column) -> Column:
    for i, name in enumerate(NAMES):
        word = F.translate(F.lower(F.coalesce(F.get("w", F.lit(i)), F.lit(""))), "aeiou", "zzzzz")
        x = F.replace(x, F.lit(name), F.concat(F.lit("Z" + "bdfgh"[i]), word))
    return x


def _depth(rows: Sequence[tuple], i: int) -> int | None:
    """How deep in lists the strings of a column are; None if it has none."""
    out = None
    for v in (r[i] for r in rows):
        d = 0
        while isinstance(v, list | tuple) and v:
            v, d = v[0], d + 1
        if isinstance(v, str):
            out = d
    return out


def of_documents(spark: SparkSession, sf_dir: str, rows: Sequence[tuple], schema: str) -> DataFrame:
    """One of the patterns for each document, by its id; its rows have the id in the first column, and words of the document for NAMES.

    The words lose their vowels, so that they say nothing to the rules. Patterns are rows with the same first value."""
    columns = [c.split()[0] for c in schema.split(", ")]
    keys = list(dict.fromkeys(r[0] for r in rows))
    patterns = frame(spark, [(keys.index(r[0]), *r[1:]) for r in rows], "_k long, " + schema.split(", ", 1)[1])
    d = table(spark, sf_dir, "documents").where("doc_id is not null").select("doc_id", F.regexp_extract_all("text", F.lit(_WORD), F.lit(0)).alias("w"))
    d = d.withColumn("_k", F.pmod("doc_id", F.lit(len(keys)))).join(F.broadcast(patterns), "_k")
    deep = lambda c, n: _named(c) if n == 0 else F.transform(c, lambda x: deep(x, n - 1))
    depth = {c: _depth(rows, i) for i, c in enumerate(columns) if i}
    return d.select(F.col("doc_id").alias(columns[0]), *((F.col(c) if n is None else deep(F.col(c), n)).alias(c) for c, n in depth.items()))


def of_documents_sql(rows: Sequence[tuple], columns: str, alias: str = "v") -> str:
    """The relation of ``of_documents``."""
    names = columns.split(", ")
    keys = list(dict.fromkeys(r[0] for r in rows))
    patterns = values([(keys.index(r[0]), *r[1:]) for r in rows], "_k, " + ", ".join(f'"{c}"' for c in names[1:]))

    def deep(x: str, n: int) -> str:
        return _named_sql(x) if n == 0 else f"list_transform({x}, lambda x{n}: {deep(f'x{n}', n - 1)})"

    out = [f'd.doc_id AS "{names[0]}"']
    for i, c in enumerate(names):
        if i:
            n = _depth(rows, i)
            out.append(f'{f"""v."{c}" """ if n is None else deep(f"""v."{c}" """, n)} AS "{c}"')
    words = f"SELECT doc_id, regexp_extract_all(text, '{_WORD}') AS w FROM documents WHERE doc_id IS NOT NULL"
    return f"(SELECT {', '.join(out)} FROM ({words}) d JOIN {patterns} ON d.doc_id % {len(keys)} = v._k) AS {alias}"
