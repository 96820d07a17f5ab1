"""Suffix-array dedup: bytes covered by a string of L bytes that also starts elsewhere.

Distributed prefix doubling, in part: sampled positions have the rank of the L / 4 bytes there; Spark sorts and reranks the rank pairs at
offset L / 4 once, and positions whose ranks are unique end. What is left is decided past that round, by blocks of window starts and then by
ranks of all L bytes; see ``repeats``. The order of all suffixes would be many times the input, so the positions below the threshold are
sampled; the result is exact.

Null and empty texts have no bytes and lose none. Repeated rows (same doc_id and text) are occurrences of each
other and get the same result. Extra columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import repeats
from .runtime import dropped, keyed, on_executors, written

#: The first rank covers this part of the threshold.
FIRST = 4


def repeated_spans(documents: DataFrame, length: int = 400) -> DataFrame:
    """k1, k2 (see ``runtime.keyed``) and the maximal repeated byte spans; rows without any are left out. ``length``: 16 or more."""
    k = -(-length // FIRST)
    rows = keyed(documents).select("k1", "k2", F.col("text").cast("binary").alias("text")).where(F.octet_length("text") >= length)
    alive = repeats.shared_anchors(written(rows.mapInArrow(on_executors("repeats", "byte_anchors", length, k), repeats.ANCHORS), "anchors"))
    found = written(rows.join(alive.hint("merge"), ["k1", "k2"]).mapInArrow(on_executors("repeats", "byte_contexts", length, k), repeats.CONTEXT), "contexts")
    dropped(alive)

    def runs(wanted: DataFrame, blocks: bool) -> DataFrame:
        # A repeated row comes twice, but its contexts have weight 2, and of those a further one changes nothing.
        joined = rows.join(wanted.hint("merge"), ["k1", "k2"])
        if blocks:
            return joined.mapInArrow(on_executors("repeats", "byte_blocks", length, repeats.block_size(length, k)), repeats.BLOCKS)
        return joined.mapInArrow(on_executors("repeats", "byte_windows", length), repeats.WINDOWS)

    return repeats.repeated_spans(found, length, k, runs)


def _joined(text: Column, ranges: Column) -> Column:
    return F.array_join(F.transform(ranges, lambda x: F.substring(text, x["s"] + 1, x["e"] - x["s"]).cast("string")), "").cast("binary")


def dedup_bytes(documents: DataFrame, length: int = 400) -> DataFrame:
    """doc_id, text, spans and the bytes outside spans (``kept`` binary), one row for each input row."""
    rows = keyed(documents).join(repeated_spans(documents, length).hint("merge"), ["k1", "k2"], "left")
    data = F.col("text").cast("binary")
    kept = F.when(F.col("spans").isNull(), data).otherwise(_joined(data, repeats.kept_ranges(F.col("spans"), F.octet_length("text"))))
    return rows.select("doc_id", "text", "spans", kept.alias("kept"))


def dedup_texts(documents: DataFrame, length: int = 400) -> DataFrame:
    """The documents (all columns) with repeated spans taken out; a character that a span cuts stays whole.

    Other columns are kept; n_chars, where there is one, is counted anew."""
    text, doc = F.coalesce("text", F.lit("")), F.col("doc_id").cast("long")
    rows = documents.select(F.struct(*documents.columns).alias("row"), text.alias("text"), F.coalesce(doc, F.lit(-1)).alias("k1"), F.xxhash64(text, doc.isNull()).alias("k2"))
    rows = rows.join(repeated_spans(documents, length).hint("merge"), ["k1", "k2"], "left")
    data = F.col("text").cast("binary")

    def inside(at: Column) -> Column:
        return F.hex(F.substring(data, at + 1, F.lit(1))).rlike("^[89AB]")

    def whole(x: Column) -> Column:
        s, e = x["s"], x["e"]
        s = F.when(~inside(s), s).when(~inside(s + 1), s + 1).when(~inside(s + 2), s + 2).otherwise(s + 3)
        e = F.when(~inside(e), e).when(~inside(e - 1), e - 1).when(~inside(e - 2), e - 2).otherwise(e - 3)
        return F.struct(s.alias("s"), e.alias("e"))

    kept = _joined(data, repeats.kept_ranges(F.transform("spans", whole), F.octet_length("text"))).cast("string")
    rows = rows.select("row", F.col("spans").isNotNull().alias("cut"), F.when(F.col("spans").isNotNull(), kept).alias("kept"))
    out = {c: F.col("row")[c] for c in documents.columns}
    out["text"] = F.when(F.col("cut"), F.col("kept")).otherwise(out["text"])
    if "n_chars" in out:
        out["n_chars"] = F.when(F.col("cut"), F.length("kept").cast(documents.schema["n_chars"].dataType)).otherwise(out["n_chars"])
    return rows.select(*(v.alias(c) for c, v in out.items()))


def op2_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    from .runtime import table

    rows = dedup_bytes(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id",
        F.octet_length("text").cast("long").alias("n_bytes"),
        repeats.removed(F.col("spans")).alias("n_removed"),
        F.coalesce(F.size("spans"), F.lit(0)).cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
