"""Substring dedup: words covered by a window of L words that also starts elsewhere.

Difference-cover anchors: with a cover D modulo v, any two positions p and q have an offset o < v at which
both p + o and q + o lie in D modulo v. So windows of m = L - v + 1 words are hashed at cover positions
only, and every match of L words shares an aligned anchor. Anchors whose hash is unique end there. The others are extended: an
anchor's context is all windows of L words that hold it, up to v - 1 words to either side. Equal contexts match as a whole;
for the others the extension to the right and to the left is tested by rank pairs, and what may still match is ranked window by
window; ``repeats`` does these rounds.

Null and empty texts have no words. Repeated rows (same doc_id and text) are occurrences of each other and
get the same result. Extra columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import hashing as H
from . import repeats
from .runtime import dropped, keyed, on_executors, table, written

#: Perfect difference sets, by period.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18), 57: (0, 1, 3, 13, 32, 36, 43, 52)}


def period(length: int) -> int:
    """The longest period that leaves anchors of about two fifths of a window, so that they stay selective."""
    return max(v for v in COVERS if length - v + 1 >= 0.4 * length)


def batch_words(batch: pa.RecordBatch, i: int, j: int, off: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, ...]:
    """Rows i to j, their bytes joined by a space: buffer, word starts, ends, symbols, and each row's first word."""
    if j == i + 1:
        buffer, begins = data[off[i] : off[j]], np.zeros(1, np.int64)
    else:
        gaps = np.arange(j - i)
        buffer = np.insert(data[off[i] : off[j]], off[i + 1 : j] - off[i], 0x20)
        begins = off[i:j] - off[i] + gaps
    start, end, x = H.words_in_parts(buffer)
    return buffer, start, end, x, np.append(np.searchsorted(start, begins), len(start))


def _around(a: np.ndarray, row: np.ndarray, first: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last start of the windows that hold the anchors."""
    return np.maximum(a - (period(length) - 1), first[row]), np.minimum(a, first[row + 1] - length)


def cover_anchors(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Rows with text (binary) to ANCHORS: the windows of m words at the cover positions; rows of under L words have none."""
    v = period(length)
    m, cover = length - v + 1, np.array(COVERS[v])
    for batch in batches:
        off, data = repeats.binary_parts(batch.column("text"))
        k1, k2 = batch.column("k1").to_numpy(), batch.column("k2").to_numpy()
        for i, j in repeats.doc_ranges(off):
            _, _, _, x, first = batch_words(batch, i, j, off, data)
            n = np.where(np.diff(first) >= length, np.diff(first), 0)
            blocks = -(-n // v)
            row = np.repeat(np.arange(j - i), blocks * len(cover))
            number = np.arange(len(row)) - np.repeat(np.cumsum(blocks * len(cover)) - blocks * len(cover), blocks * len(cover))
            at = number // len(cover) * v + cover[number % len(cover)]
            fits = at + m <= n[row]
            a, row = at[fits] + first[row[fits]], row[fits]
            names = []
            for begin in range(0, len(x), repeats.CHUNK):
                own = slice(*np.searchsorted(a, (begin, begin + repeats.CHUNK)))
                lo, hi = max(0, begin - v), begin + repeats.CHUNK + length + v
                p0, p1 = _around(a[own], row[own], first, length)
                names.append(repeats.anchor_names(x[lo:hi], a[own] - lo, p0 - lo, p1 - lo, length, m))
            yield repeats.anchor_batch(k1[i:j], k2[i:j], names, np.bincount(row, minlength=j - i))


def word_contexts(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Rows with text and ``alive``, the numbers of their shared anchors, to their contexts."""
    v = period(length)
    m, cover = length - v + 1, np.array(COVERS[v])
    for batch in batches:
        off, data = repeats.binary_parts(batch.column("text"))
        k1, k2 = batch.column("k1").to_numpy(), batch.column("k2").to_numpy()
        for i, j in repeats.doc_ranges(off):
            _, _, _, x, first = batch_words(batch, i, j, off, data)
            row, number, same = repeats.alive_of(batch, i, j)
            a = number // len(cover) * v + cover[number % len(cover)] + first[row]
            for begin in range(0, len(x), repeats.CHUNK):
                own = slice(*np.searchsorted(a, (begin, begin + repeats.CHUNK)))
                lo, hi = max(0, begin - v), begin + repeats.CHUNK + length + v
                p0, p1 = _around(a[own], row[own], first, length)
                yield from repeats.context_batches(x[lo:hi], a[own] - lo, p0 - lo, p1 - lo, same[own], length, m, k1[row[own] + i], k2[row[own] + i], first[row[own]] - lo)


def word_blocks(batches: Iterator[pa.RecordBatch], length: int, size: int) -> Iterator[pa.RecordBatch]:
    """Rows with text (binary) and the runs wanted of them to repeats.BLOCKS."""
    for batch in batches:
        off, data = repeats.binary_parts(batch.column("text"))
        for i, j in repeats.doc_ranges(off):
            _, _, _, x, first = batch_words(batch, i, j, off, data)
            yield from repeats.block_ranks(batch, slice(i, j), lambda lo, hi, x=x: x[lo:hi], first, length, size)


def word_windows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Rows with text (binary) and the runs wanted of them to repeats.WINDOWS."""
    for batch in batches:
        off, data = repeats.binary_parts(batch.column("text"))
        for i, j in repeats.doc_ranges(off):
            _, _, _, x, first = batch_words(batch, i, j, off, data)
            yield from repeats.window_ranks(batch, slice(i, j), lambda lo, hi, x=x: x[lo:hi], first, length)


def repeated_spans(documents: DataFrame, length: int = 35) -> DataFrame:
    """k1, k2 (see ``runtime.keyed``) and the maximal repeated spans, in words; rows without any are left out."""
    m = length - period(length) + 1
    rows = keyed(documents).select("k1", "k2", F.col("text").cast("binary").alias("text"))
    rows = rows.where(F.octet_length("text") >= 2 * length - 1)
    alive = repeats.shared_anchors(written(rows.mapInArrow(on_executors("substring_dedup", "cover_anchors", length), repeats.ANCHORS), "anchors"))
    found = rows.join(alive.hint("merge"), ["k1", "k2"]).mapInArrow(on_executors("substring_dedup", "word_contexts", length), repeats.CONTEXT)
    found = written(found, "contexts")
    dropped(alive)

    def runs(wanted: DataFrame, blocks: bool) -> DataFrame:
        joined = rows.join(wanted.hint("merge"), ["k1", "k2"])
        if blocks:
            return joined.mapInArrow(on_executors("substring_dedup", "word_blocks", length, repeats.block_size(length, m)), repeats.BLOCKS)
        return joined.mapInArrow(on_executors("substring_dedup", "word_windows", length), repeats.WINDOWS)

    return repeats.repeated_spans(found, length, m, runs)


def words(text: Column) -> Column:
    """The words [^\\x20\\x09-\\x0D]+ of a text."""
    return F.array_remove(F.split(F.translate(text, "\t\n\x0b\x0c\r", "     "), " "), "")


def dedup_words(documents: DataFrame, length: int = 35) -> DataFrame:
    """doc_id, text, words, spans (in words) and the words outside spans (``kept``), one row for each input row."""
    rows = keyed(documents).join(repeated_spans(documents, length).hint("merge"), ["k1", "k2"], "left")
    rows = rows.withColumn("words", words(F.col("text")))
    ranges = repeats.kept_ranges(F.col("spans"), F.size("words"))
    kept = F.flatten(F.transform(ranges, lambda x: F.slice("words", x["s"] + 1, x["e"] - x["s"])))
    return rows.select("doc_id", "text", "words", "spans", F.when(F.col("spans").isNull(), F.col("words")).otherwise(kept).alias("kept"))


def op4_substring_dedup(spark, sf_dir: str) -> DataFrame:
    rows = dedup_words(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        repeats.removed(F.col("spans")).alias("n_removed"),
        F.sha2(F.array_join("kept", " ").cast("binary"), 256).alias("kept_sha256"),
    )


ORACLE = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '') AS w FROM documents),
w AS (SELECT r, i, md5(array_to_string(w[i:i + 34], chr(1))) AS h FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
twice AS (SELECT h FROM w GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS k FROM w JOIN twice USING (h)),
stays AS (SELECT r, k, x FROM (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS k FROM d) ANTI JOIN gone USING (r, k)),
kept AS (SELECT r, count(*) AS n, string_agg(x, ' ' ORDER BY k) AS t FROM stays GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)"""
