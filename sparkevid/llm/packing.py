"""Best-fit packing of documents into sequences, after Martello-Toth dominance reduction.

Only the histogram of piece lengths (at most ``capacity`` rows, so of proven size) comes to the driver. There
sets that provably dominate every alternative are fixed with their multiplicity, the instance shrinks, and
best-fit decreasing packs the rest, all by length and count. The plan is again bounded by the
capacity; Spark numbers the pieces of each length in salted groups and looks up their places.

Null and empty texts are one piece of one token (the end id). Repeated rows are packed each for itself.
Extra columns of the input are not read. An empty table gives no rows.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import on_executors, table, written

#: Rows that are numbered together.
GROUP = 2048
#: Groups of a length at most.
MOST = 1 << 16
_encoders: dict[str, object] = {}


class ByteBpe:
    """Ids as the tokenizers library gives them for a byte-level BPE file, by tiktoken's faster core.

    Used where the file is plain: ranks in id order, no normaliser, added tokens taken literally. Otherwise, and
    for a text that the core refuses, the tokenizers library itself is asked."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges, added = spec["model"]["vocab"], spec["model"]["merges"], spec["added_tokens"]
        pair = lambda x: x.split(" ") if isinstance(x, str) else x
        ordered = [vocab["".join(pair(x))] for x in merges]
        self.added = {x["content"]: x["id"] for x in added}
        plain = spec["normalizer"] is None and ordered == sorted(ordered) and not any(x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"] for x in added)
        self.core = None
        if plain and len(self.added) <= 1:
            shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
            byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
            ranks = {bytes(map(byte_of.__getitem__, t)): i for t, i in vocab.items() if t not in self.added}
            self.core = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> list[int]:
        if self.core is None:
            return self.library.encode(text, add_special_tokens=False).ids
        try:
            for content, number in self.added.items():
                if content in text:
                    ids: list[int] = []
                    for i, part in enumerate(text.split(content)):
                        ids += [number] * (i > 0) + self.core.encode_ordinary(part)
                    return ids
            return self.core.encode_ordinary(text)
        except BaseException as error:  # the core's panics are no Exceptions
            if isinstance(error, KeyboardInterrupt | SystemExit | MemoryError):
                raise
            return self.library.encode(text, add_special_tokens=False).ids


def encoder(path: str) -> ByteBpe:
    if path not in _encoders:
        _encoders[path] = ByteBpe(path)
    return _encoders[path]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: all of ``capacity`` but the first, which may be shorter."""
    first = n if n <= capacity else n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


PIECE = "doc_id long, piece int, start long, length int, ids_crc32 long"


def token_pieces(batches: Iterator[pa.RecordBatch], path: str, end_id: int, capacity: int) -> Iterator[pa.RecordBatch]:
    encode = encoder(path)
    for batch in batches:
        for lo in range(0, batch.num_rows, 1000):
            part = batch.slice(lo, 1000)
            out: list[tuple] = []
            for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text"), strict=True):
                ids = np.array([*encode(text.as_py() or ""), end_id], "<u4")
                out += [(doc, i, s, n, zlib.crc32(ids[s : s + n].tobytes())) for i, (s, n) in enumerate(cut(len(ids), capacity))]
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64())
            names = [c.split()[0] for c in PIECE.split(", ")]
            yield pa.RecordBatch.from_pydict({c: pa.array(v, k) for c, v, k in zip(names, zip(*out, strict=True), kinds, strict=True)})


Pattern = tuple[int, ...]


def dominating(counts: dict[int, int], capacity: int, j: int) -> Pattern | None:
    """A set with j that dominates all other feasible sets with j (Martello and Toth's criterion), if one is found.

    A set dominates another if the other's items can be put, as a partition, into its items. So only sets of
    at most two further items need a look, once three further ones cannot fit."""
    left = dict(counts)
    left[j] -= 1
    sizes = sorted(s for s, n in left.items() if n > 0)
    room = capacity - j
    if not sizes or sizes[0] > room:
        return (j,)
    least: list[int] = []
    for s in sizes:
        least += [s] * min(3 - len(least), left[s])
        if len(least) == 3:
            break
    largest = sizes[bisect_left(sizes, room + 1) - 1]
    if largest == room or len(least) < 2 or least[0] + least[1] > room:
        return (j, largest)
    if len(least) == 3 and sum(least) <= room:
        return None
    best, lo, hi = (0, 0, 0), 0, bisect_left(sizes, room + 1) - 1  # at most two further items fit
    while lo <= hi:
        a, b = sizes[hi], sizes[lo]
        if a + b > room or (lo == hi and left[a] < 2):
            hi -= 1
            continue
        best = max(best, (a + b, a, b))
        lo += 1
    if largest >= best[0]:
        return (j, largest)
    rest = dict(left)
    rest[largest] -= 1
    partner = max((s for s in sizes if rest[s] > 0 and s <= room - largest), default=0)
    above = [s for s in sizes if s > partner]  # a pair that fits and has both above the partner would not be dominated
    two = above[:1] * 2 if above and left[above[0]] > 1 else above[:2]
    if partner and (len(two) < 2 or sum(two) > room):
        return (j, largest, partner)
    return None


def reduce_instance(counts: dict[int, int], capacity: int) -> tuple[list[tuple[Pattern, int]], dict[int, int]]:
    """Fixed sets with their multiplicity, and what is left of the counts."""
    left = {s: n for s, n in counts.items() if n > 0}
    fixed: list[tuple[Pattern, int]] = []
    changed = True
    while changed:
        changed = False
        for j in sorted(left, reverse=True):
            while left.get(j, 0) > 0 and (found := dominating(left, capacity, j)):
                times = min(left[s] // found.count(s) for s in found)
                fixed.append((tuple(sorted(found, reverse=True)), times))
                for s in found:
                    left[s] -= times
                changed = True
        left = {s: n for s, n in left.items() if n > 0}
    return fixed, left


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing by length and count: bins in the same state are handled at once."""
    open_bins: dict[int, list[tuple[Pattern, int]]] = {}
    rooms: list[int] = []

    def put(room: int, pattern: Pattern, times: int) -> None:
        if times:
            if room not in open_bins:
                open_bins[room] = []
                insort(rooms, room)
            open_bins[room].append((pattern, times))

    for s in sorted(counts, reverse=True):
        n = counts[s]
        while n:
            i = bisect_left(rooms, s)
            if i == len(rooms):
                each = capacity // s
                put(capacity - each * s, (s,) * each, n // each)
                put(capacity - n % each * s, (s,) * (n % each), int(n % each > 0))
                break
            room = rooms[i]
            pattern, times = open_bins[room].pop()
            if not open_bins[room]:
                del open_bins[room], rooms[i]
            each = room // s
            full = min(times, n // each)
            put(room - each * s, pattern + (s,) * each, full)
            n -= full * each
            rest = times - full
            if rest and 0 < n < each:
                put(room - n * s, pattern + (s,) * n, 1)
                n, rest = 0, rest - 1
            put(room, pattern, rest)
    return [x for bins in open_bins.values() for x in bins]


def plan(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    fixed, left = reduce_instance(counts, capacity)
    return fixed + best_fit(left, capacity)


def places(patterns: list[tuple[Pattern, int]]) -> list[tuple[int, list[tuple[int, int, int, int, int]]]]:
    """By length: (lo, hi, first sequence, pieces a sequence, offset); numbers lo to hi of a length have their places there."""
    out: dict[int, list[tuple[int, int, int, int, int]]] = {}
    sequence = 0
    for pattern, times in patterns:
        offset = 0
        for s in sorted(set(pattern), reverse=True):
            each = pattern.count(s)
            lo = out[s][-1][1] if out.get(s) else 0
            out.setdefault(s, []).append((lo, lo + times * each, sequence, each, offset))
            offset += each * s
        sequence += times
    return list(out.items())


def numbered(pieces: DataFrame, histogram: dict[int, int]) -> DataFrame:
    """Adds ``number``, dense from 0 within each length. A length with many pieces is dealt by row to groups of about GROUP, to MOST groups
    at most, so that neither a group nor the list of a length's groups outgrows a task. Needs rid, a number of the row."""
    spark = pieces.sparkSession
    groups = spark.createDataFrame([(s, min(-(-n // GROUP), MOST)) for s, n in histogram.items()], "length int, groups int")
    dealt = pieces.join(F.broadcast(groups), "length").withColumn("salt", F.expr("pmod(xxhash64(rid), groups)")).drop("groups")
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("length", "salt").agg(F.count("*").alias("n"))
    sizes = sizes.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "salt").orderBy("rid"))
    return dealt.withColumn("own", own).join(sizes, ["length", "salt"]).withColumn("number", F.col("before") + F.col("own") - 1).drop("salt", "own", "before", "rid")


def pack(documents: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """Pieces of all documents with their place: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = documents.sparkSession
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces = rows.mapInArrow(on_executors("packing", "token_pieces", tokenizer, end_id, capacity), PIECE)
    pieces = written(pieces.withColumn("rid", F.monotonically_increasing_id()), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    schema = "length int, places array<struct<lo: long, hi: long, sequence: long, each: int, offset: int>>"
    at = spark.createDataFrame(places(plan(histogram, capacity)), schema)
    placed = numbered(pieces, histogram).join(F.broadcast(at), "length")
    placed = placed.withColumn("p", F.filter("places", lambda x: (x["lo"] <= F.col("number")) & (F.col("number") < x["hi"]))[0])
    within = F.col("number") - F.col("p.lo")
    return placed.select(
        "doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32",
        (F.col("p.sequence") + F.floor(within / F.col("p.each"))).cast("long").alias("sequence_id"),
        (F.col("p.offset") + within % F.col("p.each") * F.col("length")).cast("long").alias("offset"),
    )


def op1_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
