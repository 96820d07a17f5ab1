"""Exact repeats of L symbols (bytes or words) across all rows, by prefix doubling over anchored positions.

Every window of L symbols is given to anchors: positions inside it that its own symbols choose, so that equal windows have an
anchor at the same place. A context is an anchor with the run of window starts given to it. The rank of a position is the name of the K
symbols there. Rounds:

1. Spark groups the ranks of K symbols at all anchors. Contexts whose rank is unique end here; where all contexts of a rank are
   equal, all their windows repeat, and they end too.
2. The others become rows with 128-bit ranks. Those that are equal as a whole are copies: all their windows repeat. One of them goes on,
   with weight 2.
3. Doubling: at offset h = K, 2K, 4K, .. the rank of 2h symbols at a position is that of the pair (rank of h there, rank of h at
   the offset). Spark sorts and counts the new ranks to the right of each anchor and to its left. Where one is unique, no window that
   holds its 2h symbols repeats: the run of window starts is cut, and a context without any left has ended.
4. The window starts left are cut into blocks, by their place relative to the anchor. A block whose symbols all occur in another context
   repeats as a whole; one whose core, which all its windows have, is unique has none that repeats.
5. Past the threshold: the window starts of the other blocks are rows of their own, ranked at all L symbols by 128-bit names.

Ranks of rounds 1 and 3 and cores are 64 bits long. In rounds 3 and 4 a collision leaves a window to round 5 and changes no result; in
round 1 it would have to befall all contexts of a rank. Nothing is capped, rows are never paired, and a common rank is counted before it is shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import hashing as H
from .runtime import dropped, on_executors, written

#: Symbols handled at a time.
CHUNK = 1 << 18
_LOW = np.uint64((1 << 24) - 1)

#: The ranks and whole names of a row's contexts, in order.
ANCHORS = "k1 long, k2 long, names array<long>, wholes array<long>"
#: a: the anchor; p0, p1: first and last window start; n: the rank at the anchor; f: the name of the whole context; right, left: the
#: ranks of the K symbols at a, a + K, a + 2K, .. and at a, a - K, a - 2K, .., null where no window of the context holds them. Without n:
#: the windows p0 to p1 are known to repeat.
CONTEXT = "k1 long, k2 long, a int, p0 int, p1 int, n1 long, n2 long, f1 long, f2 long, right array<long>, left array<long>"
_KEYS = ["n1", "n2"]


def binary_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (int64) and bytes of a binary column without nulls."""
    _, at, data = column.buffers()
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    off = np.frombuffer(at, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return off, np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)


def doc_ranges(off: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``limit`` symbols each, or of one row."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
        yield i, j
        i = j


def doubling(length: int, k: int) -> list[int]:
    """The offsets h = k, 2k, 4k, .. of the rounds that rank 2h < length symbols."""
    return [k << i for i in range(length.bit_length()) if 2 * (k << i) < length]


def sampled(x: np.ndarray, off: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first and last window start of the contexts of the documents x[off[i]:off[i+1]].

    The anchor of a window is the leftmost of its smallest k-symbol names, so about 2 / (length - k) of all positions are anchors."""
    first, last = off[:-1], off[1:] - length
    long_enough = last >= first
    step = np.zeros(len(x) + 1, np.int32)
    np.add.at(step, first[long_enough], 1)
    np.add.at(step, last[long_enough] + 1, -1)
    p = np.flatnonzero(np.cumsum(step[: max(len(x) - length + 1, 0)]) > 0)
    if not len(p):
        return p, p, p
    name = H.Names(x, H.BASES[0]).windows(k)
    name &= ~_LOW
    name |= np.arange(len(name), dtype=np.uint64)
    anchor = (H.sliding_min(name, length - k + 1)[p] & _LOW).astype(np.int64)
    new = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (p[1:] != p[:-1] + 1))))
    return anchor[new], p[new], p[np.concatenate((new[1:], [len(p)])) - 1]


def _place(a: np.ndarray, p0: np.ndarray, p1: np.ndarray) -> np.ndarray:
    return H.mix((a - p0).astype(np.uint64) * np.uint64(1 << 32) + (p1 - p0).astype(np.uint64) + np.uint64(1))


def anchor_names(x: np.ndarray, a: np.ndarray, p0: np.ndarray, p1: np.ndarray, length: int, k: int) -> np.ndarray:
    """(2, n): the rank of each anchor and the name of its context."""
    one = H.Names(x, H.BASES[0])
    return np.stack((one.spans(a, a + k), one.spans(p0, p1 + length) ^ _place(a, p0, p1))).view(np.int64)


def anchor_batch(k1: np.ndarray, k2: np.ndarray, names: list[np.ndarray], counts: np.ndarray) -> pa.RecordBatch:
    at = pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32))
    both = np.concatenate(names, axis=1) if names else np.empty((2, 0), np.int64)
    return pa.RecordBatch.from_pydict({"k1": pa.array(k1), "k2": pa.array(k2)} | {c: pa.ListArray.from_arrays(at, pa.array(v)) for c, v in zip(("names", "wholes"), both, strict=True)})


def described(x: np.ndarray, a: np.ndarray, p0: np.ndarray, p1: np.ndarray, length: int, k: int) -> dict[str, pa.Array]:
    """The ranks and names of contexts in x, and the ranks at each multiple of k that rounds will pair."""
    one, two = H.Names(x, H.BASES[0]), H.Names(x, H.BASES[1])
    place = _place(a, p0, p1)
    cols = {"n1": one.spans(a, a + k), "n2": two.spans(a, a + k), "f1": one.spans(p0, p1 + length) ^ place, "f2": two.spans(p0, p1 + length) + place}
    out = {c: pa.array(v.view(np.int64)) for c, v in cols.items()}
    offsets = doubling(length, k)
    steps = 2 * offsets[-1] // k - 1 if offsets else 0
    at = pa.array(np.arange(len(a) + 1, dtype=np.int32) * steps)
    for side, sign in (("right", 1), ("left", -1)):
        begin = a[:, None] + sign * k * np.arange(1, steps + 1)
        held = (begin >= p0[:, None]) & (begin + k <= (p1 + length)[:, None])
        begin = np.where(held, begin, 0)
        ranks = np.where(held, one.spans(begin, np.where(held, begin + k, 0)), 0)
        out[side] = pa.ListArray.from_arrays(at, pa.array(ranks.ravel().view(np.int64), mask=~held.ravel()))
    return out


def context_batches(x: np.ndarray, a: np.ndarray, p0: np.ndarray, p1: np.ndarray, same: np.ndarray, length: int, k: int, k1: np.ndarray, k2: np.ndarray, base: np.ndarray) -> Iterator[pa.RecordBatch]:
    """CONTEXT rows of shared anchors in x, in order: runs of windows that are known to repeat, and the other contexts.

    ``base``: where each one's document begins in x, subtracted from positions."""
    known = np.flatnonzero(same)
    if len(known):
        end, b = p1[known] + length, base[known]
        first = np.flatnonzero(np.concatenate(([True], (b[1:] != b[:-1]) | (p0[known][1:] > end[:-1]))))
        last = np.concatenate((first[1:], [len(known)])) - 1
        s, e = known[first], known[last]
        cols = {"k1": k1[s], "k2": k2[s], "a": (p0[s] - base[s]).astype(np.int32), "p0": (p0[s] - base[s]).astype(np.int32), "p1": (p1[e] - base[s]).astype(np.int32)}
        none = {c: pa.nulls(len(s), pa.int64()) for c in ("n1", "n2", "f1", "f2")} | {c: pa.nulls(len(s), pa.list_(pa.int64())) for c in ("right", "left")}
        yield pa.RecordBatch.from_pydict({c: pa.array(v) for c, v in cols.items()} | none)
    other = np.flatnonzero(~same)
    if len(other):
        a, p0, p1, b = a[other], p0[other], p1[other], base[other]
        cols = {"k1": k1[other], "k2": k2[other]} | {c: (v - b).astype(np.int32) for c, v in (("a", a), ("p0", p0), ("p1", p1))}
        yield pa.RecordBatch.from_pydict({c: pa.array(v) for c, v in cols.items()} | described(x, a, p0, p1, length, k))


def alive_of(batch: pa.RecordBatch, i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row (from i), number and sameness of the shared anchors of rows i to j, in order."""
    alive = batch.column("alive")
    of = alive.offsets.to_numpy().astype(np.int64)
    flat = alive.flatten()
    part = slice(of[i] - of[0], of[j] - of[0])
    number, same = flat.field("number").to_numpy()[part], flat.field("same").to_numpy(zero_copy_only=False)[part]
    row = np.repeat(np.arange(j - i), np.diff(of[i : j + 1]))
    order = np.lexsort((number, row))
    return row[order], number[order].astype(np.int64), same[order]


def _byte_parts(off: np.ndarray, data: np.ndarray, i: int, j: int, length: int, k: int) -> Iterator[tuple]:
    """Of rows i to j: symbols, where the rows begin in them, and the contexts; very long rows go in overlapping parts."""
    lo, hi = off[i], off[j]
    for start in range(lo, hi, CHUNK) if j == i + 1 else (lo,):
        end = min(hi, start + CHUNK + length - 1) if j == i + 1 else hi
        x = H.BYTES[data[start:end]]
        part = np.clip(off[i : j + 1], start, end) - start
        a, p0, p1 = sampled(x, part, length, k)
        yield x, off[i : j + 1] - start, np.searchsorted(part, a, side="right") - 1, a, p0, p1


def byte_anchors(batches: Iterator[pa.RecordBatch], length: int, k: int) -> Iterator[pa.RecordBatch]:
    """Rows k1, k2, text (binary) to ANCHORS."""
    for batch in batches:
        off, data = binary_parts(batch.column("text"))
        k1, k2 = batch.column("k1").to_numpy(), batch.column("k2").to_numpy()
        for i, j in doc_ranges(off):
            names, counts = [], np.zeros(j - i, np.int64)
            for x, _, doc, a, p0, p1 in _byte_parts(off, data, i, j, length, k):
                if len(a):
                    names.append(anchor_names(x, a, p0, p1, length, k))
                    counts += np.bincount(doc, minlength=j - i)
            yield anchor_batch(k1[i:j], k2[i:j], names, counts)


def byte_contexts(batches: Iterator[pa.RecordBatch], length: int, k: int) -> Iterator[pa.RecordBatch]:
    """Rows with text (binary) and ``alive``, the numbers of their shared anchors, to CONTEXT."""
    for batch in batches:
        off, data = binary_parts(batch.column("text"))
        k1, k2 = batch.column("k1").to_numpy(), batch.column("k2").to_numpy()
        for i, j in doc_ranges(off):
            row, number, same = alive_of(batch, i, j)
            seen = np.zeros(j - i, np.int64)  # contexts of earlier parts
            for x, begin, doc, a, p0, p1 in _byte_parts(off, data, i, j, length, k):
                counts = np.bincount(doc, minlength=j - i)
                own = (number >= seen[row]) & (number < (seen + counts)[row])
                at = (np.cumsum(counts) - counts)[row[own]] + number[own] - seen[row[own]]
                d = doc[at] + i
                yield from context_batches(x, a[at], p0[at], p1[at], same[own], length, k, k1[d], k2[d], begin[doc[at]])
                seen += counts


def shared_anchors(anchors: DataFrame) -> DataFrame:
    """k1, k2, alive: the numbers of a row's anchors whose rank occurs elsewhere, and whether all contexts of the rank are equal; written.

    ``anchors``: written ANCHORS, dropped here."""
    each = anchors.select("k1", "k2", F.posexplode(F.arrays_zip("names", "wholes")).alias("number", "x")).select("k1", "k2", "number", F.col("x.names").alias("name"), F.col("x.wholes").alias("whole"))
    ranks = each.groupBy("name").agg(F.count("*").alias("times"), (F.min("whole") == F.max("whole")).alias("same")).where("times >= 2").drop("times")
    ranks = written(ranks, "ranks")  # written, for Spark splits a hot rank only where plain shuffles meet
    alive = each.select("k1", "k2", "number", "name").join(ranks.hint("merge"), "name")
    alive = written(alive.groupBy("k1", "k2").agg(F.collect_set(F.struct("number", "same")).alias("alive")), "alive")
    dropped(anchors, ranks)
    return alive


#: Runs of windows that lie in one block of window starts relative to the anchor: the name of the symbols that all windows of the block
#: have (core), and that of all its symbols, if the run is the whole block (h).
BLOCKS = "k1 long, k2 long, a int, q0 int, q1 int, weight int, core long, h1 long, h2 long"
#: The windows of a run, ranked.
WINDOWS = "ctx long, weight int, w1 array<long>, w2 array<long>"
_RUN = ("ctx", "a", "q0", "q1", "weight")


def _wanted(batch: pa.RecordBatch, rows: slice, x: Callable[[int, int], np.ndarray], first: np.ndarray, length: int) -> Iterator[tuple]:
    """The runs that ``wanted`` asks of some rows, in groups: row, ctx, anchor, first and last window start, weight, where symbols begin, symbols.

    ``x``: symbols of a range; ``first``: where each row's begin. A group has at most about CHUNK symbols and CHUNK windows."""
    wanted = batch.column("wanted")
    of = wanted.offsets.to_numpy().astype(np.int64)
    of -= of[0]
    part = slice(of[rows.start], of[rows.stop])
    ctx, a, q0, q1, weight = (wanted.flatten().field(c).to_numpy()[part].astype(np.int64) for c in _RUN)
    doc = np.repeat(np.arange(rows.start, rows.stop), np.diff(of[rows.start : rows.stop + 1]))
    begin = first[doc - rows.start]
    order = np.argsort(begin + q0, kind="stable")
    start = (begin + q0)[order]
    i = 0
    while i < len(order):
        j = max(i + 1, int(np.searchsorted(start, start[i] + CHUNK, side="right")))
        o = order[i : min(j, i + CHUNK // length + 1)]
        lo = start[i]
        yield doc[o], ctx[o], a[o], q0[o], q1[o], weight[o], begin[o] - lo, x(lo, int((begin + q1)[o].max()) + length)
        i += len(o)


def block_size(length: int, k: int) -> int:
    """Window starts of a block: as many as there are blocks in a context."""
    return math.isqrt(length - k + 1)


def block_ranks(batch: pa.RecordBatch, rows: slice, x: Callable[[int, int], np.ndarray], first: np.ndarray, length: int, size: int) -> Iterator[pa.RecordBatch]:
    """The runs that rows want, cut into BLOCKS."""
    for doc, _, a, q0, q1, weight, begin, symbols in _wanted(batch, rows, x, first, length):
        low, high = (a - q1) // size, (a - q0) // size
        n = high - low + 1
        r = np.repeat(np.arange(len(a)), n)
        block = low[r] + np.arange(len(r)) - np.repeat(np.cumsum(n) - n, n)
        least, most = block * size, (block + 1) * size - 1  # places before the anchor
        s, e = np.maximum(q0[r], a[r] - most), np.minimum(q1[r], a[r] - least)
        whole = (e - s + 1) == size
        at = (begin + a)[r]
        place = H.mix(block.astype(np.uint64) + np.uint64(1))
        one, two = H.Names(symbols, H.BASES[0]), H.Names(symbols, H.BASES[1])
        core = one.spans(at - least, at - most + length) ^ place
        f, t = np.where(whole, at - most, 0), np.where(whole, at - least + length, 0)
        h1, h2 = one.spans(f, t) ^ place, two.spans(f, t) + place
        cols = {c: batch.column(c).take(pa.array(doc[r])) for c in ("k1", "k2")} | {c: pa.array(v.astype(np.int32)) for c, v in (("a", a[r]), ("q0", s), ("q1", e), ("weight", weight[r]))}
        yield pa.RecordBatch.from_pydict(cols | {"core": pa.array(core.view(np.int64))} | {c: pa.array(h.view(np.int64), mask=~whole) for c, h in (("h1", h1), ("h2", h2))})


def window_ranks(batch: pa.RecordBatch, rows: slice, x: Callable[[int, int], np.ndarray], first: np.ndarray, length: int) -> Iterator[pa.RecordBatch]:
    """The windows of the runs that rows want. The place of the window relative to its anchor is part of the rank."""
    for _, ctx, a, q0, q1, weight, begin, symbols in _wanted(batch, rows, x, first, length):
        n = q1 - q0 + 1
        ends = np.cumsum(n)
        r = np.repeat(np.arange(len(a)), n)
        at = (begin + q0)[r] + np.arange(len(r)) - (ends - n)[r]
        place = H.mix(((begin + a)[r] - at + 1).astype(np.uint64))
        w1 = H.Names(symbols, H.BASES[0]).spans(at, at + length) ^ place
        w2 = H.Names(symbols, H.BASES[1]).spans(at, at + length) + place
        lists = pa.array(np.concatenate(([0], ends)).astype(np.int32))
        cols = {"ctx": pa.array(ctx), "weight": pa.array(weight.astype(np.int32))}
        yield pa.RecordBatch.from_pydict(cols | {c: pa.ListArray.from_arrays(lists, pa.array(w.view(np.int64))) for c, w in (("w1", w1), ("w2", w2))})


def byte_blocks(batches: Iterator[pa.RecordBatch], length: int, size: int) -> Iterator[pa.RecordBatch]:
    """Rows with text (binary) and the runs wanted of them to BLOCKS."""
    for batch in batches:
        off, data = binary_parts(batch.column("text"))
        for i, j in doc_ranges(off):
            yield from block_ranks(batch, slice(i, j), lambda lo, hi, d=data[off[i] : off[j]]: H.BYTES[d[lo:hi]], off[i : j + 1] - off[i], length, size)


def byte_windows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Rows with text (binary) and the runs wanted of them to WINDOWS."""
    for batch in batches:
        off, data = binary_parts(batch.column("text"))
        for i, j in doc_ranges(off):
            yield from window_ranks(batch, slice(i, j), lambda lo, hi, d=data[off[i] : off[j]]: H.BYTES[d[lo:hi]], off[i : j + 1] - off[i], length)


def _pairs(ranks: Column, turned: bool) -> Column:
    """Ranks of h symbols at multiples of h to the ranks of 2h at multiples of 2h; null where one is null."""

    def pair(i: Column) -> Column:
        x, y = F.get(ranks, 2 * i), F.get(ranks, 2 * i + 1)
        return F.when(x.isNotNull() & y.isNotNull(), F.xxhash64(y, x) if turned else F.xxhash64(x, y))

    return F.transform(F.sequence(F.lit(0), F.floor(F.size(ranks) / 2).cast("int") - 1), pair)


def _reranked(rows: DataFrame, h: int, k: int, length: int) -> DataFrame:
    """One round: ranks of 2h on both sides of the anchors; runs are cut where one is unique, empty ones end."""
    rows = written(rows.withColumn("right", _pairs(F.col("right"), False)).withColumn("left", _pairs(F.col("left"), True)), "pairs")
    for side in ("right", "left"):
        rank = F.get(side, F.lit(0))
        times = rows.select(*_KEYS, rank.alias("rank"), "weight").where("rank is not null").groupBy(*_KEYS, "rank").agg(F.sum("weight").alias("times"))
        twice = written(times.where("times >= 2").select(*_KEYS, "rank", F.lit(True).alias("twice")), "ranks")
        marked = rows.withColumn("rank", rank).join(twice.hint("merge"), [*_KEYS, "rank"], "left")
        unique = F.col("rank").isNotNull() & F.col("twice").isNull()
        if side == "right":  # windows that hold a .. a + 2h start at a + 2h - length or later
            marked = marked.withColumn("q1", F.when(unique, F.least("q1", F.col("a") + (2 * h - length - 1))).otherwise(F.col("q1")))
        else:  # and those that hold a + k - 2h .. a + k there or earlier
            marked = marked.withColumn("q0", F.when(unique, F.greatest("q0", F.col("a") + (k - 2 * h + 1))).otherwise(F.col("q0")))
        done = written(marked.select(*rows.columns).where("q0 <= q1"), "cut")
        dropped(rows, twice)
        rows = done
    return rows


def repeated_spans(found: DataFrame, length: int, k: int, runs: Callable[[DataFrame, bool], DataFrame]) -> DataFrame:
    """The maximal runs covered by repeated windows (k1, k2, spans). ``found``: written CONTEXT rows, dropped here; ``runs``: of the runs
    that rows k1, k2 want, the BLOCKS, or else the WINDOWS."""
    mixed = found.where("n1 is not null")
    place = F.struct("k1", "k2", "a", "p0", "p1", "right", "left")
    rows = mixed.groupBy(*_KEYS, "f1", "f2").agg(F.count("*").alias("times"), F.min(place).alias("x"))
    rows = written(rows.select(*_KEYS, "f1", "f2", F.least("times", F.lit(2)).cast("int").alias("weight"), "x.*"), "copies")
    copied = mixed.select(*_KEYS, "f1", "f2", "k1", "k2", "p0", "p1").join(rows.where("weight = 2").select(*_KEYS, "f1", "f2").hint("merge"), [*_KEYS, "f1", "f2"], "left_semi")
    settled = found.where("n1 is null").select("k1", "k2", "p0", "p1").unionByName(copied.select("k1", "k2", "p0", "p1"))
    settled = written(settled.select("k1", "k2", F.col("p0").alias("s"), (F.col("p1") + length).alias("e")), "settled")
    dropped(found)

    first = lambda side: F.concat(F.array("n1"), side).alias(side)
    left = written(rows.select(*_KEYS, "k1", "k2", "weight", "a", F.col("p0").alias("q0"), F.col("p1").alias("q1"), first("right"), first("left")), "round")
    dropped(rows)
    for h in doubling(length, k):
        left = _reranked(left, h, k, length)
    sizes = written(left.groupBy(*_KEYS).agg(F.count("*").alias("n"), F.min("weight").alias("least")).where("n >= 2 and least = 1").select(*_KEYS), "sizes")
    wanted = left.select(*_KEYS, "k1", "k2", "a", "q0", "q1", "weight").join(sizes.hint("merge"), _KEYS).drop(*_KEYS)
    wanted = written(wanted.withColumn("ctx", F.lit(0).cast("long")), "wanted")
    dropped(left, sizes)

    asked = lambda df: df.groupBy("k1", "k2").agg(F.collect_list(F.struct(*_RUN)).alias("wanted"))
    blocks = written(runs(asked(wanted), True), "blocks")
    whole = blocks.where("h1 is not null").groupBy("h1", "h2").agg(F.sum("weight").alias("times")).where("times >= 2").select("h1", "h2", F.lit(True).alias("repeats"))
    whole = written(whole, "whole")
    marked = written(blocks.join(whole.hint("merge"), ["h1", "h2"], "left").drop("h1", "h2"), "marked")
    dropped(wanted, blocks, whole)
    is_open = (F.col("weight") == 1) & F.col("repeats").isNull()
    cores = marked.groupBy("core").agg(F.sum("weight").alias("times"), F.max(is_open).alias("open")).where("times >= 2 and open").select("core")
    cores = written(cores, "cores")
    wanted = written(marked.join(cores.hint("merge"), "core", "left_semi").drop("core", "repeats").withColumn("ctx", F.monotonically_increasing_id()), "wanted")
    repeated = marked.where("repeats and weight = 1").select("k1", "k2", F.col("q0").alias("s"), (F.col("q1") + length).alias("e"))

    ranked = written(runs(asked(wanted), False), "windows")
    each = ranked.select("ctx", "weight", F.posexplode(F.arrays_zip("w1", "w2")).alias("i", "w")).select("ctx", "weight", "i", "w.w1", "w.w2")
    again = written(each.groupBy("w1", "w2").agg(F.sum("weight").alias("times")).where("times >= 2").select("w1", "w2"), "repeated")
    hits = each.where("weight = 1").select("ctx", "i", "w1", "w2").join(again.hint("merge"), ["w1", "w2"], "left_semi")
    hits = hits.groupBy("ctx").agg(F.sort_array(F.collect_set("i")).alias("hit"))  # of one run, so at most a block
    starts = F.filter("hit", lambda x, i: (i == 0) | (F.get("hit", i - 1) < x - 1))
    ends = F.filter("hit", lambda x, i: (i == F.size("hit") - 1) | (F.get("hit", i + 1) > x + 1))
    hits = hits.select("ctx", F.explode(F.arrays_zip(starts.alias("s"), ends.alias("e"))).alias("r"))
    single = wanted.join(hits.hint("merge"), "ctx").select("k1", "k2", (F.col("q0") + F.col("r.s")).alias("s"), (F.col("q0") + F.col("r.e") + length).alias("e"))
    single = written(single, "runs")
    dropped(wanted, ranked, again, cores)
    out = written(spans(settled.unionByName(repeated).unionByName(single)), "spans")
    dropped(settled, marked, single)
    return out


def spans(runs: DataFrame) -> DataFrame:
    """The maximal runs of each row, in order: k1, k2, spans array<struct<s, e>>."""
    runs = runs.groupBy("k1", "k2", "s").agg(F.max("e").alias("e"))
    by = Window.partitionBy("k1", "k2").orderBy("s")
    before = F.max("e").over(by.rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select("*", F.when(F.col("s") <= before, 0).otherwise(1).alias("new"))
    runs = runs.select("*", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)).alias("run"))
    runs = runs.groupBy("k1", "k2", "run").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    return runs.groupBy("k1", "k2").agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("spans"))


def removed(found: Column) -> Column:
    """Symbols in spans; none for null."""
    return F.coalesce(F.aggregate(found, F.lit(0).cast("long"), lambda n, x: n + (x["e"] - x["s"])), F.lit(0).cast("long"))


def kept_ranges(found: Column, n: Column) -> Column:
    """What lies between spans (null: none) of a row of n symbols: array<struct<s, e>>, with empty ranges left out."""
    begin = F.concat(F.array(F.lit(0)), F.coalesce(F.transform(found, lambda x: x["e"]), F.array().cast("array<int>")))
    end = F.concat(F.coalesce(F.transform(found, lambda x: x["s"]), F.array().cast("array<int>")), F.array(n.cast("int")))
    return F.filter(F.zip_with(begin, end, lambda s, e: F.struct(s.alias("s"), e.alias("e"))), lambda x: x["s"] < x["e"])
