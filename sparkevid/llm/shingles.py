"""Sets of word shingles and their Jaccard similarity: what SimHash links are verified by, and the links it cannot see.

Texts become sets of hashed shingles; equal sets are one node. Under any total order of shingles, two sets of similarity s or more
share one of the first n - ceil(s n) + 1 of each, and the first shingle they share has a place that lets them overlap enough. So
these shingles are keys by which no pair is missed. The order puts the ones frequent in a sample last, which decides about speed only.

The members of a key are first paired with its least member; that joins large groups of copies. Then all members of a key are
paired that are not in one component yet: at once if these pairs are few, as their counts tell, and else in rounds. A round pairs some
members, the centres, with all others, and then they are done with; what they joined is paired no more, so a group of near copies takes many
fewer pairs than its square, and no link is lost: the last round takes all that is left. Pairs pass a sketch (the parity of shingles in each of 512 bits or more: sets differ in at least as
many shingles as sketches in bits; larger sets have more bits, of which two halves fold into one) before their texts are met and compared.

Keys are taken out of the sets once. What is paired later is what is left of them, and a link is handed on once, as one between groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components, merged
from .hashing import majority, mix
from .runtime import dropped, on_executors, written

#: One of so many texts is sampled for the order; count there, and number, of the shingles that come last.
SAMPLE, OFTEN, LAST = 16, 4, 200_000
#: Places of sets, by a hash, among which centres are taken in order; pairs a member above which centres are taken in rounds; pairs a member in a round.
SPACE, MANY, FEW = 1 << 20, 16, 4
#: Longs of a sketch at least.
WORDS = 8
_BASE = np.uint64(0x9E3779B97F4A7C15)
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def words(text: bytes) -> list[bytes]:
    """The words [^\\x20\\x09-\\x0D]+ of a text, A-Z in lower case."""
    return text.translate(_LOWER).split()


def shingles(text: bytes, size: int) -> np.ndarray:
    """The sorted, distinct hashes of the word shingles; a shorter text is one shingle."""
    own = words(text)
    w = np.fromiter(map(xxhash.xxh64_intdigest, own), np.uint64, len(own))
    size = min(size, len(w))
    h = np.full(max(len(w) - size + 1, 1) if size else 1, size, np.uint64)
    for k in range(size):
        h = h * _BASE + w[k : len(w) - size + 1 + k]
    return np.unique(mix(h))


def sampled(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            parts = [shingles(x.as_py() or b"", size) for x in batch.column("text").slice(lo, 256)]
            yield pa.RecordBatch.from_pydict({"key": pa.array(np.concatenate(parts).view(np.int64))})


def prefix(s: np.ndarray, last: np.ndarray, rank: np.ndarray, similarity: tuple[int, int]) -> np.ndarray:
    """The first shingles of a set, those of ``last`` (sorted, with ranks) behind the others."""
    n = len(s) - -(-similarity[0] * len(s) // similarity[1]) + 1
    if len(last):
        at = np.minimum(np.searchsorted(last, s), len(last) - 1)
        s = s[np.argsort(np.where(last[at] == s, rank[at], -1), kind="stable")]
    return s[:n]


def sketch_of(s: np.ndarray) -> np.ndarray:
    """The parities of a set's shingles in as many bits as it has shingles, or up to twice as many; in 64 WORDS at least."""
    bits = max(64 * WORDS, 1 << (len(s) - 1).bit_length())
    odd = np.bincount((s >> np.uint64(8) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def differing(x: Column, y: Column) -> Column:
    """Bits in which two sketches differ, of which one may be twice as long as the other: so sets of which one has half the shingles of the other or more."""
    fold = lambda a, b: F.when(F.size(a) > F.size(b), F.zip_with(F.slice(a, F.lit(1), F.size(b)), F.slice(a, F.size(b) + 1, F.size(b)), lambda v, w: v.bitwiseXOR(w))).otherwise(a)
    return F.aggregate(F.zip_with(fold(x, y), fold(y, x), lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda s, b: s + b)


def described(batches: Iterator[pa.RecordBatch], size: int, similarity: tuple[int, int], often: bytes) -> Iterator[pa.RecordBatch]:
    """Rows with text (binary) to rows with fp (the set's name), sim (its SimHash), n, sketch and keys as well. ``often`` in falling
    order of frequency."""
    often = np.frombuffer(often, np.uint64)
    by = np.argsort(often)
    last, rank = often[by], len(often) - 1 - by
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            fp, sim, n, sketch, keys = [], [], [], [], []
            for x in part.column("text"):
                s = shingles(x.as_py() or b"", size)
                fp.append(xxhash.xxh64_intdigest(s.tobytes()))
                sim.append(majority([s]))
                n.append(len(s))
                sketch.append(sketch_of(s))
                keys.append(prefix(s, last, rank, similarity).view(np.int64))
            cols = {c: part.column(c) for c in part.schema.names}
            lists = {k: pa.ListArray.from_arrays(np.cumsum([0, *map(len, v)]).astype(np.int32), pa.array(np.concatenate(v))) for k, v in (("sketch", sketch), ("keys", keys))}
            yield pa.RecordBatch.from_pydict(cols | {k: pa.array(np.array(v, np.uint64).view(np.int64)) for k, v in (("fp", fp), ("sim", sim))} | {"n": pa.array(n, pa.int64())} | lists)


def verified(batches: Iterator[pa.RecordBatch], size: int, similarity: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """Pairs x, y with their texts to those that are near copies."""
    for batch in batches:
        near = []
        for a, b in zip(batch.column("a"), batch.column("b"), strict=True):
            s, t = shingles(a.as_py() or b"", size), shingles(b.as_py() or b"", size)
            common = len(np.intersect1d(s, t, assume_unique=True))
            near.append(similarity[1] * common >= similarity[0] * (len(s) + len(t) - common))
        yield pa.RecordBatch.from_pydict({c: batch.column(c).filter(pa.array(near, pa.bool_())) for c in ("x", "y")})


def confirmed(pairs: DataFrame, sets: DataFrame, texts: DataFrame, size: int, similarity: tuple[int, int]) -> DataFrame:
    """Of the pairs x, y those that are near copies."""

    def beside(df: DataFrame, of: DataFrame, at: str, *columns: str) -> DataFrame:
        return df.join(of.select(F.col("fp").alias(at), *(F.col(c).alias(f"{c}_{at}") for c in columns)).hint("merge"), at)

    p, q = similarity
    sized = q * F.least("n_x", "n_y") >= p * F.greatest("n_x", "n_y")  # so their sketches are of one length or two that follow
    alike = differing(F.col("sketch_x"), F.col("sketch_y")) * (p + q) <= (F.col("n_x") + F.col("n_y")) * (q - p)
    few = beside(beside(pairs, sets, "x", "n", "sketch"), sets, "y", "n", "sketch").where(F.when(sized, alike).otherwise(False))
    few = written(few.select("x", "y"), "near_pairs")
    if few.isEmpty():
        return few
    asked = few.select(F.col("x").alias("fp")).union(few.select(F.col("y").alias("fp"))).distinct()
    of = written(texts.join(asked, "fp", "left_semi").groupBy("fp").agg(F.min("text").alias("text")), "near_texts")
    met = beside(beside(few, of, "x", "text"), of, "y", "text").select("x", "y", F.col("text_x").alias("a"), F.col("text_y").alias("b"))
    out = written(met.mapInArrow(on_executors("shingles", "verified", size, similarity), "x long, y long"), "near_links")
    dropped(few, of)
    return out


def sets_of(documents: DataFrame, size: int, similarity: tuple[int, int]) -> DataFrame:
    """doc_id, text (binary), hash (of the text), and its set as ``described``; written."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    sample = documents.select(text.alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0)
    often = sample.mapInArrow(on_executors("shingles", "sampled", size), "key long").groupBy("key").agg(F.count("*").alias("c")).where(F.col("c") >= OFTEN)
    often = np.array([r[0] for r in often.orderBy(F.desc("c"), "key").limit(LAST).select("key").collect()], np.int64)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64("text").alias("hash"))
    kinds = "doc_id long, text binary, hash long, fp long, sim long, n long, sketch array<long>, keys array<long>"
    return written(rows.mapInArrow(on_executors("shingles", "described", size, similarity, often.tobytes()), kinds), "shingles")


def rest(rows: DataFrame, sets: DataFrame, found: DataFrame, size: int, similarity: tuple[int, int]) -> DataFrame:
    """fp, root: the groups of near copies, by the links ``found`` and those between the groups that these leave; written."""
    p, q = similarity
    once = written(rows.groupBy("fp").agg(F.first("keys").alias("keys")), "near_sets")
    common = written(once.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key"), "near_open")
    keys = written(once.select("fp", F.posexplode("keys").alias("pos", "key")).join(common.hint("merge"), "key", "left_semi"), "near_keys")
    dropped(once, common)

    def shared(keys: DataFrame, root: DataFrame, low: int = 0) -> DataFrame:
        """Of the keys (dropped here) those of more than one group, of sets at ``low`` or above: key, fp, pos, n, root, at; written."""
        own = keys.select("key", "fp", "pos", F.pmod(F.xxhash64("fp", F.lit("centre")), F.lit(SPACE)).alias("at")).where(F.col("at") >= low)
        full = written(own.join(sets.select("fp", "n").hint("merge"), "fp").join(root.hint("merge"), "fp"), "near_keys")
        span = full.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"))
        span = written(span.where("low < high").select("key"), "near_open")
        out = written(full.join(span.hint("merge"), "key", "left_semi"), "near_keys")
        dropped(keys, full, span)
        return out

    def may_reach(n: Column, pos: Column, n2: Column, pos2: Column) -> Column:
        """Whether sets that meet first at these places can overlap enough."""
        return F.least(n - pos, n2 - pos2) * (p + q) >= (n + n2) * p

    root = components(sets, found)
    keys = shared(keys, root)
    low = written(keys.groupBy("key").agg(F.min(F.struct("fp", "n", "pos", "root")).alias("first")), "near_first")
    first = keys.join(low.hint("merge"), "key").where((F.col("root") != F.col("first.root")) & may_reach(F.col("n"), F.col("pos"), F.col("first.n"), F.col("first.pos")))
    first = first.select(F.col("fp").alias("x"), F.col("first.fp").alias("y")).distinct()
    links = confirmed(first, sets, rows, size, similarity)
    dropped(low)
    root = merged(root, links)
    dropped(links)

    done = 0
    while done < SPACE:
        keys = shared(keys, root, done)
        members, pairs = keys.groupBy("key").agg(F.count("*").alias("c")).agg(F.coalesce(F.sum("c"), F.lit(0)), F.coalesce(F.sum(F.col("c") * F.col("c")), F.lit(0))).first()
        if not members:
            break
        share = 1.0 if pairs <= MANY * members else max(FEW * members / pairs, min(1.0, 8 * done / SPACE))
        upto = SPACE if share >= 1 else done + max(1, int((SPACE - done) * share))
        centres = keys.where(F.col("at") < upto).select("key", *(F.col(c).alias(f"{c}2") for c in ("fp", "n", "pos", "root")))
        apart = (F.col("root") > F.col("root2")) | ((F.col("at") >= upto) & (F.col("root") < F.col("root2")))  # of two centres once
        met = keys.join(centres.hint("merge"), "key").where(apart & may_reach(*map(F.col, ("n", "pos", "n2", "pos2"))))
        met = met.select(F.greatest("fp", "fp2").alias("x"), F.least("fp", "fp2").alias("y")).distinct()
        links = confirmed(met, sets, rows, size, similarity)
        root = merged(root, links)
        dropped(links)
        done = upto
    dropped(keys)
    return root
