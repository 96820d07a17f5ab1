"""SimHash near-dedup with Golay-code fuzzy keys.

A fingerprint of 64 bits is cut into three segments, A and B of 23 bits and C of 18. The binary Golay code of length
23 is perfect: every 23-bit vector is within 3 bits of exactly one codeword. The fuzzy keys of a vector are the
codewords nearest to it and to its 23 neighbours, six at most as a rule. Two vectors that differ in at most 2 bits have a vector
within 1 bit of both, and so a fuzzy key in common. Pigeonhole: of at most 2 differing bits over three segments, one
segment has none. So the keys (A, fuzzy B), (B, fuzzy A) and (C, fuzzy A) bring all linked fingerprints together: if A or B
is equal, by the first two, and else A and B differ in one bit each and C is equal.

Only distinct fingerprints get keys. A key of at most ``PAIRS`` fingerprints is joined with itself and each pair verified.
In a larger one the members are verified through balls instead: two fingerprints differ in at most 2 bits
if and only if some vector is within 1 bit of both, so each member emits its 65 neighbours, and those that share a
neighbour link to the least of them. Both ways find exactly the links; neither emits all pairs of a large group.
Components follow by hooking to the least neighbour and pointer jumping, on distinct fingerprints.

Null and empty texts have fingerprint zero and link like any other. Rows with a null doc_id take part, and a component's id is the
least id that is not null. Extra columns are not read. ``dedup`` is the operator of a pipeline, on verified similarity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import hashing, shingles
from .components import components
from .runtime import dropped, on_executors, table, written

#: Differing bits of linked fingerprints at most; the keys find no more.
BITS = 2
#: Largest number of fingerprints of a key that are paired.
PAIRS = 32
#: The Golay code's generator polynomial, x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011


def fingerprint(text: bytes, size: int = 3, seed: int = 42) -> int:
    """Majority of the bits of the XXH64 of all word shingles, repeats included."""
    words = shingles.words(text)
    if not words:
        return 0
    if len(words) <= size:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-size] + 1)).tolist()
    ends = ends[size - 1 :].tolist()
    parts = range(0, len(starts), 1 << 16)  # long texts in parts
    hashes = (np.array([xxhash.xxh64_intdigest(line[s:e], seed) for s, e in zip(starts[lo : lo + (1 << 16)], ends[lo : lo + (1 << 16)], strict=True)], np.uint64) for lo in parts)
    return hashing.majority(hashes)


def fingerprints(batches: Iterator[pa.RecordBatch], size: int, seed: int) -> Iterator[pa.RecordBatch]:
    """Rows with text (binary) to rows with fp (as a signed long)."""
    for batch in batches:
        fp = [fingerprint(x.as_py() or b"", size, seed) for x in batch.column("text")]
        rest = {c: batch.column(c) for c in batch.schema.names if c != "text"}
        yield pa.RecordBatch.from_pydict(rest | {"fp": pa.array(np.array(fp, np.uint64).view(np.int64))})


_near: list[np.ndarray] = []


def near_codewords() -> np.ndarray:
    """(2^23,) the index (0 to 4095) of the codeword nearest to each vector, by syndrome; built once a process."""
    if not _near:
        v = np.arange(1 << 23, dtype=np.uint32)
        syndrome = v.copy()
        for bit in range(22, 10, -1):
            syndrome ^= ((syndrome >> bit) & 1) * np.uint32(GENERATOR << (bit - 11))
        errors = np.zeros(1 << 11, np.uint32)
        light = [0, *(1 << i for i in range(23)), *(1 << i | 1 << j for i in range(23) for j in range(i)), *(1 << i | 1 << j | 1 << k for i in range(23) for j in range(i) for k in range(j))]
        of = np.array(light, np.uint32)
        errors[syndrome[of]] = of
        _near.append(((v ^ errors[syndrome]) >> 11).astype(np.uint16))  # the code is systematic in its upper 12 bits
    return _near[0]


def fuzzy_keys(segments: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, codeword index) pairs: the codewords nearest to a vector and to each vector 1 bit away."""
    near = near_codewords()
    around = segments[:, None] ^ np.array([0, *(1 << i for i in range(23))], np.int64)
    index = np.sort(near[around], axis=1)
    first = np.concatenate((np.ones((len(index), 1), bool), index[:, 1:] != index[:, :-1]), axis=1)
    row, col = np.nonzero(first)
    return row, index[row, col].astype(np.int64)


def golay_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """fp to (key, fp): family, exact segment and codeword index in one long."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 4096):
            fp = batch.column("fp").slice(lo, 4096).to_numpy()
            u = fp.view(np.uint64)
            a, b, c = ((u >> np.uint64(s) & np.uint64((1 << n) - 1)).astype(np.int64) for s, n in ((41, 23), (18, 23), (0, 18)))
            (ra, ka), (rb, kb) = fuzzy_keys(a), fuzzy_keys(b)
            key = np.concatenate(((0 << 40) | (a[rb] << 12) | kb, (1 << 40) | (b[ra] << 12) | ka, (2 << 40) | (c[ra] << 12) | ka))
            row = np.concatenate((rb, ra, ra))
            yield pa.RecordBatch.from_pydict({"key": pa.array(key), "fp": pa.array(fp[row])})


def links(distinct: DataFrame) -> DataFrame:
    """Verified links (x > y) among distinct fingerprints, enough of them for the components."""
    keys = written(distinct.select("fp").mapInArrow(on_executors("simhash", "golay_keys"), "key long, fp long"), "golay_keys")
    sizes = keys.groupBy("key").agg(F.count("*").alias("n")).where("n >= 2")
    sizes = written(sizes, "golay_sizes")
    if sizes.isEmpty():
        dropped(keys, sizes)
        return distinct.sparkSession.createDataFrame([], "x long, y long")
    shared = keys.join(sizes.hint("merge"), "key")

    def verified(x: Column, i: Column) -> Column:
        later = F.filter(F.slice("fps", i + 2, F.size("fps")), lambda y: F.bit_count(x.bitwiseXOR(y)) <= BITS)
        return F.transform(later, lambda y: F.struct(y.alias("x"), x.alias("y")))

    few = shared.where(F.col("n") <= PAIRS).groupBy("key").agg(F.sort_array(F.collect_list("fp")).alias("fps"))
    few = few.select(F.explode(F.flatten(F.transform("fps", verified))).alias("p")).select("p.x", "p.y").distinct()
    many = shared.where(F.col("n") > PAIRS).select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *(F.expr(f"shiftleft(1L, {i})") for i in range(64)))
    balls = many.select("fp", F.explode(F.transform(flips, lambda m: F.col("fp").bitwiseXOR(m))).alias("ball"))
    least = balls.groupBy("ball").agg(F.min("fp").alias("y"), F.count("*").alias("n")).where("n >= 2").drop("n")
    least = written(least, "balls")
    star = balls.join(least.hint("merge"), "ball").where("fp > y").select(F.col("fp").alias("x"), "y").distinct()
    out = written(few.unionByName(star), "links")
    dropped(keys, sizes, least)
    return out


def near_groups(documents: DataFrame, size: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fp (signed long), component_id: the least doc_id among all documents reachable over links."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    prints = written(rows.mapInArrow(on_executors("simhash", "fingerprints", size, seed), "doc_id long, fp long"), "fingerprints")
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    root = components(distinct, links(distinct))
    smallest = distinct.join(root.hint("merge"), "fp").groupBy("root").agg(F.min("least").alias("component_id"))
    names = root.join(smallest, "root").select("fp", "component_id")
    return prints.join(written(names, "names").hint("merge"), "fp").select("doc_id", "fp", "component_id")


def unsigned_hex(x: Column) -> Column:
    return F.lower(F.lpad(F.hex(x), 16, "0"))


def dedup(documents: DataFrame, size: int = 5, similarity: tuple[int, int] = (4, 5)) -> DataFrame:
    """The documents (all columns) of which each group of near copies keeps one row: that of the least doc_id that is not null, and
    of the least hash of its text.

    Near copies are texts whose sets of word shingles have the Jaccard similarity or more; groups are their components. Links come
    from the fingerprints of the sets: equal ones, and those that share a Golay key and differ in at most BITS bits, are
    verified by their sets. Pairs of that similarity often differ in more bits, so ``shingles.rest`` finds the links between the
    groups that these leave, exactly. Equal sets are one node; null and empty texts are equal sets. Rows that share a
    doc_id but no text are rows of their own, and so are those without an id."""
    rows = shingles.sets_of(documents, size, similarity)
    sets = written(rows.groupBy("fp").agg(F.first("sim").alias("sim"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash")).alias("least")), "sets")
    prints = written(sets.groupBy(F.col("sim").alias("fp")).agg(F.min("fp").alias("least")), "fingerprints")
    near = links(prints).groupBy("x").agg(F.min("y").alias("y"))  # one link of each: what others would join, the rest finds
    first = prints.select(F.col("fp").alias("sim"), F.col("least").alias("y"))
    equal = sets.join(first.hint("merge"), "sim").where("fp > y").select(F.col("fp").alias("x"), "y")
    at = lambda c: prints.select(F.col("fp").alias(c), F.col("least").alias(f"set_{c}")).hint("merge")
    apart = near.join(at("x"), "x").join(at("y"), "y").select(F.greatest("set_x", "set_y").alias("x"), F.least("set_x", "set_y").alias("y"))
    found = shingles.confirmed(equal.unionByName(apart).distinct(), sets, rows, size, similarity)
    dropped(prints)
    root = shingles.rest(rows, sets, found, size, similarity)
    stay = sets.join(root.hint("merge"), "fp").groupBy("root").agg(F.min("least").alias("least"))
    stay = written(stay.select(F.coalesce("least.doc_id", F.lit(0)).alias("k1"), F.col("least.hash").alias("k2"), F.col("least.none").alias("k3")), "stay")
    dropped(rows, sets, root)
    keys = (F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("k1"), F.xxhash64("text").alias("k2"), F.col("doc_id").isNull().alias("k3"))
    own = documents.select(F.struct(*documents.columns).alias("row"), *keys)
    return own.join(stay.hint("merge"), ["k1", "k2", "k3"], "left_semi").dropDuplicates(["k1", "k2", "k3"]).select("row.*")


def op8_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    groups = near_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", unsigned_hex(F.col("fp")).alias("fingerprint"), "component_id")
