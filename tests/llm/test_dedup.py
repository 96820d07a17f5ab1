"""Repeated bytes and words, and near copies, against brute force on small tables with nulls, ties, repeats and hot groups."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sparkevid.llm import components, repeats, shingles, simhash, substring_dedup, suffix_dedup

SCHEMA = "doc_id long, text string, lang string, k1 string, spans int"  # the last two clash with names of the operators


def table(spark, texts):
    return spark.createDataFrame([(i, t, "en", "x", 1) for i, t in texts], SCHEMA).repartition(5)


def corpus(seed, pieces):
    """Texts that share passages, with edits, copies, repeated rows, nulls, empty and very long ones."""
    r = random.Random(seed)
    words = ["".join(r.choice("abcdé") for _ in range(r.randint(1, 4))) for _ in range(40)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    shared = [text(30) for _ in range(4)]
    out = [(i, text(r.randint(0, 20)) + " " + r.choice(shared)[: r.randint(10, 80)] + " " + text(r.randint(0, 30))) for i in range(pieces)]
    out += [(1000 + i, out[i % 5][1]) for i in range(20)]
    out += [(2000, None), (2001, ""), (2002, " \n\t "), (2003, "ab" * 300), (2004, "ab" * 300 + "c"), (2005, text(4000)), (None, out[0][1]), (3, out[3][1]), (4, "another text under a repeated id")]
    return out


def removed_bytes(texts, length):
    data = [(i, (t or "").encode()) for i, t in texts]
    seen = Counter(b[p : p + length] for _, b in data for p in range(len(b) - length + 1))
    for i, b in data:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        spans = len(re.findall(b"\1+", bytes(gone)))
        yield (i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest())


@pytest.mark.parametrize("first", [4, 8])
def test_bytes_against_brute_force(spark, monkeypatch, first):
    """With one and with two rounds of doubling before the threshold, and few symbols at a time."""
    monkeypatch.setattr(suffix_dedup, "FIRST", first)
    assert len(repeats.doubling(24, 24 // first)) == first.bit_length() - 2
    texts = corpus(1, 60)
    rows = suffix_dedup.dedup_bytes(table(spark, texts), 24)
    got = rows.select("doc_id", F.octet_length("text"), repeats.removed(F.col("spans")), F.coalesce(F.size("spans"), F.lit(0)), F.sha2("kept", 256)).collect()
    assert Counter(map(tuple, got)) == Counter(removed_bytes(texts, 24))


@pytest.mark.parametrize("length", [8, 5, 1, 35])
def test_words_against_brute_force(spark, length):
    texts = corpus(2, 60)
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in texts]
    seen = Counter(tuple(w[p : p + length]) for _, w in words for p in range(len(w) - length + 1))
    want = Counter()
    for i, w in words:
        gone = [False] * len(w)
        for p in range(len(w) - length + 1):
            if seen[tuple(w[p : p + length])] > 1:
                gone[p : p + length] = [True] * length
        want[i, len(w), " ".join(x for x, g in zip(w, gone, strict=True) if not g)] += 1
    rows = substring_dedup.dedup_words(table(spark, texts), length)
    got = rows.select("doc_id", F.size("words"), F.array_join("kept", " ")).collect()
    assert Counter(map(tuple, got)) == want


def test_covers_are_difference_covers():
    for v, cover in substring_dedup.COVERS.items():
        assert {(a - b) % v for a in cover for b in cover} == set(range(v))


def test_near_copies_keep_columns(spark):
    """Of a group the row of the least id that is not null stays, with all columns; without ids one row of it."""
    data = [(2, "A b c d e"), (1, "a b c d e"), (None, "a b c d e"), (4, None), (5, ""), (4, None), (None, "no id at all"), (None, "no id at all")]
    out = simhash.dedup(table(spark, data)).collect()
    assert sorted((str(r["doc_id"]), r["text"], r["k1"], r["spans"]) for r in out) == [("1", "a b c d e", "x", 1), ("4", None, "x", 1), ("None", "no id at all", "x", 1)]


def test_texts_keep_whole_characters_and_columns(spark):
    passage = "é" * 40
    docs = table(spark, [(1, "a" + passage + "b"), (2, "è" + passage + "c"), (3, None)])
    out = {r["doc_id"]: r for r in suffix_dedup.dedup_texts(docs, 20).collect()}
    assert (out[1]["text"], out[2]["text"], out[3]["text"], out[1]["k1"]) == ("ab", "èc", None, "x")


@pytest.mark.parametrize("operator", [suffix_dedup.dedup_bytes, substring_dedup.dedup_words, suffix_dedup.dedup_texts, simhash.dedup, simhash.near_groups])
def test_empty_tables(spark, operator):
    assert operator(spark.createDataFrame([], SCHEMA)).collect() == []


def reachable(prints):
    """Least id reachable over fingerprints that differ in at most two bits, by search over all pairs."""
    left = set(prints.values())
    out = {}
    while left:
        group, todo = set(), [left.pop()]
        while todo:
            x = todo.pop()
            group.add(x)
            near = {y for y in left if (x ^ y).bit_count() <= 2}
            left -= near
            todo += near
        ids = [i for i, f in prints.items() if f in group]
        out |= dict.fromkeys(ids, min(ids))
    return out


@pytest.mark.parametrize("pairs", [32, 3])
def test_links_of_fingerprints(spark, monkeypatch, pairs):
    """Chains and dense clusters of fingerprints, by both ways of verifying."""
    monkeypatch.setattr(simhash, "PAIRS", pairs)
    r = random.Random(3)
    prints = {}
    for _ in range(6):
        x = r.getrandbits(64)
        for _ in range(30):
            prints[len(prints)] = x
            x ^= 1 << r.randrange(64) if r.random() < 0.6 else (1 << r.randrange(64)) | (1 << r.randrange(64))
    centre = r.getrandbits(64)
    for i in range(64):
        prints[len(prints)] = centre ^ (1 << i)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    d = spark.createDataFrame([(signed(f),) for f in sorted(set(prints.values()))], "fp long")
    root = {r["fp"]: r["root"] for r in components.components(d, simhash.links(d)).collect()}
    want, by_root = reachable(prints), {}
    for i, f in prints.items():
        by_root.setdefault(root[signed(f)], []).append(i)
    assert {i: min(ids) for ids in by_root.values() for i in ids} == want


def test_fingerprints_and_groups(spark):
    import xxhash

    def plain(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
        shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    texts = [(i, t) for i, t in corpus(4, 40) if i is not None and i not in (3, 4)] + [(5000, "ÀB c D"), (5001, "Àb C d"), (5002, "two words"), (5003, "one")]
    prints = {i: plain(t) for i, t in texts}
    got = {r["doc_id"]: r for r in simhash.near_groups(table(spark, texts)).collect()}
    assert {i: r["fp"] % (1 << 64) for i, r in got.items()} == prints
    assert {i: r["component_id"] for i, r in got.items()} == reachable(prints)


def test_golay_code():
    near = simhash.near_codewords()
    r = random.Random(5)
    for _ in range(2000):
        x = r.getrandbits(23)
        y = x ^ (1 << r.randrange(23)) ^ (1 << r.randrange(23))
        keys = [set(simhash.fuzzy_keys(__import__("numpy").array([v]))[1].tolist()) for v in (x, y)]
        assert keys[0] & keys[1] and len(keys[0]) <= 8
    counts = Counter(near.tolist())
    assert len(counts) == 4096 and set(counts.values()) == {2048}


def shingle_groups(texts, k=5):
    """Row indices by groups of texts with a Jaccard similarity of 0.8 or more, by comparing all pairs."""
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or {tuple(w)})
    group = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            if group[a] != group[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                group = [group[b] if g == group[a] else g for g in group]
    return [[i for i, g in enumerate(group) if g == v] for v in sorted(set(group))]


def test_similar_texts_against_all_pairs(spark, monkeypatch):
    """Edits around the bound, a large group, a common passage, repeated and null ids, texts of few words."""
    monkeypatch.setattr(shingles, "OFTEN", 2)
    monkeypatch.setattr(shingles, "SAMPLE", 1)
    r = random.Random(7)
    words = [f"w{i}" for i in range(300)]
    text = lambda n: [r.choice(words) for _ in range(n)]
    common, data = text(25), corpus(8, 30)
    for base in (text(60) + common + text(60) for _ in range(8)):
        for _ in range(6):
            w = list(base)
            for _ in range(r.randint(0, 7)):
                w[r.randrange(len(w))] = r.choice(words)
            data.append((r.choice([None, r.randrange(5000, 5040)]), " ".join(w)))
    big = text(100)
    data += [(6000 + i, " ".join([*big[:i], "x", *big[i + 1 :]])) for i in range(60)]
    data += [(7000, "one two"), (7001, "One  two"), (7002, "one two three"), (None, "lonely text without an id")]
    groups = shingle_groups([t for _, t in data])
    out = [(x["doc_id"], x["text"]) for x in simhash.dedup(table(spark, data)).collect()]
    place = {data[i]: k for k, g in enumerate(groups) for i in g}
    assert Counter(place[x] for x in out) == Counter(range(len(groups)))  # one row of each group
    least = {k: min((data[i][0] for i in g if data[i][0] is not None), default=None) for k, g in enumerate(groups)}
    assert {place[x]: x[0] for x in out} == least
    assert max(map(len, groups)) >= 60 and len(groups) < len(set(data)) - 60


def test_rounds_of_centres_lose_no_link_and_pair_less(spark, monkeypatch):
    """A large group of texts that differ too much from its least member, so that only chains of links join it."""
    monkeypatch.setattr(shingles, "SAMPLE", 1)
    r = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    base, data = [r.choice(words) for _ in range(120)], []
    for i in range(120):
        w = list(base)
        for _ in range(r.randint(1, 3)):
            w[r.randrange(len(w))] = r.choice(words)
        data.append((i, " ".join(w)))
    data += [(200 + i, " ".join(r.choice(words) for _ in range(60))) for i in range(20)]
    groups = shingle_groups([t for _, t in data])
    tried, confirmed = [], shingles.confirmed
    monkeypatch.setattr(shingles, "confirmed", lambda pairs, *rest: (tried.append(pairs.count()), confirmed(pairs, *rest))[1])
    kept = {}
    for many, few in ((10**9, 4), (1, 1)):
        monkeypatch.setattr(shingles, "MANY", many)
        monkeypatch.setattr(shingles, "FEW", few)
        tried.clear()
        kept[many] = sorted(x["doc_id"] for x in simhash.dedup(table(spark, data)).collect()), sum(tried), len(tried)
    assert kept[1][0] == kept[10**9][0] == sorted(min(data[i][0] for i in g) for g in groups)
    assert kept[1][2] > kept[10**9][2] and kept[1][1] < kept[10**9][1]


def counted(monkeypatch, *modules):
    """Rows of the tables that the modules write, by name."""
    rows = {}

    def written(df, name, real=shingles.written):
        out = real(df, name)
        rows.setdefault(name, []).append(out.count())
        return out

    for m in modules:
        monkeypatch.setattr(m, "written", written)
    return rows


def test_links_are_handed_on_once(spark, monkeypatch):
    """Whatever the number of rounds, a link takes part in one search for components, as an edge between two groups."""
    monkeypatch.setattr(shingles, "SAMPLE", 1)
    monkeypatch.setattr(shingles, "MANY", 1)
    monkeypatch.setattr(shingles, "FEW", 1)
    r = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    base, data = [r.choice(words) for _ in range(120)], []
    for i in range(60):
        w = list(base)
        for _ in range(r.randint(1, 3)):
            w[r.randrange(len(w))] = r.choice(words)
        data.append((i, " ".join(w)))
    rows = counted(monkeypatch, shingles, components)
    kept = [x["doc_id"] for x in simhash.dedup(table(spark, data)).collect()]
    assert sorted(kept) == sorted(min(data[i][0] for i in g) for g in shingle_groups([t for _, t in data]))
    assert len(rows["edges"]) > 2 and sum(rows["edges"]) <= 2 * sum(rows["near_links"])
    assert len(rows["near_sets"]) == 1 and sum(rows["near_open"][1:]) < len(rows["near_open"]) * rows["near_open"][0]


def test_sketches_tell_long_texts_apart(spark, monkeypatch):
    """Texts of thousands of words that have half their shingles in common end before they are met; near copies of that length do not."""
    r = random.Random(6)
    text = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    base = text(1500)
    data = [(i, " ".join(base + text(1500))) for i in range(4)]
    data.append((9, data[0][1].replace(base[40], "other")))
    rows = counted(monkeypatch, shingles)
    assert sorted(x["doc_id"] for x in simhash.dedup(table(spark, data)).collect()) == [0, 1, 2, 3]
    assert sum(rows["near_pairs"]) == 1


@pytest.mark.parametrize(("n", "m"), [(1, 1), (500, 520), (900, 1100), (2048, 2049), (4097, 4000), (3000, 3700)])
def test_sketches_differ_in_no_more_bits_than_sets(spark, n, m):
    import numpy as np

    r = np.random.default_rng(n)
    s, new = r.integers(0, 1 << 63, n, dtype=np.uint64), r.integers(0, 1 << 63, m, dtype=np.uint64)
    t = np.unique(np.concatenate((s[: int(0.9 * n)], new))[:m])
    s = np.unique(s)
    row = spark.createDataFrame([(shingles.sketch_of(s).tolist(), shingles.sketch_of(t).tolist())], "a array<long>, b array<long>")
    for a, b in (("a", "b"), ("b", "a")):
        found = row.select(shingles.differing(F.col(a), F.col(b))).first()[0]
        assert (len(np.setxor1d(s, t)) - found) % 2 == 0 and 0 < found <= len(np.setxor1d(s, t))


def test_stage_drops_texts_of_similarity_four_fifths(spark):
    """Fingerprints of this pair differ in more than two bits, but most shingles of five words are the same; texts that share an id stay."""
    import corpus_pipeline

    w = [f"word{i}" for i in range(80)]
    a, b = " ".join(w), " ".join([*w[:40], "other", *w[41:]])
    assert (simhash.fingerprint(a.encode(), 5) ^ simhash.fingerprint(b.encode(), 5)).bit_count() > simhash.BITS
    other = " ".join(reversed(w))
    docs = table(spark, [(2, a), (1, b), (1, other), (1, other), (3, a.upper())])
    docs = dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, docs, "")
    assert sorted((r["doc_id"], r["text"]) for r in docs.collect()) == sorted([(1, b), (1, other)])


def test_links_of_fingerprints_are_verified(spark, monkeypatch):
    """Texts whose fingerprints are alike but whose shingles are not stay."""
    monkeypatch.setattr(simhash, "links", lambda prints: simhash.written(prints.crossJoin(prints.select(F.col("fp").alias("y"))).where("fp > y").select(F.col("fp").alias("x"), "y"), "links"))
    texts = [(i, " ".join(f"{c}{k}" for k in range(20))) for i, c in enumerate("abcd")]
    assert sorted(r["doc_id"] for r in simhash.dedup(table(spark, texts)).collect()) == [0, 1, 2, 3]
