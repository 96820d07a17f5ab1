"""Packing, token counts and the codec against the public libraries and brute force."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkevid.llm import packing, sentencepiece_codec, token_counts

BPE, MODEL = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
texts = st.text(alphabet=st.one_of(st.sampled_from("the ing,.\n  \tAé'▁"), st.characters(codec="utf-8")), max_size=60)


def rows(spark, data):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in data], "doc_id long, text string, length int, piece string")


@settings(max_examples=300, deadline=None)
@given(texts)
def test_byte_bpe_equals_the_library(t):
    e = packing.encoder(BPE)
    assert e.core is not None
    assert e(t) == e.library.encode(t, add_special_tokens=False).ids


def test_special_strings_as_the_library_takes_them():
    e = packing.encoder(BPE)
    t = "a<|endoftext|><|endoftext|> b"
    assert e(t) == e.library.encode(t, add_special_tokens=False).ids and 50256 in e(t)


@settings(max_examples=300, deadline=None)
@given(texts)
def test_counts_equal_the_library(t):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert token_counts.merger(MODEL).counts([t]) == [len(library.encode(t))]


def test_counts_of_long_pretokens():
    library, m = sentencepiece.SentencePieceProcessor(model_file=MODEL), token_counts.merger(MODEL)
    r = random.Random(1)
    for t in ["x" * 3000, "the" * 700, " " * 999 + "a", "".join(r.choice("theingor") for _ in range(5000)), "<s></s><unk>"]:
        assert m.counts([t]) == [len(library.encode(t))]
        word = m.model.normalized(t)
        assert m.by_heap(word) == len(library.encode(t))


def best(items, capacity):
    items = sorted(items, reverse=True)
    least = [len(items)]

    def go(i, bins):
        if len(bins) >= least[0]:
            return
        if i == len(items):
            least[0] = len(bins)
            return
        for room in sorted(set(bins)):
            if room + items[i] <= capacity:
                k = bins.index(room)
                bins[k] += items[i]
                go(i + 1, bins)
                bins[k] -= items[i]
        go(i + 1, [*bins, items[i]])

    go(0, [])
    return least[0]


def test_reduction_keeps_the_optimum():
    fixed_any = 0
    for seed in range(400):
        r = random.Random(seed)
        capacity = r.randint(5, 30)
        items = [r.randint(1, capacity) for _ in range(r.randint(1, 9))]
        counts = {s: items.count(s) for s in items}
        fixed, left = packing.reduce_instance(counts, capacity)
        rest = [s for s, n in left.items() for _ in range(n)]
        assert sum(n for _, n in fixed) + (best(rest, capacity) if rest else 0) == best(items, capacity)
        fixed_any += bool(fixed)
        packed = packing.plan(counts, capacity)
        assert all(sum(p) <= capacity for p, _ in packed)
        assert sorted(s for p, n in packed for s in p * n) == sorted(items)
    assert fixed_any > 100


def test_pieces_and_places(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 3)
    data = [(1, "the thing " * 1500), (2, None), (3, ""), (4, "short"), (4, "short"), (None, "no id"), *((10 + i, "same words here " * (i % 3 + 1)) for i in range(40))]
    got = packing.pack(rows(spark, data), BPE, 64).collect()
    e = packing.encoder(BPE)
    want = []
    for i, t in data:
        ids = np.array([*e(t or ""), 2], "<u4")
        n = len(ids)
        first = n if n <= 64 else n % 64 or 64
        edges = [0, *range(first, n + 1, 64)]
        want += [(i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted((str(i), *x) for i, *x in want)
    place = {}
    for r in got:
        place.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for x in place.values():
        at = 0
        for offset, n in sorted(x):
            assert offset == at
            at += n
        assert at <= 64
    assert packing.pack(rows(spark, []), BPE).collect() == []


def unpacked(ids):
    return np.frombuffer(ids, "<i4").tolist()


@settings(max_examples=300, deadline=None)
@given(texts)
def test_ids_equal_the_library_and_round_trip(t):
    """By merging runs, and by the path of pieces over the whole text."""
    c, library = sentencepiece_codec.codec(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    text, want = c.model.normalized(t), library.encode(t)
    assert unpacked(c.encode(text)) == want
    assert unpacked(c.trace(text, c.path(text, 0, "", len(text)), 0, len(text))) == want
    assert c.decode(want) == t.replace("▁", " ")


def test_long_runs_equal_the_library():
    c, library = sentencepiece_codec.codec(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    r = random.Random(2)
    for t in ["x" * 3000, "the" * 700, " " * 999 + "a", "".join(r.choice("theingor") for _ in range(5000)), "=" * 500 + "-" * 70]:
        assert unpacked(c.encode(c.model.normalized(t))) == library.encode(t)


def test_products_of_matrices_are_associative():
    r = np.random.default_rng(1)
    a, b, c = (np.where(r.random(s) < 0.4, r.integers(-9, 9, s), sentencepiece_codec.NONE) for s in ((3, 4), (4, 2), (2, 5)))
    p = sentencepiece_codec.product
    assert (p(p(a, b), c) == p(a, p(b, c))).all()


def test_joined_checksums():
    a, b = b"some bytes", bytes(range(256)) * 3
    for x, y in ((a, b), (b, a), (a, b""), (b"", b), (b"", b"")):
        assert sentencepiece_codec.crc32_joined(zlib.crc32(x), zlib.crc32(y), len(y)) == zlib.crc32(x + y)


@pytest.mark.parametrize("size", [3, 16, 50])
def test_scan_of_chunks_equals_the_library(spark, monkeypatch, size):
    """Ids, texts and figures of every row: nulls, empty texts, repeated rows, runs of many chunks, clashing columns; blocks of three chunks."""
    monkeypatch.setattr(sentencepiece_codec, "BLOCK", 3)
    monkeypatch.setattr(sentencepiece_codec, "DEAL", 4)
    r = random.Random(size)
    data = [(i, "".join(r.choice(["the", "ing", " ", "  ", "tion", "\n", "é", "ꙮ", "zz", "e"]) for _ in range(r.randint(1, 60)))) for i in range(15)]
    data += [(90, None), (91, ""), (92, "internation" * 20), (92, "internation" * 20), (None, "no id, but a text of several chunks" * 3)]
    library, c = sentencepiece.SentencePieceProcessor(model_file=MODEL), sentencepiece_codec.codec(MODEL)
    encoded = sentencepiece_codec.encode(rows(spark, data), MODEL, size)
    parts = {}
    for x in sentencepiece_codec.decode(encoded, MODEL).collect():
        parts.setdefault((x["doc_id"], x["row"]), []).append((x["part"], x["ids"], x["text"]))
    got = sorted((str(d), [i for _, ids, _ in sorted(p) for i in ids], "".join(t for _, _, t in sorted(p))) for (d, _), p in parts.items())
    assert got == sorted((str(d), library.encode(t or ""), t or "") for d, t in data)
    assert max(map(len, parts.values())) > 4
    figures = sorted((str(x["doc_id"]), *(x[k] for k in sentencepiece_codec.DIGEST)) for x in sentencepiece_codec.digests(encoded, MODEL).collect())
    want = []
    for d, t in data:
        ids, text = library.encode(t or ""), t or ""
        want.append((str(d), len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), len(text), len(text.encode()), zlib.crc32(text.encode())))
    assert figures == sorted(want) and c.decode(library.encode("a ▁")) == "a  "


def test_codec_of_an_empty_table(spark):
    assert sentencepiece_codec.digests(sentencepiece_codec.encode(rows(spark, []), MODEL), MODEL).collect() == []


def test_token_counts_of_a_table(spark):
    """Nulls, empty texts, repeated rows, clashing columns and an empty table."""
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    data = [(1, None), (2, ""), (3, "the thing"), (3, "the thing"), (None, "é" * 9000), (4, " \n ")]
    got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.token_counts(rows(spark, data), MODEL).collect())
    assert got == sorted((str(i), len((t or "").encode()), n, n > 4096) for i, t in data for n in [len(library.encode(t or ""))])
    assert token_counts.token_counts(rows(spark, []), MODEL).collect() == []
