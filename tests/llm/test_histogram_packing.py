"""op12: every id in exactly one piece, places without gaps, and the plan of single packs."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sparkevid.llm import histogram_packing as H

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("seed", range(30))
def test_plan_equals_one_pack_at_a_time(seed):
    """Placing every piece by itself into the shortest pack gives packs of the same totals."""
    rng = random.Random(seed)
    capacity = rng.choice([8, 50, 2048])
    lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 300))]
    packs: list[list[int]] = []
    for s in sorted(lengths, reverse=True):
        shortest = min(packs, key=sum, default=None)
        if shortest is None or sum(shortest) + s > capacity:
            packs.append([s])
        else:
            shortest.append(s)
    plan = H.shortest_pack_first(Counter(lengths), capacity)
    assert Counter(s for p, n in plan for s in p for _ in range(n)) == Counter(lengths)
    assert sorted(sum(p) for p, n in plan for _ in range(n)) == sorted(map(sum, packs))


def check(spark, rows, capacity, tmp_path):
    library = Tokenizer.from_file(PATH)
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string, offset string, rid string, p string")
    got = [r.asDict() for r in H.pack(docs, PATH, capacity).collect()]
    ids = [[*library.encode(r[1] or "", add_special_tokens=False).ids, 1] for r in rows]
    want = Counter((r[0], s, len(x[s : s + capacity]), zlib.crc32(np.array(x[s : s + capacity], "<u4").tobytes()), len(x)) for r, x in zip(rows, ids, strict=True) for s in range(0, len(x), capacity))
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == want
    at: dict[int, int] = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == at.get(r["sequence_id"], 0)
        at[r["sequence_id"]] = r["offset"] + r["length"]
    assert all(n <= capacity for n in at.values())
    return at


def test_edges(spark, tmp_path):
    """Null and empty texts, a null id, repeated rows, a very long text, clashing column names."""
    x = ("x",) * 4
    rows = [(1, None, *x), (2, "", *x), (None, "a b c", *x), (3, "same row", *x), (3, "same row", *x), (4, "many words here " * 900, *x), (5, "ü   <|endoftext|>", *x)]
    at = check(spark, rows, 64, tmp_path)
    assert len(at) <= -(-sum(at.values()) // 64) + 1


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert H.pack(docs, PATH).count() == 0


def test_whole_table_has_little_padding(spark, small):
    got = H.op12_histogram_packing(spark, small).groupBy("sequence_id").sum("length").collect()
    total = sum(r[1] for r in got)
    assert max(r[1] for r in got) <= 2048
    assert len(got) * 2048 - total < 0.02 * total + 2048
