"""Products of blocks against plain Python."""

import math
import random

import pytest

from sparkevid.operators import similarity


def cosine(a, b):
    d = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
    return round(sum(x * y for x, y in zip(a, b, strict=True)) / d, 6) + 0.0 if d else 0.0


@pytest.mark.parametrize("block", [1 << 20, 160])
def test_against_all_pairs(spark, monkeypatch, block):
    """Ties, equal vectors, one without length, vectors of another length, nulls, blocks of one and of many."""
    monkeypatch.setattr(similarity, "BLOCK_BYTES", block)
    rng = random.Random(block)
    data = [(i, [float(rng.randint(-2, 2)) for _ in range(4)]) for i in range(60)] + [(i, [1.0, 2.0]) for i in range(60, 64)] + [(64, None), (65, [0.0] * 4)]
    v = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    q = v.where("vec_id % 7 = 0 or vec_id in (64, 65)")
    asked = [x for x in data if x[0] % 7 == 0 or x[0] in (64, 65)]
    want, ends = [], []
    for i, a in asked:
        pairs = sorted((-cosine(a, b), j) for j, b in data if a and b and len(a) == len(b) and i != j)
        want += [(i, j, -c + 0.0, r + 1) for r, (c, j) in enumerate(pairs[:5])]
        ends += [(i, -pairs[-1][0] + 0.0, -pairs[0][0] + 0.0)] if pairs else []
    assert sorted(map(tuple, similarity.nearest(v, q, 5).collect())) == sorted(want)
    assert sorted(map(tuple, similarity.bounds(v, q).collect())) == sorted(ends)


def test_empty(spark):
    v = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert similarity.nearest(v, v, 3).count() == 0 and similarity.bounds(v, v).count() == 0
