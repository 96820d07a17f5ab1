"""Token counts by rank-synchronous merging, as a SentencePiece BPE model gives them.

No piece has a space after another character or a sign beside a letter, so a text falls into pre-tokens at the starts of its
spaces, between letters and signs, and at control characters that no piece holds (``Pieces.runs``); merges never cross these. New pre-tokens of a batch are held in one ragged numpy array. In each
round every sequence merges its pair of lowest rank, the leftmost of equal ones; sequences without a pair leave, and
what is left of them is counted: one token for a piece, one for each byte of a character that is none. Counts
of recent pre-tokens are kept between batches, up to a bound. A pre-token of more than LONG symbols, for which rounds over
the array would be quadratic, merges in the same order by a heap.

Null and empty texts have no tokens. Repeated rows are counted each for itself; extra columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pieces
from .runtime import on_executors, table

#: Symbols of a pre-token above which it merges by a heap; pre-tokens that are remembered.
LONG = 400
REMEMBERED = 400_000
_NONE = np.int64(1 << 62)


class Merger:
    def __init__(self, path: str):
        model = pieces.load(path)
        self.model = model
        chars = {c for n in model.ids for c in n}
        self.symbol = {n: i for i, n in enumerate([*model.ids, *(c for c in sorted(chars) if c not in model.ids)])}
        self.weight = np.array([1 if n in model.ids else len(n.encode()) for n in self.symbol] + [0])  # the last is for other characters
        self.size = len(self.symbol) + 1
        rank = {s: i for i, s in enumerate(sorted({model.scores[i] for i in model.ids.values()}, reverse=True))}
        found = []
        for name, i in model.ids.items():
            for cut in range(1, len(name)):
                a, b = self.symbol.get(name[:cut]), self.symbol.get(name[cut:])
                if a is not None and b is not None:
                    found.append((a * self.size + b, rank[model.scores[i]], self.symbol[name]))
        found.sort()
        self.pair, self.rank, self.merged = (np.array(x, np.int64) for x in zip(*found, strict=True))
        self.by_pair = {p: (r, m) for p, r, m in found}
        self.pretoken = model.runs()
        self.known: dict[str, int] = {}

    def symbols(self, word: str) -> list[int]:
        other = self.size - 1
        return [self.symbol.get(c, other) for c in word]

    def _other_bytes(self, word: str) -> int:
        return sum(len(c.encode()) for c in word if c not in self.symbol)

    def by_heap(self, word: str) -> int:
        """Symbols left of one long pre-token, in bytes where they are no pieces."""
        s = self.symbols(word)
        n = len(s)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and (x := self.by_pair.get(s[i] * self.size + s[j])):
                heapq.heappush(heap, (x[0], i, s[i], s[j]))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if s[i] != a or j < 0 or s[j] != b:
                continue
            s[i], s[j] = self.by_pair[a * self.size + b][1], -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(before[i], i)
            offer(i, after[i])
        return int(sum(self.weight[x] for x in s if x >= 0)) + self._other_bytes(word)

    def by_rounds(self, words: list[str]) -> np.ndarray:
        """Symbols left of each pre-token, all sequences merging together."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        other = self.size - 1
        s = np.array([self.symbol.get(c, other) for w in words for c in w], np.int64)
        out = np.array([self._other_bytes(w) for w in words], np.int64)
        row = np.repeat(np.arange(len(words)), lengths)
        while len(s):
            same = row[1:] == row[:-1]
            key = s[:-1] * self.size + s[1:]
            at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
            fits = same & (self.pair[at] == key)
            place = np.append(np.where(fits, self.rank[at] << np.int64(32) | np.arange(len(key)), _NONE), _NONE)
            starts = np.flatnonzero(np.append(True, ~same))
            least = np.minimum.reduceat(place, starts)
            sizes = np.diff(np.append(starts, len(s)))
            done = np.repeat(least == _NONE, sizes)
            np.add.at(out, row[done], self.weight[s[done]])
            merge = (least[least != _NONE] & np.int64(0xFFFFFFFF)).astype(np.int64)
            s[merge] = self.merged[at[merge]]
            keep = ~done
            keep[merge + 1] = False
            s, row = s[keep], row[keep]
        return out

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if len(w) <= LONG]
        for lo in range(0, len(new), 50_000):
            part = new[lo : lo + 50_000]
            self.known.update(zip(part, self.by_rounds(part).tolist(), strict=True))
        self.known.update((w, self.by_heap(w)) for w in words if len(w) > LONG)

    def counts(self, texts: list[str]) -> list[int]:
        split = [self.pretoken.findall(self.model.normalized(t)) for t in texts]
        distinct = set().union(*split)
        if len(self.known) + len(distinct) > REMEMBERED:
            self.known.clear()
        self.learn(distinct - self.known.keys())
        return [sum(map(self.known.__getitem__, x)) for x in split]


_mergers: dict[str, Merger] = {}


def merger(path: str) -> Merger:
    if path not in _mergers:
        _mergers[path] = Merger(path)
    return _mergers[path]


def count_tokens(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """doc_id and text to doc_id, n_bytes, n_tokens."""
    m = merger(path)
    for batch in batches:
        for lo in range(0, batch.num_rows, 500):
            part = batch.slice(lo, 500)
            texts = [x.as_py() or "" for x in part.column("text")]
            sizes = [len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "n_bytes": pa.array(sizes, pa.int64()), "n_tokens": pa.array(m.counts(texts), pa.int64())})


def token_counts(documents: DataFrame, path: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens and whether they are more than ``limit``, for every document."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = rows.mapInArrow(on_executors("token_counts", "count_tokens", path), "doc_id long, n_bytes long, n_tokens long")
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)


def op5_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
