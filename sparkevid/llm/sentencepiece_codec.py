"""SentencePiece encoding and decoding: the path of a BPE model's pieces, by a max-plus parallel scan.

Merging by rank leaves the one sequence of pieces of which each neighbouring pair, merged by itself, stays apart: merges happen in
the same order in a part of a text that they never leave. So an encoding is the best path over pieces, where a pair that stays
apart weighs 0 and any other minus infinity, and the ids are those of the library. An unknown character becomes its bytes. No piece lies
across the places at which ``Pieces.runs`` cuts, so the runs of a text are solved once for each distinct run.

A giant document is split into chunks, rows of their own, dealt to tasks by their number. A state at a boundary is the piece
that ends there or lies across: how many of its characters are before it and how many behind.

1. Each chunk yields its transfer matrix, entry state to exit state, in max-plus algebra. Beyond the first cut of a chunk all
   paths are the same, so a matrix costs a few runs.
2. Matrices combine associatively: within blocks of BLOCK chunks, then over the blocks of a document; prefixes of the
   product give the scores of all states at each chunk's entry.
3. With these a chunk knows for each exit state the entry state before it; these maps compose associatively from the right, and
   give each chunk its exit state.
4. Each chunk is traced back by itself.

Null and empty texts have no ids. U+2581 in a text is a space to the model and decodes as one. Repeated rows are
encoded each for itself; extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pieces
from .runtime import on_executors, table, written

#: Characters of a chunk; documents of at most one chunk need no scan. Chunks of a block, and chunks that a task gets.
CHUNK = 1 << 16
BLOCK = 256
DEAL = 32
#: Runs of each of two generations, and pairs, that are remembered. Characters from which a run goes by its path instead of by merging.
REMEMBERED = 250_000
LONG = 64
NONE = np.int64(-(1 << 61))


class Codec:
    def __init__(self, path: str):
        model = self.model = pieces.load(path)
        self.piece = {n: i for n, i in model.ids.items() if model.kinds[i] == pieces.NORMAL}
        self.rank = {n: -model.scores[i] for n, i in self.piece.items()}
        self.prefixes = {n[:k] for n in self.piece for k in range(1, len(n))}
        self.longest = model.longest
        self.run = model.runs()
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        low = {i: chr(b) for b, i in model.byte_ids.items() if b < 128}
        control = {i for i, k in enumerate(model.kinds) if k == pieces.CONTROL}
        self.shown = ["" if i in control else low.get(i, n).replace(pieces.SPACE, " ") for i, n in enumerate(model.names)]
        self.packed = {n: np.array([i], "<i4").tobytes() for n, i in self.piece.items()}
        self.high = frozenset(i for b, i in model.byte_ids.items() if b > 127)

    def merged(self, text: str) -> list[str]:
        """The symbols that are left when the pair of least rank, the leftmost of equals, merges until there is none."""
        parts = list(text)
        none = float("inf")
        ranks = [self.rank.get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks and (least := min(ranks)) != none:
            i = ranks.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = self.rank.get(parts[i - 1] + parts[i], none)
            if i < len(ranks):
                ranks[i] = self.rank.get(parts[i] + parts[i + 1], none)
        return parts

    def apart(self, a: str, b: str) -> bool:
        """Whether two symbols that stand beside each other stay so; ``a`` may be empty."""
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) > 4 * REMEMBERED:
                self.pairs.clear()
            known = self.pairs[a, b] = self.merged(a + b) == ([a, b] if a else [b])
        return known

    def path(self, text: str, begin: int, last: str, stop: int) -> list[int]:
        """Starts of the symbols by their ends, -1 where none ends: the paths from ``begin``, after the symbol ``last``, on. Symbols
        start before ``stop`` and may end behind it. At each place at most one can end."""
        start = [-1] * (len(text) + 1)
        for s in range(begin, stop):
            if s > begin and start[s] < 0:
                continue
            before = last if s == begin else text[start[s] : s]
            for e in range(s + 1, min(len(text), s + self.longest) + 1):
                part = text[s:e]
                if start[e] < 0 and (e == s + 1 or part in self.piece) and self.apart(before, part):
                    start[e] = s
                if part not in self.prefixes:
                    break
        return start

    def trace(self, text: str, start: list[int], begin: int, end: int) -> bytes:
        """Packed ids of the path from ``begin`` to ``end``."""
        parts = []
        while end > begin:
            parts.append(self.ids_of(text[start[end] : end]))
            end = start[end]
        return b"".join(reversed(parts))

    def ids_of(self, part: str) -> bytes:
        return self.packed.get(part) or np.array([self.model.byte_ids[b] for b in part.encode()], "<i4").tobytes()

    def encode_run(self, run: str) -> bytes:
        if len(run) < LONG:
            return b"".join(map(self.ids_of, self.merged(run)))
        return self.trace(run, self.path(run, 0, "", len(run)), 0, len(run))

    def encode(self, text: str) -> bytes:
        """Ids of whole runs of a normalised text, as little-endian 32-bit integers."""
        runs = self.run.findall(text)
        if len(self.known) > REMEMBERED:
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        for run in set(runs).difference(known):
            known[run] = older.get(run) or self.encode_run(run)
        return b"".join(map(known.__getitem__, runs))

    def decode(self, ids: list[int], first: bool = True) -> str:
        """The text of a part's ids; ``first``: the part begins with the dummy prefix."""
        if self.high.isdisjoint(ids):
            text = "".join(map(self.shown.__getitem__, ids))
        else:
            out: list[str] = []
            held = bytearray()
            for i in ids:
                if self.model.kinds[i] == pieces.BYTE:
                    held.append(int(self.model.names[i][3:5], 16))
                    continue
                if held:
                    out.append(held.decode(errors="replace"))
                    held.clear()
                out.append(self.shown[i])
            out.append(held.decode(errors="replace"))
            text = "".join(out)
        return text[1:] if first and self.model.dummy_prefix and text.startswith(" ") else text

    def states(self, text: str, at: int) -> list[tuple[int, int]]:
        """Spans of the symbols that start before ``at`` and end there or behind; the start of a text has the empty one."""
        if at == 0:
            return [(0, 0)]
        spans = ((s, e) for s in range(max(0, at - self.longest), at) for e in range(at, min(len(text), s + self.longest) + 1))
        return [(s, e) for s, e in spans if (e == s + 1 or text[s:e] in self.piece) and self.apart("", text[s:e])]

    def bounds(self, text: str, lead: int, stop: int) -> tuple[int, int]:
        """First and last place from ``lead`` on, before ``stop``, that every path passes; (-1, -1) if there is none."""
        cuts = [m.start() for m in self.run.finditer(text) if lead <= m.start() < stop and (m.start() or not lead)]
        return (cuts[0], cuts[-1]) if cuts else (-1, -1)

    def transfer(self, text: str, lead: int, n: int) -> np.ndarray:
        """(entry states, exit states): 0 where a path leads from one to the other. The chunk is text[lead:lead + n]; up to
        ``longest`` characters stand before and behind it."""
        stop = lead + n
        enter, leave = self.states(text, lead), self.states(text, stop)
        out = np.full((len(enter), len(leave)), NONE)
        first, last = self.bounds(text, lead, stop)
        if first >= 0:
            head, tail = text[:first], self.path(text, last, "", stop)
            reach = [e == first or (e < first and self.path(head, e, text[s:e], first)[first] >= 0) for s, e in enter]
            out[np.ix_(reach, [tail[y] == x for x, y in leave])] = 0
            return out
        for i, (s, e) in enumerate(enter):
            if e >= stop:
                out[i, [x == (s, e) for x in leave]] = 0
            else:
                found = self.path(text, e, text[s:e], stop)
                out[i, [found[y] == x and x >= e for x, y in leave]] = 0
        return out

    def between(self, text: str, lead: int, n: int, entry: int, leave: int) -> bytes:
        """Packed ids of the symbols that start in a chunk, from an entry state to an exit state."""
        stop = lead + n
        (s, e), (_, y) = self.states(text, lead)[entry], self.states(text, stop)[leave]
        if e >= stop:
            return b""
        first, last = self.bounds(text, lead, stop)
        if first < 0:
            return self.trace(text, self.path(text, e, text[s:e], stop), e, y)
        head = text[:first]
        begun = self.trace(head, self.path(head, e, text[s:e], first), e, first) if e < first else b""
        return begun + self.encode(text[first:last]) + self.trace(text, self.path(text, last, "", stop), last, y)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product of a (k, m) and b (m, n)."""
    s = np.where((a[:, :, None] == NONE) | (b[None] == NONE), NONE, a[:, :, None] + b[None])
    return s.max(axis=1)


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


#: ids of a document of one part, or a chunk of a giant one: its text with ``lead`` characters before it and some behind, its own length.
PART = "doc_id long, row long, part long, parts long, ids array<int>, chunk string, lead int, n int"
CHUNKS = "doc_id long, row long, part long, parts long, block long, chunk string, lead int, n int, matrix binary, entries int"


def id_lists(ids: list[bytes | None]) -> pa.Array:
    """array<int> from packed ids; null for None."""
    sizes = np.fromiter((len(x) // 4 if x else 0 for x in ids), np.int64, len(ids))
    ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    values = pa.array(np.frombuffer(b"".join(x for x in ids if x), "<i4"))
    return pa.ListArray.from_arrays(pa.array(ends), values, mask=pa.array([x is None for x in ids]))


def first_pass(batches: Iterator[pa.RecordBatch], path: str, size: int) -> Iterator[pa.RecordBatch]:
    """Documents to their ids, giant ones to their chunks."""
    c = codec(path)
    names = [x.split()[0] for x in PART.split(", ")]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), None, pa.string(), pa.int32(), pa.int32())

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({k: id_lists(v) if t is None else pa.array(v, t) for k, v, t in zip(names, zip(*rows, strict=True), kinds, strict=True)})

    for batch in batches:
        rows: list[tuple] = []
        for doc, row, x in zip(batch.column("doc_id").to_pylist(), batch.column("row").to_pylist(), batch.column("text"), strict=True):
            text = c.model.normalized(x.as_py() or "")
            if len(text) <= size:
                rows.append((doc, row, 0, 1, c.encode(text), None, None, None))
            for k, at in enumerate(range(0, len(text), size)) if len(text) > size else ():
                lead = min(at, c.longest)
                rows.append((doc, row, k, -(-len(text) // size), None, text[at - lead : at + size + c.longest], lead, min(size, len(text) - at)))
                if len(rows) >= 256:
                    yield batch_of(rows)
                    rows = []
            if len(rows) >= 256:
                yield batch_of(rows)
                rows = []
        if rows:
            yield batch_of(rows)


def transferred(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """Chunks with their matrices."""
    c = codec(path)
    for batch in batches:
        found = [c.transfer(t, lead, n) for t, lead, n in zip(*(batch.column(k).to_pylist() for k in ("chunk", "lead", "n")), strict=True)]
        keep = {k: batch.column(k) for k in ("doc_id", "row", "part", "parts", "block", "chunk", "lead", "n")}
        yield pa.RecordBatch.from_pydict(keep | {"matrix": pa.array([m.tobytes() for m in found], pa.binary()), "entries": pa.array([len(m) for m in found], pa.int32())})


def matrices(pdf) -> list[np.ndarray]:
    return [np.frombuffer(x, np.int64).reshape(n, -1) for x, n in zip(pdf["matrix"], pdf["entries"], strict=True)]


def block_product(pdf):
    """Group (row, block) to the product of its chunks' matrices."""
    import functools

    pdf = pdf.sort_values("part")
    out = functools.reduce(product, matrices(pdf))
    return pdf.iloc[:1].assign(matrix=[out.tobytes()], entries=[len(out)])[["row", "block", "matrix", "entries"]]


def scan(found: list[np.ndarray], v: np.ndarray, leave: int | None) -> tuple[list[np.ndarray], list[int], list[int]]:
    """Scores at the beginning of each matrix, and the entry and exit state of each, from scores ``v`` to the state ``leave``, or the best."""
    begin, back = [], []
    for m in found:
        begin.append(v)
        back.append(np.where((v.T == NONE) | (m == NONE), NONE, v.T + m).argmax(axis=0))
        v = product(v, m)
    at = int(v.argmax()) if leave is None else leave
    enter, left = [], []
    for b in reversed(back):
        left.append(at)
        at = int(b[at])
        enter.append(at)
    return begin, enter[::-1], left[::-1]


def block_scan(pdf):
    """Group (row) of blocks to the scores at the beginning of each and its exit state."""
    pdf = pdf.sort_values("block")
    begin, _, left = scan(matrices(pdf), np.zeros((1, 1), np.int64), None)
    return pdf.assign(scores=[v.tobytes() for v in begin], leave=left)[["row", "block", "scores", "leave"]]


def chunk_scan(pdf):
    """Group (row, block) of chunks with the block's scores and exit state to the entry and exit state of each."""
    pdf = pdf.sort_values("part")
    v = np.frombuffer(pdf["scores"].iloc[0], np.int64).reshape(1, -1)
    _, enter, left = scan(matrices(pdf), v, int(pdf["leave"].iloc[0]))
    return pdf.assign(enter=enter, left=left)[["row", "part", "enter", "left"]]


def traced(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """Chunks with their entry and exit states to their ids."""
    c = codec(path)
    for batch in batches:
        ids = [c.between(*x) for x in zip(*(batch.column(k).to_pylist() for k in ("chunk", "lead", "n", "enter", "left")), strict=True)]
        yield pa.RecordBatch.from_pydict({k: batch.column(k) for k in ("doc_id", "row", "part", "parts")} | {"ids": id_lists(ids)})


def scanned(chunks: DataFrame, path: str) -> DataFrame:
    """doc_id, row, part, parts, ids of the chunks of giant documents."""
    tasks = max(1, -(-chunks.count() // DEAL))
    dealt = chunks.withColumn("block", F.floor(F.col("part") / BLOCK).cast("long")).repartition(tasks, "row", "part")
    dealt = written(dealt.mapInArrow(on_executors("sentencepiece_codec", "transferred", path), CHUNKS), "chunks")
    small = dealt.select("row", "block", "part", "matrix", "entries")
    blocks = small.groupBy("row", "block").applyInPandas(block_product, "row long, block long, matrix binary, entries int")
    blocks = blocks.groupBy("row").applyInPandas(block_scan, "row long, block long, scores binary, leave int")
    states = small.join(blocks, ["row", "block"]).groupBy("row", "block").applyInPandas(chunk_scan, "row long, part long, enter int, left int")
    done = dealt.drop("matrix", "entries", "block").join(written(states, "states"), ["row", "part"]).repartition(tasks, "row", "part")
    return done.mapInArrow(on_executors("sentencepiece_codec", "traced", path), "doc_id long, row long, part long, parts long, ids array<int>")


def encode(documents: DataFrame, path: str, size: int = CHUNK) -> DataFrame:
    """doc_id, row (a number of the input row), part, parts, ids: the parts of a document's ids in order."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), "text")
    parts = written(rows.mapInArrow(on_executors("sentencepiece_codec", "first_pass", path, size), PART), "parts")
    columns = ("doc_id", "row", "part", "parts", "ids")
    return parts.where("parts = 1").select(*columns).unionByName(scanned(parts.where("parts > 1"), path).select(*columns))


def decoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """Adds the text of each part."""
    c = codec(path)
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            texts = [c.decode(ids or [], k == 0) for ids, k in zip(part.column("ids").to_pylist(), part.column("part").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pydict({k: part.column(k) for k in part.schema.names} | {"text": pa.array(texts, pa.string())})


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Adds ``text`` to parts of documents; joined in order they are the document."""
    schema = "doc_id long, row long, part long, parts long, ids array<int>, text string"
    return encoded.select("doc_id", "row", "part", "parts", "ids").mapInArrow(on_executors("sentencepiece_codec", "decoded", path), schema)


#: Figures of a part: its ids and their CRC-32 (little-endian, 32 bits), characters, bytes and CRC-32 of the text that they decode to.
FIGURES = "doc_id long, row long, part long, parts long, n_tokens long, ids_crc32 long, decoded_chars long, decoded_bytes long, decoded_crc32 long"
DIGEST = ("n_tokens", "ids_crc32", "decoded_chars", "decoded_bytes", "decoded_crc32")


def figures(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    c = codec(path)
    for batch in batches:
        ids = batch.column("ids")
        at, values = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False)
        rows = []
        for k, part in enumerate(batch.column("part").to_pylist()):
            own = values[at[k] : at[k + 1]].astype("<i4")
            text = c.decode(own.tolist(), part == 0)
            data = text.encode()
            rows.append((len(own), zlib.crc32(own.tobytes()), len(text), len(data), zlib.crc32(data)))
        cols = {k: batch.column(k) for k in ("doc_id", "row", "part", "parts")}
        yield pa.RecordBatch.from_pydict(cols | {k: pa.array(v, pa.int64()) for k, v in zip(DIGEST, zip(*rows, strict=True), strict=True)} if rows else cols | {k: pa.array([], pa.int64()) for k in DIGEST})


def crc32_joined(first: int, second: int, n: int) -> int:
    """The CRC-32 of two joined strings from theirs and the second one's length: the first's remainder times x^(8n), in GF(2)."""

    def times(a: int, b: int) -> int:  # bit 31 is x^0
        out = 0
        while a:
            if a & 1 << 31:
                out ^= b
            a = a << 1 & 0xFFFFFFFF
            b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
        return out

    power, square = 1 << 31, 1 << 23  # x^0 and x^8
    while n:
        if n & 1:
            power = times(power, square)
        square, n = times(square, square), n >> 1
    return times(first, power) ^ second


def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id and the figures of its parts in order to those of the document."""
    for batch in batches:
        rows = []
        for x in batch.column("x").to_pylist():
            n = ids_crc = chars = size = crc = 0
            for p in x:
                ids_crc = crc32_joined(ids_crc, p["ids_crc32"], 4 * p["n_tokens"])
                crc = crc32_joined(crc, p["decoded_crc32"], p["decoded_bytes"])
                n, chars, size = n + p["n_tokens"], chars + p["decoded_chars"], size + p["decoded_bytes"]
            rows.append((n, ids_crc, chars, size, crc))
        cols = zip(*rows, strict=True) if rows else [()] * len(DIGEST)
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id")} | {k: pa.array(v, pa.int64()) for k, v in zip(DIGEST, cols, strict=True)})


def digests(parts: DataFrame, path: str) -> DataFrame:
    """doc_id and the figures of each document; only figures of parts are gathered, never ids."""
    each = written(parts.select("doc_id", "row", "part", "parts", "ids").mapInArrow(on_executors("sentencepiece_codec", "figures", path), FIGURES), "figures")
    many = each.where("parts > 1").groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list(F.struct("part", *DIGEST))).alias("x"))
    many = many.select("doc_id", "x").mapInArrow(on_executors("sentencepiece_codec", "joined"), "doc_id long, " + ", ".join(f"{c} long" for c in DIGEST))
    return each.where("parts = 1").select("doc_id", *DIGEST).unionByName(many)


def op7_sentencepiece_codec(spark, sf_dir: str) -> DataFrame:
    """Per document: number and CRC-32 of its ids (little-endian, 32 bits), and characters, bytes and CRC-32 of the text that these decode to."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    return digests(encode(table(spark, sf_dir, "documents"), path), path)
