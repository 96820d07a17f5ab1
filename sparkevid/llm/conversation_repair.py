"""Repair of the turn structure of conversations by error-correcting Earley parsing.

The role grammar is: nothing, or an optional system turn and then one or more pairs of user and assistant. Words are rows; productions keep a
row (0), change its role (1), delete it (2) or insert an empty row (5); a truncated row that stays costs 5 more; blank rows and
duplicates must go. The chart (``earley``) keeps the least (cost, audit) of each item, and the complete one gives the repair.

How the work is split. Rows are aggregated to one text for each conversation, role and text, and to counts of turns without the text,
both combined before the shuffle; a range partitioning over (conversation, turn, role, text's hash) deals them out, so that neither a long
conversation nor a group of copies is one task's work. Tasks cut what they read into chunks of at most CHUNK rows. A chunk that is a
whole conversation is parsed to its end. Others are parsed from each state of the grammar to each, which gives a small matrix of
(cost, audit); matrices are combined in order, by associative sums, and traced back to each chunk. Only the hash of a repaired
conversation, sequential by definition, runs through the texts of a long conversation in one task, as a stream.

Order: by turn, null first; rows of one turn by role and by the hash of their text, copies side by side. Null roles and texts are one space. A null conv_id is a
conversation of its own. A turn that occurs in several rows counts once for gaps, and a null turn not at all. Conversations of which
no row is left are returned with zeros and an empty audit. Extra columns are not read, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import earley
from .runtime import on_executors, table, written

#: Rows and characters of a chunk at most (one row may be longer).
CHUNK, CHUNK_CHARS = 1024, 1 << 22
#: Nothing read, a system turn read, a user's turn open, pairs complete.
STATES = ("nothing", "opened", "asked", "closed")
ENDS = ("nothing", "closed")
EMPTY = hashlib.sha256().hexdigest()
RULES = {
    "nothing": [("nothing", "deleted")],
    "opened": [("nothing", "system"), ("opened", "deleted")],
    "asked": [("nothing", "user"), ("opened", "user"), ("closed", "user"), ("asked", "deleted")],
    "closed": [("asked", "assistant"), ("closed", "deleted")],
}
INSERTS = {"user": (5, "I"), "assistant": (5, "I")}


def edits(word: str) -> dict[str, earley.Value]:
    """What can be done with a row: "-" must go; otherwise its role's initial, a capital if it is truncated."""
    out = {"deleted": (2, "D")}
    if word != "-":
        more = 5 if word.isupper() else 0
        initial = word.lower()
        for kind in ("user", "assistant"):
            out[kind] = (more, "K") if initial == kind[0] else (1 + more, "R")
        if initial == "s":
            out["system"] = (more, "K")
    return out


#: A grammar for each state that a parse starts from: there nothing needs to be read.
GRAMMARS = {start: earley.Grammar({k: [*v, ()] if k == start else v for k, v in RULES.items()}, edits, INSERTS) for start in STATES}


@lru_cache(1 << 14)
def _short(words: str, start: str) -> dict[str, earley.Value]:
    return earley.parse(GRAMMARS[start], words, STATES)


def parsed(words: str, start: str = "nothing") -> dict[str, earley.Value]:
    """The least (cost, audit) from ``start`` to each state; results of short conversations are remembered."""
    return _short(words, start) if len(words) <= 32 else earley.parse(GRAMMARS[start], words, STATES)


def symbol(role: str, truncated: bool) -> str:
    initial = role[:1] if role[:1] in ("s", "u", "a") else "o"
    return initial.upper() if truncated else initial


def repaired(audit: str, rows: list[tuple[str, str] | None], start: str = "nothing") -> list[str]:
    """The lines ``role:text`` that the edits leave of the rows."""
    out: list[str] = []
    state, at = start, 0
    for letter in audit:
        if letter == "I":
            role, text = ("assistant" if state == "asked" else "user"), ""
        else:
            row, at = rows[at], at + 1
            if letter == "D":
                continue
            role, text = row
            if letter == "R":
                role = "assistant" if state == "asked" else "user"
            elif state == "nothing" and role.startswith("s"):
                state = "opened"
                out.append(f"{role}:{text}")
                continue
        state = "closed" if state == "asked" else "asked"
        out.append(f"{role}:{text}")
    return out


def blank(text: Column) -> Column:
    return ~F.regexp_like(text, F.lit(r"[^\x20\x09-\x0D]"))


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, n: rows after the damage of the contract; n is 0 for a dropped row and 2 for a repeated one."""
    c, turn = F.col("conv_id").cast("long"), F.col("turn").cast("long")
    key = F.concat(F.coalesce(c.cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(turn.cast("string"), F.lit(" ")))
    rows = conversations.select(
        c.alias("conv_id"), turn.alias("turn"), F.coalesce(F.col("role"), F.lit(" ")).alias("role"), F.coalesce(F.col("text"), F.lit(" ")).alias("text"),
        (F.crc32(key.cast("binary")) % 20).alias("kind"),
    )
    kind = F.col("kind")
    return rows.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("n"),
    )


def undamaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, n of a table as it is."""
    role, text = (F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text"))
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role, text, F.lit(1).cast("long").alias("n"))


def ordered(rows: DataFrame) -> DataFrame:
    """One row for each turn, role and text of a conversation, with the number of its copies, in order within range partitions. ``text``
    is set only in the first row of its role and text in the conversation (``first``); the other rows must go anyway."""
    hashed = (F.xxhash64("text"), F.xxhash64(F.lit("second"), "text"))
    there = F.col("n") > 0
    counts = rows.select(
        "conv_id", "turn", F.when(there, F.col("role")).alias("role"), *(F.when(there, h).alias(c) for h, c in zip(hashed, ("h1", "h2"), strict=True)),
        F.when(there, blank(F.col("text"))).alias("blank"), "n",
    ).groupBy("conv_id", "turn", "role", "h1", "h2", "blank").agg(F.sum("n").alias("n"))
    first = rows.where(there).groupBy("conv_id", "role", "text").agg(F.min(F.struct(F.col("turn").isNotNull().alias("later"), "turn")).alias("first"))
    texts = first.select("conv_id", F.col("first.turn").alias("turn"), "role", *(h.alias(c) for h, c in zip(hashed, ("h1", "h2"), strict=True)), F.lit(0).cast("long").alias("n"), "text")
    counts = counts.withColumn("text", F.lit(None).cast("string"))
    texts = texts.withColumn("blank", blank(F.col("text"))).withColumn("truncated", ~F.regexp_like("text", F.lit(r"[.!?][\x20\x09-\x0D]*\z")))
    both = texts.unionByName(counts.withColumn("truncated", F.lit(False)))
    by = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "h1", "h2")]
    return both.repartitionByRange(*by).sortWithinPartitions(*by, F.col("text").asc_nulls_last()).select("conv_id", "turn", "role", "h1", "h2", "blank", "truncated", "n", "text")


CHUNKS = pa.schema([
    ("conv_id", pa.int64()), ("part", pa.int32()), ("seq", pa.int32()), ("whole", pa.bool_()), ("n_rows", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()),
    ("truncated", pa.int64()), ("illegal", pa.int64()), ("first_role", pa.string()), ("last_role", pa.string()), ("first_turn", pa.int64()), ("last_turn", pa.int64()),
    ("turns", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("sha", pa.string()),
    ("moves", pa.list_(pa.struct([("start", pa.string()), ("end", pa.string()), ("cost", pa.int64()), ("audit", pa.string())]))),
    ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())),
])
CHUNKS_SQL = (
    "conv_id long, part int, seq int, whole boolean, n_rows long, blank long, duplicate long, truncated long, illegal long, first_role string, last_role string, "
    "first_turn long, last_turn long, turns long, cost long, audit string, sha string, moves array<struct<start: string, end: string, cost: long, audit: string>>, "
    "roles array<string>, texts array<string>"
)
LEGAL = {"su", "ua", "au"}


class _Chunk:
    """Rows of one conversation, as they come."""

    def __init__(self):
        self.words: list[str] = []
        self.rows: list[tuple[str, str] | None] = []
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = self.chars = 0
        self.first_role = self.last_role = self.first_turn = self.last_turn = None

    def add(self, turn, role: str, blank: bool, truncated: bool, text: str | None) -> None:
        """``text`` is None for a copy of an earlier row."""
        keep = not blank and text is not None
        self.blank += blank
        self.duplicate += not blank and text is None
        self.truncated += keep and truncated
        self.words.append(symbol(role, truncated) if keep else "-")
        self.rows.append((role, text) if keep else None)
        self.chars += len(text) if keep else 0
        initial = role[:1]
        if self.last_role is None:
            self.first_role = initial
        else:
            self.illegal += self.last_role + initial not in LEGAL
        self.last_role = initial
        if turn is not None:
            self.turns += turn != self.last_turn or self.first_turn is None
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn

    def row(self, conv, part: int, seq: int, whole: bool) -> dict:
        words = "".join(self.words)
        cost, audit = min(v for k, v in parsed(words).items() if k in ENDS)
        out = {"conv_id": conv, "part": part, "seq": seq, "whole": whole, "n_rows": len(words), "cost": cost, "audit": audit}
        out |= {k: getattr(self, k) for k in ("blank", "duplicate", "truncated", "illegal", "first_role", "last_role", "first_turn", "last_turn", "turns")}
        out["sha"] = hashlib.sha256("\n".join(repaired(audit, self.rows)).encode()).hexdigest()
        if not whole:
            out["moves"] = [{"start": s, "end": e, "cost": c, "audit": a} for s in STATES for e, (c, a) in parsed(words, s).items()]
            out["roles"] = [r[0] if r else None for r in self.rows]
            out["texts"] = [r[1] if r else None for r in self.rows]
        return out


def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of a range partition. A conversation is whole for sure if it lies between two others and in one chunk."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    out: list[dict] = []
    nothing = object()
    conv, chunk, seq, cut, first, held = nothing, _Chunk(), 0, False, True, None

    def batch(least: int) -> Iterator[pa.RecordBatch]:
        if len(out) >= least:
            yield pa.RecordBatch.from_pylist(out, schema=CHUNKS)
            out.clear()

    def close(more: bool, last: bool) -> None:
        """End the chunk; ``more``: of the same conversation, ``last``: at the end of the partition."""
        nonlocal chunk, seq, cut
        out.append(chunk.row(conv, part, seq, not (more or cut or first or last)))
        chunk, seq, cut = _Chunk(), seq + 1, more

    for b in batches:
        columns = [b.column(i).to_pylist() for i in range(b.num_columns)]
        for c, turn, role, h1, h2, blank, truncated, n, text in zip(*columns, strict=True):
            if conv is nothing or c != conv:
                if conv is not nothing:
                    close(False, False)
                    first = False
                    yield from batch(512)
                conv, held = c, None
            key = (turn, role, h1, h2)
            if text is not None:
                held = (key, text, truncated)
                continue
            for i in range(n):
                if len(chunk.words) >= CHUNK or chunk.chars >= CHUNK_CHARS:
                    close(True, False)
                    yield from batch(8)
                own = held if i == 0 and held and held[0] == key else None
                chunk.add(turn, role, blank, bool(own and own[2]), own[1] if own else None)
    if conv is not nothing:
        close(False, True)
    yield from batch(1)


RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
JOINED = pa.schema([
    ("conv_id", pa.int64()), ("part", pa.int32()), ("seq", pa.int32()), ("chunks", pa.int64()), ("start", pa.string()), ("edits", pa.string()), ("first_turn", pa.int64()), ("last_turn", pa.int64()),
    *((c, pa.int64()) for c in ("turns", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("sha", pa.string()),
])
JOINED_SQL = "conv_id long, part int, seq int, chunks long, start string, edits string, first_turn long, last_turn long, turns long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, sha string"


class _Joined:
    """Chunks of one conversation in order: counts added, matrices combined, the best way to each state with its last chunk's part."""

    def __init__(self):
        self.total = dict.fromkeys(("turns", "blank", "duplicate", "truncated", "illegal"), 0)
        self.last_role = self.first_turn = self.last_turn = None
        self.best: dict[str, earley.Value] = {"nothing": (0, "")}
        self.ways: list[tuple[int, int, dict[str, tuple[str, str]]]] = []
        self.sha, self.n = EMPTY, 0

    def add(self, r: dict) -> None:
        for k in self.total:
            self.total[k] += r[k]
        if r["n_rows"]:
            self.total["illegal"] += self.last_role is not None and self.last_role + r["first_role"] not in LEGAL
            self.last_role = r["last_role"]
        if r["first_turn"] is not None:
            self.total["turns"] -= self.last_turn is not None and self.last_turn == r["first_turn"]
            self.first_turn = r["first_turn"] if self.first_turn is None else self.first_turn
            self.last_turn = r["last_turn"]
        best: dict[str, tuple[earley.Value, str, str]] = {}
        for m in r["moves"]:
            if m["start"] in self.best:
                cost, audit = self.best[m["start"]]
                found = ((cost + m["cost"], audit + m["audit"]), m["start"], m["audit"])
                best[m["end"]] = min(best.get(m["end"], found), found)
        self.best = {k: v[0] for k, v in best.items()}
        self.ways.append((r["part"], r["seq"], {k: v[1:] for k, v in best.items()}))
        self.sha, self.n = r["sha"], self.n + 1

    def rows(self, conv) -> Iterator[dict]:
        """A row for each chunk, with the state it starts from and its edits; the last has the conversation's figures as well."""
        (cost, audit), state = min((self.best[k], k) for k in ENDS if k in self.best)
        steps = []
        for part, seq, way in reversed(self.ways):
            state, own = way[state]
            steps.append({"conv_id": conv, "part": part, "seq": seq, "start": state, "edits": own})
        steps[0] |= self.total | {"chunks": self.n, "first_turn": self.first_turn, "last_turn": self.last_turn, "cost": cost, "audit": audit, "sha": self.sha}
        yield from reversed(steps)


def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations of which chunks come in order. Holds the audits of one conversation, as the result does."""
    nothing = object()
    conv, whole = nothing, _Joined()

    def batch() -> Iterator[pa.RecordBatch]:
        rows = list(whole.rows(conv))
        for lo in range(0, len(rows), 1000):
            yield pa.RecordBatch.from_pylist(rows[lo : lo + 1000], schema=JOINED)

    for b in batches:
        for r in b.to_pylist():
            if conv is nothing or r["conv_id"] != conv:
                if conv is not nothing:
                    yield from batch()
                conv, whole = r["conv_id"], _Joined()
            whole.add(r)
    if conv is not nothing:
        yield from batch()


HASHED = pa.schema([("conv_id", pa.int64()), ("sha", pa.string())])


def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of repaired conversations, whose chunks come in order, one chunk at a time."""
    nothing = object()
    conv, digest, begun = nothing, hashlib.sha256(), False
    one = lambda: pa.RecordBatch.from_pylist([{"conv_id": conv, "sha": digest.hexdigest()}], schema=HASHED)
    for b in batches:
        for r in b.to_pylist():
            if conv is nothing or r["conv_id"] != conv:
                if conv is not nothing:
                    yield one()
                conv, digest, begun = r["conv_id"], hashlib.sha256(), False
            rows = [None if t is None else (role, t) for role, t in zip(r["roles"], r["texts"], strict=True)]
            for line in repaired(r["edits"], rows, r["start"]):
                digest.update((f"\n{line}" if begun else line).encode())
                begun = True
    if conv is not nothing:
        yield one()


def repair(rows: DataFrame) -> DataFrame:
    """A row for each conversation of ``rows`` (conv_id, turn, role, text, n): its faults, the cheapest repair and its hash."""
    chunks = written(ordered(rows).mapInArrow(on_executors("conversation_repair", "chunked"), CHUNKS_SQL), "chunks")
    gaps = F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("turns"), F.lit(0))
    figures = ("conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    whole = chunks.where("whole").select(*figures, F.col("sha").alias("repaired_sha256"))
    pieces = chunks.where("not whole")
    in_order = pieces.drop("roles", "texts", "whole").repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")
    found = written(in_order.mapInArrow(on_executors("conversation_repair", "joined"), JOINED_SQL), "joined")
    ends = found.where("chunks is not null")
    single = ends.where("chunks = 1").select(*figures, F.col("sha").alias("repaired_sha256"))
    ids = ends.where("chunks > 1").select(F.col("conv_id").alias("id"))
    steps = found.join(ids, F.col("conv_id").eqNullSafe(F.col("id"))).select("part", "seq", "start", "edits")
    texts = pieces.select("conv_id", "part", "seq", "roles", "texts").join(steps, ["part", "seq"])
    texts = texts.select("conv_id", "part", "seq", "start", "edits", "roles", "texts").repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")
    digests = texts.mapInArrow(on_executors("conversation_repair", "hashed"), "conv_id long, sha string")
    digests = digests.select(F.col("conv_id").alias("id"), F.col("sha").alias("repaired_sha256"))
    long = ends.where("chunks > 1").select(*figures).join(digests, F.col("conv_id").eqNullSafe(F.col("id"))).drop("id")
    return whole.unionByName(single).unionByName(long)


def op11_conversation_repair(spark, sf_dir: str) -> DataFrame:
    return repair(damaged(table(spark, sf_dir, "conversations")))
