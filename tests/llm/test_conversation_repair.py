"""op11: the cheapest repair against all sequences of edits, the whole operator against plain Python."""

import hashlib
import random
import re
import zlib

import pytest

from sparkevid.llm import conversation_repair as C
from sparkevid.llm import earley

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.strip(SPACE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def cheapest(rows):
    """Every sequence of edits up to the cost of deleting all; (cost, audit, lines)."""
    marks = faults(rows)
    found = []

    def extend(i, cost, audit, roles, lines):
        if cost > 2 * len(rows):
            return
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            found.append((cost, audit, lines))
        for role in ("user", "assistant"):
            extend(i, cost + 5, audit + "I", roles + role[0], [*lines, f"{role}:"])
        if i < len(rows):
            _, role, text = rows[i]
            extend(i + 1, cost + 2, audit + "D", roles, lines)
            if marks[i] not in ("blank", "duplicate"):
                more = 5 * (marks[i] == "truncated")
                extend(i + 1, cost + more, audit + "K", roles + (role[:1] or "-"), [*lines, f"{role}:{text}"])
                for other in ("user", "assistant"):
                    extend(i + 1, cost + 1 + more, audit + "R", roles + other[0], [*lines, f"{other}:{text}"])

    extend(0, 0, "", "", [])
    return min(found, key=lambda x: x[:2])


def plain(table, conv, best=cheapest, damage=True):
    """The contract for one conversation, in plain Python."""
    rows = []
    key = lambda r: (r[0] is not None, r[0] or 0)
    for c, turn, role, text in table:
        if c != conv:
            continue
        role, text = (" " if v is None else v for v in (role, text))
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20 if damage else 9
        role = "user" if kind == 4 else role
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        rows += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    rows.sort(key=key)
    turns = {t for t, _, _ in rows if t is not None}
    marks = faults(rows)
    cost, audit, lines = best(rows)
    illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return (conv, gaps, *(marks.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


@pytest.mark.parametrize("seed", range(150))
def test_parse_is_the_cheapest_repair(seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["user", "assistant", "system", "tool", "unknown", ""]), rng.choice(["A.", "B!", "C", " ", "D?\n"])) for i in range(rng.randint(0, 5))]
    marks = faults(rows)
    words = "".join("-" if m in ("blank", "duplicate") else C.symbol(r[1], m == "truncated") for r, m in zip(rows, marks, strict=True))
    cost, audit = min(v for k, v in C.parsed(words).items() if k in C.ENDS)
    want = cheapest(rows)
    assert (cost, audit) == want[:2]
    assert C.repaired(audit, [(r[1], r[2]) for r in rows]) == want[2]


@pytest.mark.parametrize("seed", range(20))
def test_matrices_combine_to_the_parse_of_the_whole(seed):
    rng = random.Random(seed)
    words = "".join(rng.choice("uuaaasSUAo-") for _ in range(90))
    whole = earley.parse(C.GRAMMARS["nothing"], words, C.STATES)
    best = {"nothing": (0, "")}
    for lo in range(0, 90, 17):
        step: dict = {}
        for start, (cost, audit) in best.items():
            for end, (more, own) in C.parsed(words[lo : lo + 17], start).items():
                step[end] = min(step.get(end, (10**9, "")), (cost + more, audit + own))
        best = step
    assert best == whole


COLUMNS = "conv_id long, turn long, role string, text string"


def run(spark, rows, columns=COLUMNS):
    got = C.repair(C.damaged(spark.createDataFrame(rows, columns)))
    assert got.columns == [c.split()[0] for c in C.RESULT.split(", ")]
    return sorted(map(tuple, got.collect()), key=str)


def test_edges(spark):
    """Nulls in every column, blanks, copies within and across turns, dropped conversations, roles of other names."""
    rows = [(1, t, r, x) for t, (r, x) in enumerate([("system", "S."), ("user", "Q?"), ("assistant", "A."), ("user", "Q?"), ("tool", "cut off"), (None, None)])]
    rows += [(None, 0, "user", "no conversation."), (None, None, "assistant", "no turn."), (2, None, "user", "A."), (2, 5, "user", "A."), (2, 9, "assistant", "B."), (2, 10, "", "C.")]
    rows += [(3, t, "user" if t % 2 else "assistant", f"Text {t}.") for t in range(5)] + [(4, 7, "user", "x" * 100_000 + ".")]
    gone = next(i for i in range(5, 5000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows += [(gone, 0, "user", "Dropped.")]
    want = sorted((plain(rows, c) for c in {r[0] for r in rows}), key=str)
    assert run(spark, rows) == want
    empty = next(w for w in want if w[0] == gone)
    assert empty[1:8] == (0, 0, 0, 0, 0, 0, "") and empty[8] == C.EMPTY


def test_repeated_rows_and_clashing_columns(spark):
    rows = [(1, 0, "user", "Same.")] * 3 + [(1, 1, "assistant", "Other.")] * 2
    wide = [(*r, "a", "b", "c") for r in rows]
    want = [plain(rows, 1)]
    assert run(spark, rows) == want
    assert run(spark, wide, f"{COLUMNS}, n string, first string, h1 string") == want


def test_empty(spark):
    assert C.repair(C.damaged(spark.createDataFrame([], COLUMNS))).count() == 0


def by_dynamic_programme(rows):
    """As ``cheapest``, over (state, cost, audit), for long conversations."""
    marks = faults(rows)
    after = {("", "u"): "u", ("", "s"): "s", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    def inserted(best):
        for _ in range(3):
            for state, (cost, audit, lines) in list(best.items()):
                for role in ("user", "assistant"):
                    if to := after.get((state, role[0])):
                        new = (cost + 5, audit + "I", [*lines, f"{role}:"])
                        if to not in best or new[:2] < best[to][:2]:
                            best[to] = new
        return best

    best = inserted({"": (0, "", [])})
    for (_, role, text), mark in zip(rows, marks, strict=True):
        step: dict = {}
        for state, (cost, audit, lines) in best.items():
            ways = [(state, 2, "D", [])]
            if mark not in ("blank", "duplicate"):
                more = 5 * (mark == "truncated")
                ways += [(after.get((state, r[:1])), c + more, e, [f"{r}:{text}"]) for r, c, e in ((role, 0, "K"), ("user", 1, "R"), ("assistant", 1, "R"))]
            for to, more, letter, line in ways:
                new = (cost + more, audit + letter, lines + line)
                if to is not None and (to not in step or new[:2] < step[to][:2]):
                    step[to] = new
        best = inserted(step)
    return min((best[k] for k in ("", "a") if k in best), key=lambda x: x[:2])


def test_whole_table_and_long_conversations(spark, small, monkeypatch):
    """Every conversation of the smallest table, and one of 300 rows, over many small partitions and so over chunks that are joined."""
    table = [tuple(r) for r in spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rng = random.Random(5)
    table += [(10**6, t, rng.choice(["user", "assistant", "system"]), rng.choice(["Yes.", f"Words {t}.", f"cut {t}", " "])) for t in range(300)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = run(spark, table)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == sorted((plain(table, c, by_dynamic_programme) for c in {r[0] for r in table}), key=str)


def test_undamaged(spark):
    rows = [(1, 0, "user", "Q?"), (1, 1, "user", "Again?"), (1, 2, "assistant", "A.")]
    got = [tuple(r) for r in C.repair(C.undamaged(spark.createDataFrame(rows, COLUMNS))).collect()]
    assert got == [plain(rows, 1, damage=False)]


def test_short_chunks(spark, monkeypatch):
    """A conversation cut inside a partition: the chunk function by itself, three rows a chunk."""
    import pyarrow as pa

    monkeypatch.setattr(C, "CHUNK", 3)
    monkeypatch.setattr("pyspark.TaskContext.get", lambda: type("T", (), {"partitionId": lambda self: 0})())
    rng = random.Random(3)
    rows = [(7, t, rng.choice(["user", "assistant", "system"]), rng.choice(["Yes.", f"W {t}.", f"cut {t}"])) for t in range(40)]
    frame = C.ordered(C.undamaged(spark.createDataFrame(rows, COLUMNS))).coalesce(1).toArrow()
    chunks = pa.Table.from_batches(list(C.chunked(iter(frame.to_batches(max_chunksize=7)))))
    assert chunks.num_rows == 14 and not any(chunks["whole"].to_pylist())
    steps = pa.Table.from_batches(list(C.joined(iter(chunks.to_batches()))), schema=C.JOINED).to_pylist()
    texts = [{**r, **{k: s[k] for k in ("start", "edits")}} for r, s in zip(chunks.to_pylist(), steps, strict=True)]
    [out] = [r for b in C.hashed(iter([pa.RecordBatch.from_pylist(texts)])) for r in b.to_pylist()]
    want = plain(rows, 7, by_dynamic_programme, damage=False)
    last = steps[-1]
    assert (last["blank"], last["duplicate"], last["truncated"], last["illegal"], last["cost"], last["audit"], out["sha"]) == want[2:]
