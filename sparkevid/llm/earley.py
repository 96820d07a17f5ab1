"""Error-correcting Earley parsing with weights.

A grammar has nonterminals with productions and word classes. A word class takes one word, at a cost and with a letter that depend on
the word, or, by an insert production, none. Chart items keep the least (cost, audit), where the audit is the letters of the edits
in order; of equal costs the audit that is least in ASCII order stays. That order is kept by what is appended: edits of one stretch of words and
of one cost can't be prefixes of each other, since inserts cost more than nothing.

A chart has a column for each word boundary. An item that improves is worked through again, so the result does not depend on the order.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterable, Mapping

Value = tuple[int, str]
Item = tuple[str, tuple[str, ...], int, int]  # left side, right side, dot, column of origin


class Grammar:
    """``rules``: nonterminal to right sides; ``edits``: of a word, each class that can take it with (cost, letter); ``inserts``: classes
    that can stand without a word."""

    def __init__(self, rules: Mapping[str, Iterable[tuple[str, ...]]], edits: Callable[[str], dict[str, Value]], inserts: Mapping[str, Value]):
        self.rules = {k: tuple(v) for k, v in rules.items()}
        self.edits, self.inserts = edits, inserts


class _Column:
    def __init__(self, at: int):
        self.at = at
        self.best: dict[Item, Value] = {}
        self.agenda: list[tuple[int, str, Item]] = []
        self.waiting: dict[str, set[Item]] = {}  # by the symbol after the dot
        self.done: dict[str, set[Item]] = {}  # complete without a word, by left side

    def put(self, item: Item, value: Value) -> None:
        if item not in self.best or value < self.best[item]:
            self.best[item] = value
            heapq.heappush(self.agenda, (*value, item))


def _close(grammar: Grammar, columns: list[_Column], column: _Column) -> None:
    """Predict, complete and insert until nothing in the column improves."""
    while column.agenda:
        cost, audit, item = heapq.heappop(column.agenda)
        if column.best[item] != (cost, audit):
            continue
        left, right, dot, origin = item
        if dot == len(right):
            if origin == column.at:
                column.done.setdefault(left, set()).add(item)
            for other in tuple(columns[origin].waiting.get(left, ())):
                before = columns[origin].best[other]
                column.put((other[0], other[1], other[2] + 1, other[3]), (before[0] + cost, before[1] + audit))
            continue
        symbol = right[dot]
        column.waiting.setdefault(symbol, set()).add(item)
        after = (left, right, dot + 1, origin)
        if symbol in grammar.rules:
            for production in grammar.rules[symbol]:
                column.put((symbol, production, 0, column.at), (0, ""))
            for whole in column.done.get(symbol, ()):
                found = column.best[whole]
                column.put(after, (cost + found[0], audit + found[1]))
        elif symbol in grammar.inserts:
            extra = grammar.inserts[symbol]
            column.put(after, (cost + extra[0], audit + extra[1]))


def parse(grammar: Grammar, words: Iterable[str], goals: tuple[str, ...]) -> dict[str, Value]:
    """The least (cost, audit) of each goal that the words can be repaired to."""
    columns = [_Column(0)]
    for goal in goals:
        for production in grammar.rules[goal]:
            columns[0].put((goal, production, 0, 0), (0, ""))
    _close(grammar, columns, columns[0])
    for word in words:
        column = _Column(len(columns))
        edits = grammar.edits(word)
        for symbol, (cost, letter) in edits.items():
            for left, right, dot, origin in columns[-1].waiting.get(symbol, ()):
                before = columns[-1].best[left, right, dot, origin]
                column.put((left, right, dot + 1, origin), (before[0] + cost, before[1] + letter))
        column.at = len(columns)
        columns.append(column)
        _close(grammar, columns, column)
    out: dict[str, Value] = {}
    for (left, right, dot, origin), value in columns[-1].best.items():
        if left in goals and dot == len(right) and origin == 0:
            out[left] = min(out.get(left, value), value)
    return out
